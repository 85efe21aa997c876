import struct

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.errors import Unsupported
from quarry.functions import codecs as C
from quarry.functions import kernels as K
from quarry.functions.types import decimal_from_unscaled, unsigned, wrapped
from quarry.sources.staging import written

BIG = [2**63 - 1, -(2**63), 0, -1, 1]
INTS = [x for i in range(300) for x in (BIG[i % 5], i * i, None if i % 7 == 0 else -i)] * 3  # 2700: two full chunks and a tail
FULL = [0 if x is None else x for x in INTS]
WORDS = [None if i % 9 == 4 else ["", "tö", "item_%d" % i, "item_1", "a much longer value than twelve bytes #%d" % (i % 3), "\x00"][i % 6] for i in range(1500)]


def chunks(spark, values, kind):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"row_offset bigint, v {kind}")
    return written(C.chunked(rows, "v"), "chunks")


def back(decoded):
    return [r.v for r in C.unchunked(decoded, "v").orderBy("row_offset").collect()]


@pytest.mark.parametrize(
    ("encode", "decode", "values", "kind"),
    [
        (C.dict_encode, C.dict_decode, WORDS, "string"),
        (C.runend_encode, C.runend_decode, [x for x in (1, 1, None, None, 2) for _ in range(250)], "bigint"),
        (C.rle_encode, C.rle_decode, [7] * 1024 + [x for x in (1, None, 2) for _ in range(100)], "bigint"),
        (C.zigzag_encode, C.zigzag_decode, FULL, "bigint"),
        (C.delta_encode, C.delta_decode, FULL, "bigint"),
        (C.sequence_encode, C.sequence_decode, list(range(-50, 5000, 3)), "bigint"),
        (lambda c: C.sparse_encode(c, F.lit(3).cast("bigint")), C.sparse_decode, [None if i % 50 == 7 else i if i % 11 == 0 else 3 for i in range(1100)], "bigint"),
        (C.for_encode, C.for_decode, [i * 3 - 500 for i in range(1100)], "bigint"),
        (C.constant_encode, C.constant_decode, [None] * 1024 + [4] * 9, "bigint"),
        (C.varbin_encode, C.varbin_decode, WORDS, "string"),
        (C.tokens_encode, C.tokens_decode, WORDS, "string"),
        (K.views_encode, K.views_decode, WORDS, "string"),
        (K.symbols_encode, K.symbols_decode, WORDS, "string"),
        (K.zstd_encode, K.zstd_decode, WORDS, "string"),
        (lambda c: K.bitpacked_encode(c, 5), lambda d: K.bitpacked_decode(d, 5), [None if i % 6 == 0 else i % 40 for i in range(1100)], "bigint"),
        (lambda c: K.bool_encode(c, 5), K.bool_decode, [i % 3 == 0 for i in range(1100)], "boolean"),
        (K.bytebool_encode, K.bytebool_decode, [i % 3 == 0 for i in range(30)], "boolean"),
        (lambda c: K.primitive_encode(c, "int64"), lambda d: K.primitive_decode(d, "int64", "bigint"), INTS, "bigint"),
    ],
)
def test_round_trips(spark, encode, decode, values, kind):
    coded = written(encode(chunks(spark, values, kind)), "coded")
    assert back(decode(coded)) == values


def bits(values):
    return [None if v is None else "nan" if v != v else struct.pack("<d", v) for v in values]


ODD = [0.1, -0.0, 0.0, float("inf"), float("-inf"), float("nan"), 1e300, 5e-324, 1 / 3, 123.45, None, -77.01] * 100


@pytest.mark.parametrize(
    ("encode", "decode"),
    [(K.alprd_encode, K.alprd_decode), (lambda c: K.primitive_encode(c, "float64"), lambda d: K.primitive_decode(d, "float64", "double"))],
)
def test_floats_keep_their_bits(spark, encode, decode):
    assert bits(back(decode(written(encode(chunks(spark, ODD, "double")), "coded")))) == bits(ODD)


def test_alp_patches_what_does_not_come_back(spark):
    """SQL does not tell -0.0 from 0.0, so that one bit may go."""
    got = back(C.alp_decode(written(C.alp_encode(chunks(spark, ODD, "double"), 5, 3), "coded"), 5, 3))
    same = lambda values: bits([v if v is None else v + 0.0 for v in values])
    assert same(got) == same(ODD)


def test_packed_bits_by_hand():
    """Bits 0, 1, 8 and 32 of the first word belong to rows 0, 128, 64 and 16."""
    words = np.zeros(16, np.uint64)
    words[0] = 1 << 0 | 1 << 1 | 1 << 8 | 1 << 32
    assert np.flatnonzero(K.bitunpack(words, 1)).tolist() == [0, 16, 64, 128]


@given(st.integers(1, 64), st.integers(0, 2**32))
def test_packing_round_trips(width, seed):
    v = np.random.default_rng(seed).integers(0, 1 << 63, 1024).astype(np.uint64) >> np.uint64(63 - min(width, 63))
    v &= np.uint64((1 << width) - 1)
    assert (K.bitunpack(K.bitpack(v, width), width) == v).all()


def test_lane_positions_are_a_permutation(spark):
    got = spark.range(1024).select(*C.lane_position(F.col("id").cast("int"))).toDF("lane", "row", "pos").collect()
    assert sorted(r.pos for r in got) == list(range(1024))
    assert len({(r.lane, r.row) for r in got}) == 1024


def test_wrapping_and_unsigned(spark):
    one = spark.range(1)
    ends = one.select(
        wrapped(F.lit(str(2**63)).cast("decimal(38,0)")).alias("a"), wrapped(F.lit(str(-(2**63) - 1)).cast("decimal(38,0)")).alias("b"),
        unsigned(F.lit(-1).cast("tinyint"), 8).alias("c"), unsigned(F.lit(-1).cast("bigint"), 64).cast("string").alias("d"), unsigned(F.lit(5).cast("int"), 32).alias("e"),
        decimal_from_unscaled(F.lit(2**63 - 1), 19, 2).cast("string").alias("f"),
    ).first()
    assert tuple(ends) == (-(2**63), 2**63 - 1, 255, str(2**64 - 1), 5, "92233720368547758.07")
    with pytest.raises(Unsupported):
        decimal_from_unscaled(F.lit(1), 39, 0)


def test_broken_data_is_refused(spark):
    def fails(df):
        with pytest.raises(Exception, match="invalid data|InvalidData"):
            df.collect()

    fails(C.dict_decode(spark.createDataFrame([(0, 1, ["a"], [3])], "chunk bigint, n int, values array<string>, codes array<int>")))
    fails(C.runend_decode(spark.createDataFrame([(0, 9, [3, 2], [1, 2])], "chunk bigint, n int, ends array<int>, values array<int>")))
    fails(C.runend_decode(spark.createDataFrame([(0, 9, [3, 5], [1, 2])], "chunk bigint, n int, ends array<int>, values array<int>")))
    fails(C.sparse_decode(spark.createDataFrame([(0, 9, 1, [3, 3], [1, 2])], "chunk bigint, n int, fill int, indices array<int>, patches array<int>")))
    fails(C.check_not_null(spark.createDataFrame([(0, [1, None])], "chunk bigint, vals array<int>")))
    fails(K.bytebool_decode(spark.createDataFrame([(0, 2, bytearray(b"\x00\x02"))], "chunk bigint, n int, data binary")))
    values = spark.createDataFrame([(1, "x")], "code bigint, value string")
    fails(C.layout_dict_decode(spark.createDataFrame([(0, 1), (1, 2)], "row_offset bigint, code bigint"), values, "v"))


def test_slices_and_null_codes(spark):
    sliced = spark.createDataFrame([(0, 4, [3, 9], ["a", "b"])], "chunk bigint, n int, ends array<int>, values array<string>")
    assert back(C.runend_decode(sliced, offset=2)) == ["a", "b", "b", "b"]
    values = spark.createDataFrame([(1, "x")], "code bigint, value string")
    codes = spark.createDataFrame([(0, 1), (1, None)], "row_offset bigint, code bigint")
    assert sorted(map(tuple, C.layout_dict_decode(codes, values, "v").collect())) == [(0, "x"), (1, None)]


def test_constant_chunks_only(spark):
    from quarry.functions.codecs import constant_decode, constant_encode

    chunks = lambda vals: spark.createDataFrame([(0, len(vals), vals)], "chunk bigint, n int, vals array<bigint>")
    assert constant_decode(constant_encode(chunks([7, 7]))).first().vals == [7, 7]
    assert constant_decode(constant_encode(chunks([None, None]))).first().vals == [None, None]
    for vals in ([7, 8], [7, None]):
        try:
            constant_encode(chunks(vals)).collect()
        except Exception as e:
            assert "not constant" in str(e)
        else:
            raise AssertionError(vals)


def test_fields_meet_by_chunk_without_a_broadcast(spark):
    """Encoded files are tiny beside what they decode to, so no side may be taken for small."""
    values = {"a": [None if i % 3 == 0 else "x" for i in range(2100)], "b": [i % 5 for i in range(2100)]}
    coded = {k: C.dict_decode(written(C.dict_encode(chunks(spark, v, kind)), "coded")) for (k, v), kind in zip(values.items(), ("string", "bigint"), strict=True)}
    both = C.unchunked(C.zipped(coded), "s").select("row_offset", "s.a", "s.b")
    assert "Broadcast" not in both._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, both.collect())) == list(zip(range(2100), values["a"], values["b"], strict=True))
    with pytest.raises(Exception, match="different lengths"):
        C.zipped({"a": coded["a"], "b": chunks(spark, [1], "bigint").union(chunks(spark, range(2000), "bigint").filter("chunk > 0"))}).collect()


@pytest.mark.parametrize("name", ["struct_decode", "varbin_decode"])
def test_queries_of_coded_fields_broadcast_nothing(spark, name):
    from quarry.queries import queries

    assert "Broadcast" not in queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_few_chunks_are_python_values_at_a_time(spark):
    """A batch of thousands of chunks is not turned into Python values as a whole."""
    def held(batch_rows):
        seen = []

        class Batch:
            num_rows = batch_rows

            def slice(self, start, n):
                seen.append(min(n, batch_rows - start))
                return self

            def to_pylist(self):
                return [{"chunk": i, "n": 1} for i in range(seen[-1])] if seen else [{"chunk": i, "n": 1} for i in range(batch_rows)]

        class Rows:
            sparkSession = spark

            def mapInArrow(self, run, schema):
                return [b.num_rows for b in run([Batch()])]

        return K.each_chunk(Rows(), lambda n: {"n": n}, "n int")

    made = held(1000)
    assert sum(made) == 1000 and max(made) <= K.AT_ONCE and held(0) == []
