"""Lightweight column codecs as DataFrame transforms, in expressions that stay in the JVM.

An encoded column has a row per chunk of CHUNK values: its number, how many values it has,
and the codec's components.  ``*_encode`` take such chunks of plain values (`chunked`),
``*_decode`` give back an array ``vals``, which `unchunked` turns into rows again.  Nothing
is shuffled between the two, a chunk is decoded by itself, and its size is bounded.  Encoded
chunks are meant to be stored; joined into one plan with its encoder, a decoder's look-ups
would each repeat the encoder's work.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.errors import InvalidData
from quarry.functions.types import decimal_from_unscaled, wrapped

CHUNK = 1024
#: The order of the eight rows of lanes in a block of 1024 values.
LANE_ORDER = (0, 4, 2, 6, 1, 5, 3, 7)


def chunked(rows: DataFrame, value: str, row: str = "row_offset") -> DataFrame:
    """``chunk, n, vals``: values by physical position, nulls among them."""
    chunk = F.floor(F.col(row) / CHUNK).cast("bigint")
    lists = rows.groupBy(chunk.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct(F.col(row).alias("row"), F.col(value).alias("v")))).alias("rows"))
    return lists.select("chunk", F.size("rows").alias("n"), F.transform("rows", lambda x: x["v"]).alias("vals"))


def unchunked(decoded: DataFrame, name: str) -> DataFrame:
    """``row_offset, <name>`` of every value."""
    each = decoded.select("chunk", F.posexplode("vals").alias("pos", name))
    return each.select((F.col("chunk") * CHUNK + F.col("pos")).alias("row_offset"), name)


def zipped(fields: dict[str, DataFrame]) -> DataFrame:
    """``chunk, vals`` with the structs of fields that were coded apart.

    Fields meet chunk by chunk and are told apart from rows only afterwards.  The join is
    sorted: encoded files are so much smaller than what they decode to that Spark would take
    one side for small, and broadcast all its values.
    """
    (first, out), *rest = [(name, df.select("chunk", F.col("vals").alias(f"__{i}"))) for i, (name, df) in enumerate(fields.items())]
    for _, df in rest:
        out = out.hint("merge").join(df, "chunk")
    names = [first, *[name for name, _ in rest]]
    same = reduce(lambda a, b: a & b, [F.size(f"__{i}") == F.size("__0") for i in range(len(names))])
    parts = [F.col(f"__{i}").alias(name) for i, name in enumerate(names)]
    return out.select("chunk", require(same, F.arrays_zip(*parts), "fields of different lengths").alias("vals"))


def require(ok: Column, value: Column, what: str) -> Column:
    """value where ok holds; else the query fails, as encoded data that breaks its rules must not be read on."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(f"invalid data: {what}")).cast("void"))


def positions(n: Column | str) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


# null, constant, masked, struct


def null_decode(chunks: DataFrame, kind: str) -> DataFrame:
    return chunks.select("chunk", F.array_repeat(F.lit(None).cast(kind), F.col("n")).alias("vals"))


def constant_encode(chunks: DataFrame) -> DataFrame:
    """Only chunks of one value have this form; others fail."""
    first = F.get("vals", F.lit(0))
    return chunks.select("chunk", "n", require(F.forall("vals", lambda v: v.eqNullSafe(first)), first, "a chunk of several values is not constant").alias("value"))


def constant_decode(coded: DataFrame) -> DataFrame:
    return coded.select("chunk", F.array_repeat("value", F.col("n")).alias("vals"))


def masked_encode(chunks: DataFrame, fill: Column) -> DataFrame:
    return chunks.select("chunk", "n", F.transform("vals", lambda v: F.coalesce(v, fill)).alias("payload"), F.transform("vals", lambda v: v.isNotNull()).alias("valid"))


def masked_decode(coded: DataFrame, kind: str) -> DataFrame:
    return coded.select("chunk", F.zip_with("payload", "valid", lambda v, ok: F.when(ok, v.cast(kind))).alias("vals"))


# dictionary


def dict_encode(chunks: DataFrame) -> DataFrame:
    distinct = F.array_compact(F.array_distinct("vals"))
    code = lambda v: F.when(v.isNotNull(), (F.array_position("values", v) - 1).cast("int"))
    return chunks.withColumn("values", distinct).select("chunk", "n", "values", F.transform("vals", code).alias("codes"))


def dict_decode(coded: DataFrame) -> DataFrame:
    """A null code is a null value, whatever else it has; a code outside the values is invalid."""
    at = lambda c: F.when(
        c.isNotNull(), require((c >= 0) & (c < F.size("values")), F.get("values", c), "a code without a value")
    )
    return coded.select("chunk", F.transform("codes", at).alias("vals"))


def layout_dict_encode(rows: DataFrame, value: str, row: str = "row_offset") -> tuple[DataFrame, DataFrame]:
    """(codes by row, values by code) with one dictionary for the whole column; codes are hashes of the values."""
    values = rows.filter(F.col(value).isNotNull()).select(F.xxhash64(value).alias("code"), F.col(value).alias("value")).distinct()
    return rows.select(F.col(row).alias("row_offset"), F.when(F.col(value).isNotNull(), F.xxhash64(value)).alias("code")), values


def layout_dict_decode(codes: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """A join, which Spark broadcasts if it knows the values to be small."""
    met = codes.join(values.withColumn("known", F.lit(True)), "code", "left")
    return met.select("row_offset", F.when(F.col("code").isNotNull(), require(F.col("known").isNotNull(), F.col("value"), "a code without a value")).alias(name))


# runs


def runend_encode(chunks: DataFrame) -> DataFrame:
    last = lambda i: (i == F.col("n") - 1) | ~F.get("vals", i).eqNullSafe(F.get("vals", i + 1))
    ends = chunks.withColumn("ends", F.transform(F.filter(positions("n"), last), lambda i: i + 1))
    return ends.select("chunk", "n", "ends", F.transform("ends", lambda e: F.get("vals", e - 1)).alias("values"))


def runend_decode(coded: DataFrame, offset: int = 0) -> DataFrame:
    """Ends must rise and cover the chunk; with an offset the first values are sliced away."""
    lengths = F.transform("ends", lambda e, i: e - F.when(i == 0, 0).otherwise(F.get("ends", i - 1)))
    runs = F.zip_with("values", lengths, lambda v, k: F.array_repeat(v, require(k > 0, k, "run ends that do not rise")))
    whole = require(F.coalesce(F.element_at("ends", -1), F.lit(0)) >= F.col("n") + offset, F.flatten(runs), "runs that end early")
    return coded.select("chunk", F.slice(whole, offset + 1, F.col("n")).alias("vals"))


def rle_encode(chunks: DataFrame) -> DataFrame:
    """Values of the chunk's runs, and for each position an index into them."""
    new = lambda i: (i == 0) | ~F.get("vals", i).eqNullSafe(F.get("vals", i - 1))
    starts = chunks.withColumn("starts", F.filter(positions("n"), lambda i: new(i) & F.get("vals", i).isNotNull()))
    index = lambda i: F.when(F.get("vals", i).isNotNull(), F.size(F.filter("starts", lambda s: s <= i)) - 1)
    return starts.select("chunk", "n", F.transform("starts", lambda s: F.get("vals", s)).alias("values"), F.transform(positions("n"), index).alias("indices"))


def rle_decode(coded: DataFrame) -> DataFrame:
    """A null index is a null value; a chunk of one value needs no index."""
    one = F.size("values") == 1
    at = lambda i: F.when(i.isNotNull(), F.when(one, F.get("values", F.lit(0))).otherwise(require(i < F.size("values"), F.get("values", i), "an index without a value")))
    return coded.select("chunk", F.transform("indices", at).alias("vals"))


def sequence_encode(chunks: DataFrame) -> DataFrame:
    """Only chunks that rise evenly have this form; others are an error."""
    step = F.coalesce(F.get("vals", F.lit(1)) - F.get("vals", F.lit(0)), F.lit(0))
    even = F.forall(positions("n"), lambda i: (i == 0) | (F.get("vals", i) - F.get("vals", i - 1) == step))
    return chunks.select("chunk", "n", F.get("vals", F.lit(0)).alias("base"), require(even, step, "a chunk that is no sequence").alias("step"))


def sequence_decode(coded: DataFrame) -> DataFrame:
    return coded.select("chunk", F.transform(positions("n"), lambda i: F.col("base") + i * F.col("step")).alias("vals"))


# patches


def sparse_encode(chunks: DataFrame, fill: Column) -> DataFrame:
    other = chunks.withColumn("indices", F.filter(positions("n"), lambda i: ~F.get("vals", i).eqNullSafe(fill)))
    return other.select("chunk", "n", fill.alias("fill"), "indices", F.transform("indices", lambda i: F.get("vals", i)).alias("patches"))


def patched(base: Column, indices: Column | str, patches: Column | str) -> Column:
    """base with the patches at their indices, which must rise; the null of a patch replaces too."""
    rising = F.forall(F.sequence(F.lit(0), F.size(indices)), lambda i: (i == 0) | (i >= F.size(indices)) | (F.get(indices, i) > F.get(indices, i - 1)))
    put = F.transform(base, lambda v, i: F.when(F.array_contains(indices, i), F.get(patches, (F.array_position(indices, i) - 1).cast("int"))).otherwise(v))
    return require(rising, put, "patches out of order")


def running(sizes: Column | str) -> Column:
    """0 and the sums so far, one more than there are sizes."""
    return F.aggregate(sizes, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def sparse_decode(coded: DataFrame) -> DataFrame:
    return coded.select("chunk", patched(F.array_repeat("fill", F.col("n")), "indices", "patches").alias("vals"))


# integers


def for_encode(chunks: DataFrame) -> DataFrame:
    """Frame of reference: differences from the least value."""
    based = chunks.withColumn("base", F.array_min("vals"))
    return based.select("chunk", "n", "base", F.transform("vals", lambda v: v - F.col("base")).alias("residuals"))


def for_decode(coded: DataFrame) -> DataFrame:
    """The sum wraps at 64 bits."""
    return coded.select("chunk", F.transform("residuals", lambda r: wrapped(r.cast("decimal(38,0)") + F.col("base"))).alias("vals"))


def zigzag_encode(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk", "n", F.transform("vals", lambda v: F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))).alias("folded"))


def zigzag_decode(coded: DataFrame) -> DataFrame:
    return coded.select("chunk", F.transform("folded", lambda x: F.shiftrightunsigned(x, 1).bitwiseXOR(-x.bitwiseAND(F.lit(1)))).alias("vals"))


def lane_position(index: Column) -> tuple[Column, Column, Column]:
    """(lane, row in the lane, logical position) of a stored position in a block of 1024 64-bit values."""
    lane = index % 16
    row = F.element_at(F.array(*[F.lit(i) for i in LANE_ORDER]), ((index / 16).cast("int") % 8) + 1) * 8 + (index / 128).cast("int")
    return lane, row, lane * 64 + row


def delta_encode(chunks: DataFrame) -> DataFrame:
    """Differences along each of 16 lanes, stored by row of lanes; a chunk that is not full is one lane."""
    each = chunks.select("chunk", "n", F.posexplode("vals").alias("pos", "v"))
    full = F.col("n") == CHUNK
    lane = F.when(full, (F.col("pos") / 64).cast("int")).otherwise(0)
    along = Window.partitionBy("chunk", "lane").orderBy("pos")
    # the stored place of lane and row: rows 8 apart follow each other in LANE_ORDER, single rows are 128 apart
    row = F.col("pos") % 64
    place = lane + F.element_at(F.array(*[F.lit(LANE_ORDER.index(i)) for i in range(8)]), (row / 8).cast("int") + 1) * 16 + (row % 8) * 128
    diff = each.withColumn("lane", lane).withColumn("before", F.lag("v").over(along)).withColumn("place", F.when(full, place).otherwise(F.col("pos")))
    diff = diff.withColumn("d", F.when(F.col("before").isNull(), F.lit(0).cast("bigint")).otherwise(wrapped(F.col("v").cast("decimal(38,0)") - F.col("before"))))
    bases = F.transform(F.sort_array(F.collect_list(F.when(F.col("before").isNull(), F.struct("lane", "v")))), lambda x: x["v"])
    deltas = F.transform(F.sort_array(F.collect_list(F.struct("place", "d"))), lambda x: x["d"])
    return diff.groupBy("chunk", "n").agg(bases.alias("bases"), deltas.alias("deltas"))


def delta_decode(coded: DataFrame) -> DataFrame:
    """Running sums along the lanes, wrapping at 64 bits."""
    each = coded.select("chunk", "n", "bases", F.posexplode("deltas").alias("index", "d"))
    lane, row, pos = lane_position(F.col("index"))
    full = F.col("n") == CHUNK
    each = each.select(
        "chunk", F.when(full, pos).otherwise(F.col("index")).alias("pos"), F.when(full, row).otherwise(F.col("index")).alias("row"),
        F.when(full, lane).otherwise(0).alias("lane"), F.get("bases", F.when(full, lane).otherwise(0)).alias("base"), "d",
    )
    along = Window.partitionBy("chunk", "lane").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = each.withColumn("v", wrapped(F.col("base").cast("decimal(38,0)") + F.sum(F.col("d").cast("decimal(28,0)")).over(along)))
    return sums.groupBy("chunk").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("vals"))


# floats, decimals, times


def _power(e: int) -> Column:
    return F.expr(f"1e{e}D")


def alp_encode(chunks: DataFrame, exponent: int, factor: int) -> DataFrame:
    """Integers that two multiplications turn back into the doubles; doubles that do not come back, and nulls, are patches."""
    ints = lambda v: F.coalesce(F.round(v * _power(exponent) * _power(-factor)).try_cast("bigint"), F.lit(0).cast("bigint"))
    back = lambda k: k.cast("double") * _power(factor) * _power(-exponent)
    tried = chunks.withColumn("ints", F.transform("vals", ints))
    missed = tried.withColumn("indices", F.filter(positions("n"), lambda i: ~back(F.get("ints", i)).eqNullSafe(F.get("vals", i))))
    return missed.select(
        "chunk", "n", F.lit(exponent).alias("e"), F.lit(factor).alias("f"), "ints",
        "indices", F.transform("indices", lambda i: F.get("vals", i)).alias("patches"),
    )


def alp_decode(coded: DataFrame, exponent: int, factor: int) -> DataFrame:
    """Multiplied in this order; one multiplication by the quotient would round differently."""
    back = F.transform("ints", lambda k: k.cast("double") * _power(factor) * _power(-exponent))
    return coded.select("chunk", patched(back, "indices", "patches").alias("vals"))


def decimal_parts_decode(coded: DataFrame, precision: int, scale: int) -> DataFrame:
    return coded.select("chunk", F.transform("parts", lambda x: decimal_from_unscaled(x, precision, scale)).alias("vals"))


def datetime_parts_encode(chunks: DataFrame) -> DataFrame:
    """Days, seconds of the day and microseconds of the second; days carry the nulls."""
    day, second = 86_400_000_000, 1_000_000
    ticks = F.transform("vals", lambda t: F.unix_micros(t.cast("timestamp")))
    with_ticks = chunks.withColumn("ticks", ticks)
    return with_ticks.select(
        "chunk", "n",
        F.transform("ticks", lambda t: F.floor(t / F.lit(day)).cast("bigint")).alias("days"),
        F.transform("ticks", lambda t: F.floor(F.pmod(t, F.lit(day)) / F.lit(second)).cast("bigint")).alias("seconds"),
        F.transform("ticks", lambda t: F.pmod(t, F.lit(second)).cast("bigint")).alias("subseconds"),
    )


def datetime_parts_decode(coded: DataFrame) -> DataFrame:
    micros = F.transform(
        F.arrays_zip("days", "seconds", "subseconds"), lambda p: p["days"] * F.lit(86_400_000_000) + p["seconds"] * F.lit(1_000_000) + p["subseconds"]
    )
    return coded.select("chunk", F.transform(micros, lambda m: F.timestamp_micros(m).cast("timestamp_ntz")).alias("vals"))


# strings


def varbin_encode(chunks: DataFrame) -> DataFrame:
    """All bytes in one, with offsets one more than values."""
    sizes = chunks.withColumn("sizes", F.transform("vals", lambda v: F.coalesce(F.octet_length(v), F.lit(0))))
    return sizes.select("chunk", "n", running("sizes").alias("offsets"), F.encode(F.array_join("vals", ""), "UTF-8").alias("data"), F.transform("vals", lambda v: v.isNotNull()).alias("valid"))


def varbin_decode(coded: DataFrame) -> DataFrame:
    """Offsets are checked on every row, null or not."""
    def value(i):
        lo, hi = F.get("offsets", i), F.get("offsets", i + 1)
        ok = (lo >= 0) & (lo <= hi) & (hi <= F.octet_length("data"))
        text = F.decode(F.substring(F.col("data"), lo + 1, require(ok, hi - lo, "offsets that do not fit the data")), "UTF-8")
        return F.when(F.get("valid", i), text)

    return coded.select("chunk", F.transform(positions("n"), value).alias("vals"))


def tokens_encode(chunks: DataFrame, splits: str = r"(?<=[ _#])|(?=[ _#])") -> DataFrame:
    """A dictionary of string pieces, all codes of a chunk in one list, and where each value's codes end."""
    parts = chunks.withColumn("pieces", F.transform("vals", lambda v: F.coalesce(F.filter(F.split(v, splits), lambda p: p != ""), F.array().cast("array<string>"))))
    parts = parts.withColumn("tokens", F.array_distinct(F.flatten("pieces")))
    codes = F.transform(F.flatten("pieces"), lambda p: (F.array_position("tokens", p) - 1).cast("int"))
    bounds = running(F.transform("pieces", lambda p: F.size(p)))
    return parts.select("chunk", "n", "tokens", codes.alias("codes"), bounds.alias("bounds"), F.transform("vals", lambda v: v.isNotNull()).alias("valid"))


def tokens_decode(coded: DataFrame) -> DataFrame:
    def value(i):
        mine = F.slice("codes", F.get("bounds", i) + 1, F.get("bounds", i + 1) - F.get("bounds", i))
        text = F.array_join(F.transform(mine, lambda c: require(c < F.size("tokens"), F.get("tokens", c), "a code without a token")), "")
        return F.when(F.get("valid", i), text)

    return coded.select("chunk", F.transform(positions("n"), value).alias("vals"))


def check_not_null(decoded: DataFrame) -> DataFrame:
    """Fails on a null in a column that may not have any."""
    if "vals" not in decoded.columns:
        raise InvalidData("there are no values to check")
    return decoded.withColumn("vals", F.transform("vals", lambda v: require(v.isNotNull(), v, "a null in a column without nulls")))
