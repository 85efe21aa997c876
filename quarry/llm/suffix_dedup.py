"""Repeated byte strings by sampled anchors and hashes of ever longer stretches.

Every string of LENGTH bytes that also starts earlier is to go.  As in a depth-limited radix
sort, groups are refined over ever longer stretches up to LENGTH bytes, and after each pass
what is alone in its group is dropped; the groups of the last pass are exactly the repeated
strings.  But no suffix is sorted: all suffixes of 0.5 GB are 0.5 billion rows, far over what
the disks may hold, so one position in about forty stands for the strings around it.

1. Digit of ANCHOR bytes.  A string is represented by the anchor, of all positions in it,
   whose next ANCHOR bytes hash lowest.  Equal strings have equal anchors at equal places, and
   neighbouring strings mostly share theirs, so only one suffix in about forty takes part.
2. Digit of a whole block: the stretch of strings with one anchor.  Equal blocks are equal
   string by string, so all but the block's first document are settled with one row.
3. Digit of SIDE bytes: the anchor with as many bytes before or behind it that every string
   of the block has one of the two.  Only first documents of blocks take part from here on.
4. Digit of LENGTH bytes: the single strings around those sides that different blocks share.

Groups are formed by hashes of 64 bits.  The least document of each group is found with
partial minima on the map side, so no group, however large, is gathered in one task.  Texts
are moved once, into a table bucketed by document that the later passes read in place.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import row_key, shuffles_dropped, table, whole_text, written

LENGTH, ANCHOR = 100, 24
#: Bytes on one side of the anchor: a string has that many before it, or else behind it.
HALF = (LENGTH - ANCHOR) // 2
#: Bytes of text that are worked on at a time; longer texts are taken in pieces.
PIECE = 1 << 18
_POSITION = np.uint64((1 << 20) - 1)
_RNG = np.random.default_rng(3)
_LETTER = [_RNG.integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + _RNG.integers(0, 2, 256).astype(np.uint64) for _ in range(2)]
_BASE = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]
_SALT = np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the bases and of their inverses modulo 2**64, made when a worker first needs them."""

    up: list[np.ndarray] = []
    down: list[np.ndarray] = []

    @classmethod
    def get(cls):
        if not cls.up:
            n = PIECE + LENGTH
            cls.up = [_powers(b, n) for b in _BASE]
            cls.down = [_powers(pow(b, -1, 1 << 64), n) for b in _BASE]
        return cls.up, cls.down


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _SALT
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class Piece:
    """Some bytes with the texts that they belong to, and hashes of any stretch of them."""

    def __init__(self, data: np.ndarray, at: int, bounds: np.ndarray, docs: np.ndarray, offset: int):
        """bounds: where the texts start and end in data; docs: their numbers; offset: of data in a text that is longer; at: of data in the batch."""
        self.data, self.at, self.bounds, self.docs, self.offset = data, at, bounds, docs, offset
        up, self.down = _Powers.get()
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[k][data] * up[k][: len(data)], dtype=np.uint64)]) for k in range(2)]

    def _raw(self, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[k][end] - self.sums[k][start]) * self.down[k][start]

    def key(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed(_mixed(self._raw(0, start, end)) + self._raw(1, start, end) + (end - start).astype(np.uint64)).view(np.int64)

    def anchors(self) -> tuple[np.ndarray, ...]:
        """For each block: its document's number, first and last string's start, its anchor's hash and place."""
        n, width = len(self.data), LENGTH - ANCHOR + 1
        if n < LENGTH:
            return (np.zeros(0, np.int64),) * 5
        s = self.sums[0]
        digit = _mixed((s[ANCHOR:] - s[:-ANCHOR]) * self.down[0][: n - ANCHOR + 1])
        low = digit & ~_POSITION | np.arange(len(digit), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[: n - LENGTH + 1], low[width - size : width - size + n - LENGTH + 1])
        inside = np.zeros(n + 1, np.int32)
        starts, ends = self.bounds[:-1], self.bounds[1:]
        long = ends - starts >= LENGTH
        np.add.at(inside, starts[long], 1)
        np.add.at(inside, ends[long] - LENGTH + 1, -1)
        place = np.flatnonzero(np.cumsum(inside)[: n - LENGTH + 1])
        if not len(place):
            return (np.zeros(0, np.int64),) * 5
        where = (low[place] & _POSITION).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        first, last = place[new], place[np.concatenate([new[1:], [len(place)]]) - 1]
        return self.docs[np.searchsorted(self.bounds, first, "right") - 1], first, last, digit[where[new]].view(np.int64), where[new]


def regions(column: pa.Array) -> Iterator[list[Piece]]:
    """The texts of a column in order, some at a time, or a long one in pieces that share LENGTH - 1 bytes."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
        lo, hi = offsets[i], offsets[j]
        if hi - lo <= PIECE:
            yield [Piece(data[lo:hi], lo, offsets[i : j + 1] - lo, np.arange(i, j), 0)]
        else:
            yield [Piece(data[at : min(hi, at + PIECE)], at, np.array([0, min(hi, at + PIECE) - at]), np.array([i]), at - lo) for at in range(lo, hi - LENGTH + 1, PIECE - LENGTH + 1)]
        i = j


def _of(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keys that hold within one document only."""
    return _mixed(key.view(np.uint64) + doc.astype(np.uint64) * _SALT)


def _among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    wanted = np.unique(wanted)
    if not len(wanted):
        return np.zeros(len(keys), bool)
    return wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys


def _flat(column: pa.ListArray, docs: slice | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row of the batch, value) of all lists of a column."""
    column = column.fill_null([]) if column.null_count else column
    sizes = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _block_rows(region: list[Piece]) -> tuple[np.ndarray, ...]:
    """As `Piece.anchors` over a region, with the block's key and the piece that the places are in."""
    out = []
    for k, p in enumerate(region):
        doc, first, last, digit, place = p.anchors()
        out.append((doc, first, last, digit, place, p.key(first, last + LENGTH), np.full(len(doc), k)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sides(region: list[Piece], rows: tuple[np.ndarray, ...], keep: np.ndarray) -> list[pa.Array]:
    """Keys of the stretches before and behind the kept anchors, null where no string of the block has that one."""
    _, first, last, _, place, _, piece = (x[keep] for x in rows)
    before, behind = np.zeros((2, len(keep)), np.int64)
    has_before, has_behind = place - first >= HALF, place - last < HALF
    for k, p in enumerate(region):
        b, e = np.flatnonzero(has_before & (piece == k)), np.flatnonzero(has_behind & (piece == k))
        before[b] = p.key(place[b] - HALF, place[b] + ANCHOR)
        behind[e] = ~p.key(place[e], place[e] + ANCHOR + HALF)
    return [pa.array(before, mask=~has_before), pa.array(behind, mask=~has_behind)]


def anchor_rows(docs: DataFrame) -> DataFrame:
    """``digit, doc_id, n``: each anchor of each document, n being 2 if the document has it more than once."""

    def run(batches):
        for batch in batches:
            for region in regions(batch.column(1)):
                doc, digit = (_block_rows(region)[i] for i in (0, 3))
                order = np.lexsort((digit, doc))
                doc, digit = doc[order], digit[order]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (digit[1:] != digit[:-1])])) if len(doc) else np.zeros(0, int)
                n = np.minimum(np.diff(np.concatenate([new, [len(doc)]])), 2)
                yield pa.RecordBatch.from_arrays([pa.array(digit[new]), batch.column(0).take(pa.array(doc[new])), pa.array(n.astype(np.int64))], ["digit", "doc_id", "n"])

    return docs.mapInArrow(run, f"digit bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint")


def block_rows(crowded: DataFrame) -> DataFrame:
    """``block, before, behind, doc_id``: the blocks of each document at anchors that occur elsewhere, with their sides."""

    def run(batches):
        for batch in batches:
            wanted = _flat(batch.column(2))[1]
            for region in regions(batch.column(1)):
                rows = _block_rows(region)
                doc, digit, block = rows[0], rows[3], rows[5]
                keep = np.flatnonzero(_among(digit, wanted))
                keep = keep[np.unique(_of(doc[keep], block[keep]), return_index=True)[1]]
                yield pa.RecordBatch.from_arrays([pa.array(block[keep]), *_sides(region, rows, keep), batch.column(0).take(pa.array(doc[keep]))], ["block", "before", "behind", "doc_id"])

    return crowded.select("doc_id", "body", "anchors").mapInArrow(run, f"block bigint, before bigint, behind bigint, doc_id {crowded.schema['doc_id'].dataType.simpleString()}")


def _single_strings(region: list[Piece], rows: tuple[np.ndarray, ...], before: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start in the batch, key) of the strings around the chosen sides of blocks."""
    doc, first, last, _, place, _, piece = rows
    lo, hi = np.where(before, first, np.maximum(first, place - HALF + 1)), np.where(behind, last, np.minimum(last, place - HALF))
    out = []
    for k, p in enumerate(region):
        mine = np.flatnonzero((before | behind) & (piece == k))
        sizes = hi[mine] - lo[mine] + 1
        start = np.repeat(lo[mine] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        out.append((np.repeat(doc[mine], sizes), start + p.at, p.key(start, start + LENGTH)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def string_rows(owners: DataFrame) -> DataFrame:
    """``string, doc_id``: the strings around the sides in ``before`` and ``behind``, which list blocks."""

    def run(batches):
        for batch in batches:
            before, behind = (_of(*_flat(batch.column(i))) for i in (2, 3))
            for region in regions(batch.column(1)):
                rows = _block_rows(region)
                mine = _of(rows[0], rows[5])
                doc, _, key = _single_strings(region, rows, _among(mine, before), _among(mine, behind))
                keep = np.unique(_of(doc, key), return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(key[keep]), batch.column(0).take(pa.array(doc[keep]))], ["string", "doc_id"])

    return owners.select("doc_id", "body", "before", "behind").mapInArrow(run, f"string bigint, doc_id {owners.schema['doc_id'].dataType.simpleString()}")


def _again(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which of the rows, in order, repeat one of the same document."""
    out = np.ones(len(doc), bool)
    out[np.unique(_of(doc, key), return_index=True)[1]] = False
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _bounds(region: list[Piece]) -> np.ndarray:
    """Where the region's texts start and end, from its first byte on."""
    return region[0].bounds if len(region) == 1 else np.array([0, region[-1].at + len(region[-1].data) - region[0].at])


def _bytes(region: list[Piece]) -> np.ndarray:
    """The region's bytes; pieces of a long text share their ends."""
    step = PIECE - LENGTH + 1
    return np.concatenate([p.data[:step] for p in region[:-1]] + [region[-1].data])


def remaining(settled: DataFrame) -> DataFrame:
    """``doc_id, row_key, spans, kept``: what is removed from each text, as byte offsets, and the bytes that are left."""

    def run(batches):
        for batch in batches:
            covered, before, behind, late = (_of(*_flat(batch.column(i))) for i in (3, 4, 5, 6))
            for region in regions(batch.column(2)):
                rows = _block_rows(region)
                doc, first, last, _, _, block, piece = rows
                start_of, bounds = region[0].at, _bounds(region)
                at = np.array([p.at - start_of for p in region])[piece]
                marks = np.zeros(bounds[-1] + 1, np.int32)
                mine = _of(doc, block)
                gone = _among(mine, covered) | _again(doc, block)
                np.add.at(marks, (first + at)[gone], 1)
                np.add.at(marks, (last + at)[gone] + LENGTH, -1)
                of, start, key = _single_strings(region, rows, ~gone & _among(mine, before), ~gone & _among(mine, behind))
                out = _among(_of(of, key), late) | _again(of, key)
                np.add.at(marks, start[out] - start_of, 1)
                np.add.at(marks, start[out] - start_of + LENGTH, -1)
                removed = np.cumsum(marks, dtype=np.int32)[:-1] > 0
                data = _bytes(region)
                spans, kept = [], []
                for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                    r = removed[lo:hi]
                    turns = np.flatnonzero(np.diff(np.concatenate([[False], r, [False]]).astype(np.int8)))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(turns[::2], turns[1::2], strict=True)])
                    kept.append(data[lo:hi][~r].tobytes())
                own = slice(region[0].docs[0], region[0].docs[-1] + 1)
                yield pa.RecordBatch.from_arrays([batch.column(0)[own], batch.column(1)[own], pa.array(spans, SPANS), pa.array(kept, pa.binary())], ["doc_id", "row_key", "spans", "kept"])

    kind = settled.schema["doc_id"].dataType.simpleString()
    return settled.select("doc_id", "row_key", "body", "covered", "before", "behind", "late").mapInArrow(run, f"doc_id {kind}, row_key bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def _bucketed(df: DataFrame, name: str) -> DataFrame:
    """df as a table bucketed by document, so that later joins on doc_id do not move it."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").format("parquet").saveAsTable(name)
    return spark.table(name)


def repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row_key, spans, kept`` of the documents that may lose something.

    A byte goes if a string of LENGTH bytes around it also starts earlier: in a document
    with a smaller id, or further ahead in the same one.  Strings are judged on the input;
    matches never cross documents; shorter texts are left whole, and so are null texts and
    rows without an id.  Rows that share an id are neither before nor behind each other.
    Repeated rows are told once.  An empty table gives no rows; extra columns are ignored.
    """
    rows = docs.filter(F.col(id_col).isNotNull() & (F.octet_length(text_col) >= LENGTH)).select(F.col(id_col).alias("doc_id"), row_key(F.col(text_col)).alias("row_key"), F.col(text_col).alias("body"))
    anchors = anchor_rows(rows.select("doc_id", "body"))
    crowd = anchors.groupBy("digit").agg(F.sum("n").alias("n")).filter("n > 1").select("digit")
    here = anchors.join(crowd, "digit", "left_semi").groupBy("doc_id").agg(F.collect_list("digit").alias("anchors"))
    texts = _bucketed(rows.join(here, "doc_id"), "suffix_texts")

    blocks = written(block_rows(texts), "suffix-blocks")
    owned = written(blocks.groupBy("block", "before", "behind").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n")), "suffix-owned")
    again = blocks.select("block", "doc_id").join(owned.filter("n > 1").select("block", "owner"), "block").filter("doc_id != owner")
    again = written(again.groupBy("doc_id").agg(F.collect_set("block").alias("covered")), "suffix-covered")

    side = F.explode(F.array(F.struct(F.lit(False).alias("is_behind"), F.col("before").alias("key")), F.struct(F.lit(True).alias("is_behind"), F.col("behind").alias("key"))))
    sides = owned.select("block", F.col("owner").alias("doc_id"), side.alias("s")).select("block", "doc_id", "s.*").filter("key IS NOT NULL")
    several = sides.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    mixed = sides.join(several, "key", "left_semi").groupBy("doc_id").agg(
        F.collect_set(F.when(~F.col("is_behind"), F.col("block"))).alias("before"), F.collect_set(F.when(F.col("is_behind"), F.col("block"))).alias("behind")
    )
    mixed = written(mixed, "suffix-mixed")

    strings = written(string_rows(texts.join(mixed, "doc_id")), "suffix-strings")
    least = strings.groupBy("string").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("string", "owner")
    late = strings.join(least, "string").filter("doc_id != owner").groupBy("doc_id").agg(F.collect_set("string").alias("late"))
    settled = texts.join(again, "doc_id", "left").join(mixed, "doc_id", "left").join(written(late, "suffix-late"), "doc_id", "left")
    return remaining(settled)


def op3_suffix_array_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = repeated_strings(docs).select("doc_id", "row_key", F.size("spans").cast("long").alias("spans"), F.octet_length("kept").cast("long").alias("left"), F.sha2("kept", 256).alias("sha"))
    found = written(found, "suffix-found").dropDuplicates(["doc_id", "row_key"])
    text = whole_text("text")
    rows = docs.select("doc_id", row_key(text).alias("row_key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    out = rows.join(found, ["doc_id", "row_key"], "left")
    return out.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.coalesce("left", "n_bytes")).alias("n_removed"), F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("sha", "whole").alias("kept_sha256"),
    )
