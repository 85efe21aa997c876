"""Near dedup by an inverted join over MinHash signature coordinates.

A document's distinct word shingles give a signature of minima under COORDS hash functions.
Documents with one and the same set are one node.  Nodes are posted under each pair of
coordinate and value; two sets of similarity s agree on a binomial number of coordinates,
and pairs below the match threshold (missed by links with odds of under MISSED) are never
looked at:

* Prefix: posting lists are ordered by length.  Two nodes with enough matches share one of
  each other's few shortest lists, so a node is only listed there; a node with too few
  lists in company is dropped.  The long lists of frequent values are skipped over.
* Bounds: the shingles that no other listed node has are counted for each.  They bound the
  intersection of any pair, and rule out most of the many pairs of texts that come from one
  source but have each been changed too much.
* Merging: a list is not expanded into all its pairs.  Its members are first compared with
  the list's leader, the member with the fewest shingles of its own.  Of lists that this does
  not connect, each member is then described by its difference from the leader, the shingles
  that one of the two has and the other lacks.  For sets A and B with differences P and Q,
  |A ^ B| = |P| + |Q| - 2 |P & Q|, so two members that are not both linked with the leader can
  only be linked if they have some of their differences in common, and how many is known
  beforehand.  Differences are few and, other than the shingles of a common source, they
  are rare; so they are posted in turn, rarest first, and pairs that meet there are bounded
  by the number of differences that a sketch of 256 bits lets them share.  Here too members are
  first compared with one of each list, and only what is not connected then with each other.

A pair that is left is confirmed on the two full shingle sets.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import portions
from quarry.llm.components import components
from quarry.llm.shared import table, whole_text, written

WORDS, PERCENT = 5, 80
COORDS, MISSED, SEED = 64, 1e-5, 11
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def least_matches(percent: int, coords: int = COORDS, missed: float = MISSED) -> int:
    """The most matches to ask for, so that a pair of that similarity falls short with odds of at most missed."""
    s, below, m = percent / 100, 0.0, 0
    while below + (p := comb(coords, m) * s**m * (1 - s) ** (coords - m)) <= missed:
        below += p
        m += 1
    return max(1, m)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[1]
    return x ^ (x >> np.uint64(29))


def shingles(text: str, n_words: int) -> np.ndarray:
    """The set of word shingles as sorted 64-bit hashes: words between blanks and the other ASCII space, A-Z in lower case.

    A text of fewer words, but not none, is one shingle.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n_words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mixed(out * _MIX[0] + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def signature(s: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    out = np.full(len(factors), 0xFFFFFFFF, np.uint64)
    for lo in range(0, len(s), 1024):
        out = np.minimum(out, ((s[lo : lo + 1024, None] * factors + shifts) >> np.uint64(32)).min(axis=0))
    return out


def sign(docs: DataFrame, n_words: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_shingles, set_hi, set_lo, signature``: the set's size and 128-bit digest, and the minima."""
    kind = docs.schema[id_col].dataType.simpleString()
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 1 << 63, COORDS).astype(np.uint64) << np.uint64(1) | np.uint64(1)
    shifts = rng.integers(0, 1 << 63, COORDS).astype(np.uint64)

    def run(batches):
        for batch in batches:
            for part, texts in portions(batch.column(1)):
                sets = [shingles(t, n_words) for t in texts]
                digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), ">i8").astype(np.int64).reshape(-1, 2)
                minima = np.concatenate([signature(s, factors, shifts) for s in sets]).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part.start : part.stop], pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * COORDS), pa.array(minima)),
                    ],
                    ["doc_id", "n_shingles", "set_hi", "set_lo", "signature"],
                )

    rows = docs.select(F.col(id_col), whole_text(text_col).alias("body"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, set_hi bigint, set_lo bigint, signature array<int>")


def full_sets(docs: DataFrame, nodes: DataFrame, n_words: int, id_col: str, text_col: str) -> DataFrame:
    """``node, members``: the whole shingle sets of the wanted nodes."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part, texts in portions(batch.column(1)):
                sets = [shingles(t, n_words) for t in texts]
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part.start : part.stop], pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], ["node", "members"]
                )

    rows = docs.select(F.col(id_col).alias("node"), whole_text(text_col).alias("body")).join(nodes, "node", "left_semi")
    return rows.mapInArrow(run, f"node {kind}, members array<bigint>")


def prefix_lists(nodes: DataFrame, least: int) -> DataFrame:
    """``posting, node``: each node under its rarest coordinate values, as many as two nodes with enough matches need to meet."""
    posted = nodes.select("node", F.posexplode("signature").alias("coord", "value")).select(
        "node", (F.shiftleft(F.col("coord").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("posting")
    )
    shared = posted.groupBy("posting").agg(F.count(F.lit(1)).alias("length")).filter("length > 1")
    mine = posted.join(shared, "posting").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("length", "posting"))).alias("lists"))
    # lists of one are the shortest and hold no pair, so they use up places of the prefix
    return mine.filter(F.size("lists") >= least).select("node", F.explode(F.slice("lists", 1, F.size("lists") - least + 1)).alias("p")).select("p.posting", "node")


def own_shingles(sets: DataFrame) -> DataFrame:
    """``node, n, own``: the size of each set, and how many of its shingles no other set has."""
    counted = sets.select("node", F.explode("members").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node"))
    own = counted.filter("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    return sets.select("node", F.size("members").alias("n")).join(own, "node", "left").select("node", "n", F.coalesce("own", F.lit(0)).alias("own"))


def _possible(percent: int, n_y: str = "n_y", own_y: str = "own_y") -> Column:
    """Whether the sets of a pair, given by sizes and shingles of their own, may be similar enough."""
    common = F.least(F.col("n") - F.col("own"), F.col(n_y) - F.col(own_y))
    return common * 100 >= (F.col("n") + F.col(n_y) - common) * percent


def _open_lists(lists: DataFrame, percent: int) -> DataFrame:
    """The rows of lists that may have a partner in another component of the same list."""
    least = lists.groupBy("posting").agg(F.min("n").alias("least_n"), F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("posting", "least_n")
    shared = F.col("n") - F.col("own")
    partner = F.greatest("least_n", shared)
    return lists.join(least, "posting").filter(shared * 100 >= (F.col("n") + partner - shared) * percent).drop("least_n")


def _matching(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """The pairs ``a, b`` with enough equal coordinates."""
    both = pairs.join(nodes.select(F.col("node").alias("a"), F.col("signature").alias("sig_a")), "a")
    both = both.join(nodes.select(F.col("node").alias("b"), F.col("signature").alias("sig_b")), "b")
    equal = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda same: same))
    return both.filter(equal >= least).select("a", "b").distinct()


def differences(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """``leader, node, n, d, difference``: the size of each node's set, and what it and its leader's set do not have in common."""

    def run(batches):
        for batch in batches:
            (vx, ox), (vy, oy) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column(2), batch.column(3)))
            apart = [np.setxor1d(vx[ox[i] : ox[i + 1]], vy[oy[i] : oy[i + 1]], assume_unique=True) for i in range(len(batch))]
            d = np.array([len(x) for x in apart], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(np.diff(ox).astype(np.int64)), pa.array(d),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *d]).astype(np.int32)), pa.array(np.concatenate(apart) if apart else np.zeros(0, np.int64))),
                ],
                ["leader", "node", "n", "d", "difference"],
            )

    kind = sets.schema["node"].dataType.simpleString()
    both = groups.join(sets.select("node", F.col("members").alias("of_node")), "node").join(sets.select(F.col("node").alias("leader"), F.col("members").alias("of_leader")), "leader")
    return both.select("leader", "node", "of_node", "of_leader").mapInArrow(run, f"leader {kind}, node {kind}, n bigint, d bigint, difference array<bigint>")


SKETCH = ("b0", "b1", "b2", "b3")


def difference_lists(apart: DataFrame, percent: int) -> DataFrame:
    """``leader, posting, node, n, d, s, b0 .. b3``: nodes under the rarest of their differences from a leader.

    s counts those that another node of that leader has too, and the sketch has a bit for
    each of them.  A node needs at least `least` of them in common with whatever it is
    linked to (with n_y <= n * 100 / percent, and no more in common than d_y), so it is only
    posted under as many of the rarest as the rest would not be enough without.
    """
    posted = apart.select("leader", "node", "n", "d", F.explode("difference").alias("posting"))
    shared = posted.groupBy("leader", "posting").agg(F.count(F.lit(1)).alias("length")).filter("length > 1")
    at = F.col("posting").bitwiseAND(F.lit(255))
    bit = [F.bit_or(F.when(F.shiftright(at, 6) == k, F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(b) for k, b in enumerate(SKETCH)]
    mine = posted.join(shared, ["leader", "posting"]).groupBy("leader", "node", "n", "d").agg(F.count(F.lit(1)).alias("s"), F.sort_array(F.collect_list(F.struct("length", "posting"))).alias("lists"), *bit)
    mine = mine.withColumn("least", F.greatest(F.lit(1), F.ceil((F.col("d") * percent - F.col("n") * (100 - percent)) / percent))).filter("s >= least")
    return mine.select("leader", F.explode(F.slice("lists", F.lit(1), (F.col("s") - F.col("least") + 1).cast("int"))).alias("p"), "node", "n", "d", "s", *SKETCH).select("leader", "p.posting", "node", "n", "d", "s", *SKETCH)


def _reconcilable(percent: int) -> Column:
    """Whether a pair, in columns with and without _y, may have so many differences in common that it is linked."""
    lacks = lambda x, y: sum((F.bit_count(F.col(b + x).bitwiseAND(F.bitwise_not(F.col(b + y)))) for b in SKETCH), F.lit(0))
    common = F.least(F.col("s") - lacks("", "_y"), F.col("s_y") - lacks("_y", ""))
    return (F.col("d") + F.col("d_y") - common * 2) * (100 + percent) <= (F.col("n") + F.col("n_y")) * (100 - percent)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            (va, oa), (vb, ob) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column(2), batch.column(3)))
            keep = []
            for i in range(len(batch)):
                x, y = va[oa[i] : oa[i + 1]].view(np.uint64), vb[ob[i] : ob[i + 1]].view(np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    kind = sets.schema["node"].dataType.simpleString()
    near = pairs.join(sets.select(F.col("node").alias("b"), F.col("members").alias("of_b")), "b")
    near = near.join(sets.select(F.col("node").alias("a"), F.col("members").alias("of_a")), "a").select("a", "b", "of_a", "of_b")
    return near.mapInArrow(run, f"a {kind}, b {kind}")


def _edges(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("node").alias("a"), F.col("component").alias("b"))


def near_duplicates(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest id that links lead to, and the row with it is kept.

    Texts without words (null and empty ones too) have no shingles and are linked with
    nothing.  A null id is linked with nothing: its component_id is null, and it is kept.
    Rows that share an id are one document, linked with whatever any of them is.  An empty
    table gives no rows; extra columns are ignored.
    """
    least = least_matches(percent)
    signed = written(sign(docs, n_words, id_col, text_col), "minhash-signed")
    able = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(able.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("node")), "minhash-classes")
    first = able.alias("s").join(classes.alias("c"), F.expr("s.set_hi = c.set_hi AND s.set_lo = c.set_lo AND s.doc_id = c.node"), "left_semi")
    nodes = written(first.select(F.col("doc_id").alias("node"), "n_shingles", "signature").distinct(), "minhash-nodes")
    listed = prefix_lists(nodes, least)
    shared = listed.groupBy("posting").agg(F.count(F.lit(1)).alias("length")).filter("length > 1").select("posting")
    listed = written(listed.join(shared, "posting", "left_semi"), "minhash-listed")
    sets = written(full_sets(docs, written(listed.select("node").distinct(), "minhash-wanted"), n_words, id_col, text_col), "minhash-sets")
    sizes = written(own_shingles(sets), "minhash-sizes")
    lists = written(listed.join(sizes.filter((F.col("n") - F.col("own")) * 100 >= F.col("n") * percent), "node"), "minhash-lists")

    leaders = lists.groupBy("posting").agg(F.min(F.struct("own", "node", "n")).alias("l")).select("posting", F.col("l.node").alias("node_y"), F.col("l.n").alias("n_y"), F.col("l.own").alias("own_y"))
    pair = [F.least("node", "node_y").alias("a"), F.greatest("node", "node_y").alias("b")]
    to_leader = lists.join(leaders, "posting").filter("node != node_y").filter(_possible(percent)).select(*pair).distinct()
    links = written(_linked(written(_matching(to_leader, nodes, least), "minhash-pairs"), sets, percent), "minhash-links")
    joined = components(links, "minhash-stars")

    placed = lists.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = written(_open_lists(written(_open_lists(placed, percent), "minhash-torn"), percent), "minhash-torn")
    groups = placed.select("posting", "node").join(leaders.select("posting", F.col("node_y").alias("leader")), "posting").filter("node != leader").select("leader", "node").distinct()
    apart = written(differences(written(groups, "minhash-groups"), sets), "minhash-apart")
    listed = written(difference_lists(apart, percent), "minhash-differences")

    def placed_in(known: DataFrame) -> DataFrame:
        return listed.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))

    fields = ("node", "n", "d", "s", *SKETCH, "component")
    of_y = [F.col(c).alias(f"{c}_y") for c in fields]
    now = placed_in(joined)
    least_apart = now.groupBy("leader", "posting").agg(F.min(F.struct("d", *[c for c in fields if c != "d"])).alias("l")).select("leader", "posting", "l.*").select("leader", "posting", *of_y)
    to_least = now.join(least_apart, ["leader", "posting"]).filter((F.col("component") != F.col("component_y")) & _reconcilable(percent)).select(*pair).distinct()
    links = written(_linked(written(to_least, "minhash-pairs"), sets, percent), "minhash-links")
    joined = components(_edges(joined).union(links), "minhash-stars")

    now = written(placed_in(joined), "minhash-placed")
    torn = now.groupBy("leader", "posting").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("leader", "posting")
    now = now.join(torn, ["leader", "posting"], "left_semi")
    across = now.join(now.select("leader", "posting", *of_y), ["leader", "posting"]).filter((F.col("component") < F.col("component_y")) & _reconcilable(percent)).select(*pair).distinct()
    late = written(_linked(written(across, "minhash-pairs"), sets, percent), "minhash-links")
    whole = components(_edges(joined).union(late), "minhash-components")

    of_class = classes.join(whole, "node", "left").select("set_hi", "set_lo", F.coalesce("component", "node").alias("component"))
    of_row = signed.withColumn("has_words", F.col("n_shingles") > 0).join(
        of_class.withColumn("has_words", F.lit(True)), ["set_hi", "set_lo", "has_words"], "left"
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return of_row.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, n_words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near copies, the one with the smallest id."""
    gone = near_duplicates(docs, n_words, percent, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias("gone_id"))
    gone = written(gone.distinct(), "minhash-gone")
    return docs.alias("d").join(gone.alias("x").hint("merge"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("x.gone_id")), "left_anti")


def op2_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), n_words=3, percent=85)
