"""Exact dedup by progressive refinement, in DataFrame operations only.

Rows are grouped by length, those in groups of two or more by a hash of a short prefix,
and those that still have company by a hash of the whole text.  Each pass counts first
(partial sums on the map side, so a key with a third of all rows costs one row per task)
and then drops what stands alone, so the full content is only compared within groups
that agree on both cheaper keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import ascii_lower, table, whole_text, written

PREFIX_CHARS = 64


def _crowded(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys occur more than once."""
    crowd = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1").select(*keys)
    return rows.join(crowd, keys, "left_semi")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, digest_all: bool = False
) -> DataFrame:
    """Group documents whose texts are equal after lower-casing A-Z.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.
    The row with the largest id stays.  ``text_sha256`` is null for rows that an earlier
    pass proved unique, unless ``digest_all`` asks for it on every row; then the digest is
    taken in the first scan and no text is read twice.

    Null text counts as empty, so null and empty texts are equal.  Null ids rank below all
    others; rows of one group that share the kept id (repeated rows) are all kept.  An
    empty table gives no rows; columns other than id and text are ignored.
    """
    text = ascii_lower(whole_text(F.col(text_col)))
    base = docs.select(F.col(id_col).alias("doc_id"), whole_text(F.col(text_col)).alias("raw"))
    cheap = [
        F.octet_length("raw").alias("n_bytes"),
        F.xxhash64(ascii_lower(F.substring("raw", 1, prefix_chars))).alias("prefix_key"),
    ]
    digest = F.sha2(ascii_lower(F.col("raw")), 256).alias("text_sha256")
    keys = written(base.select("doc_id", *cheap, *([digest] if digest_all else [])), "exact-keys")

    survivors = _crowded(_crowded(keys, ["n_bytes"]), ["n_bytes", "prefix_key"])
    if not digest_all:
        picked = written(survivors.select("doc_id", "n_bytes", "prefix_key").distinct(), "exact-survivors")
        content = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(whole_text(text_col)).alias("n_bytes"),
                              F.xxhash64(ascii_lower(F.substring(whole_text(text_col), 1, prefix_chars))).alias("prefix_key"),
                              text.alias("full"))
        content = content.alias("c").join(
            picked.alias("p").hint("merge"), F.expr("c.doc_id <=> p.doc_id AND c.n_bytes = p.n_bytes AND c.prefix_key = p.prefix_key"), "left_semi"
        )
        survivors = written(content.select("doc_id", "n_bytes", "prefix_key", F.sha2("full", 256).alias("text_sha256")), "exact-digests")
    groups = (
        survivors.groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )
    if digest_all:
        rows = keys.join(groups, "text_sha256", "left")
        single = F.col("group_size").isNull()
    else:
        rows = survivors.join(groups, "text_sha256", "left")
        alone = keys.alias("k").join(
            picked.alias("p"), F.expr("k.doc_id <=> p.doc_id AND k.n_bytes = p.n_bytes AND k.prefix_key = p.prefix_key"), "left_anti"
        )
        rows = rows.unionByName(alone, allowMissingColumns=True)
        single = F.col("group_size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that `exact_dedup` drops; all columns as they were.

    Only dropped rows are looked up, by id and digest, so that rows with the same id and
    another text are not touched.
    """
    dropped = exact_dedup(docs, id_col, text_col).filter("NOT kept").select(
        F.col("doc_id").alias("dropped_id"), F.col("text_sha256").alias("dropped_sha")
    )
    dropped = written(dropped.distinct(), "exact-dropped")
    here = F.col(f"d.`{id_col}`"), F.sha2(ascii_lower(whole_text(F.col(f"d.`{text_col}`"))), 256)
    return docs.alias("d").join(
        dropped.alias("x").hint("merge"), here[0].eqNullSafe(F.col("x.dropped_id")) & (here[1] == F.col("x.dropped_sha")), "left_anti"
    )


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


ORACLE_SQL = """
WITH folded AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM folded
"""
