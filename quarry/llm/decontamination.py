"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

Every benchmark window (ten consecutive words, or a shorter item as a whole) is looked up
through its rarest term, and the next rarest where its list is not much longer.  Term counts come from all documents.  Postings are only kept
for terms that some window looks up; each posting, moved back by the term's offset in the
window, is a possible start, and starts on which both lists agree are compared with the
document's own words.  A posting also has the words before and behind it, and is left
out at once where the window has others there.  So no list of a frequent term is ever read for a window that has a
rarer one, and nothing is lost: an exact occurrence has every term at its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import ascii_lower, row_key, table, whole_text, written

#: What separates words, and the words in a window.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: A window's second term is looked up too if its list is at most so many times as long as the rarest one's.
LONGER = 4


def words_of(text: Column) -> Column:
    """The words in order; splitting takes about a quarter of the time of extracting each word by itself."""
    return F.array_remove(F.split(ascii_lower(whole_text(text)), SEPARATOR), "")


def window_key(words: Column | str) -> Column:
    return F.xxhash64(F.array_join(words, " "))


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """item_id, phrase, n_words, window_key: a row for each window of each item; phrases are words joined by blanks."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(text_col)).alias("item_words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("item_words") - window, F.lit(0)))
    return (
        items.filter(F.size("item_words") > 0)
        .select("item_id", "item_words", F.explode(starts).alias("at"))
        .select("item_id", F.slice("item_words", F.col("at") + 1, F.lit(window)).alias("w"))
        .select("item_id", F.array_join("w", " ").alias("phrase"), F.size("w").alias("n_words"), window_key("w").alias("window_key"))
        .distinct()
    )


def _postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row_key, pos, term, before, next: each word of each document with the words around it, null at its ends."""
    words = _rows(docs, id_col, text_col, words_of(F.col(text_col)).alias("words"))
    return words.select("doc_id", "row_key", F.posexplode(_with_neighbours("words")).alias("pos", "w")).select("doc_id", "row_key", "pos", "w.term", "w.before", "w.next").filter("term IS NOT NULL")


def _with_neighbours(words: str) -> Column:
    ahead = F.concat(F.array(F.lit(None).cast("string")), F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))))
    return F.arrays_zip(F.col(words), ahead, F.slice(words, 2, F.size(words))).cast("array<struct<term:string,before:string,next:string>>")


def _lookups(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, before, next, window_key, n_words, offset, n_terms: for each window its rarest terms, with an offset of each and the words around it."""
    phrases = windows.select("window_key", "n_words", "phrase").distinct().select("window_key", "n_words", F.split("phrase", " ").alias("words"))
    terms = phrases.select("window_key", "n_words", F.posexplode(_with_neighbours("words")).alias("offset", "w")).select("window_key", "n_words", "offset", "w.term", "w.before", "w.next")
    vocabulary = written(terms.select("term").distinct(), "bench-vocabulary")
    seen = docs.select(F.explode(words_of(F.col(text_col))).alias("term"))
    counts = seen.join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_seen"))
    per_term = terms.groupBy("window_key", "n_words", "term").agg(F.min(F.struct("offset", "before", "next")).alias("at"))
    # a window with a term that no document has is out; the terms of the others are ordered by rarity
    ranked = per_term.join(counts, "term", "left").groupBy("window_key", "n_words").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n_seen", F.lit(0)).alias("n_seen"), "term", "at"))).alias("ranked")
    )
    least = F.element_at("ranked", 1)["n_seen"]
    top = F.filter(F.slice("ranked", 1, 2), lambda r: r["n_seen"] <= least * LONGER)
    each = ranked.filter(least > 0).select("window_key", "n_words", F.size(top).alias("n_terms"), F.explode(top).alias("r"))
    return written(each.select("r.term", "r.at.before", "r.at.next", "window_key", "n_words", "r.at.offset", "n_terms"), "bench-lookups")


def _rows(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), row_key(whole_text(text_col)).alias("row_key"), *more)


_SAME_ROW = "d.doc_id <=> f.doc_id AND d.row_key = f.row_key"


def occurrences(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, row_key, starts`` of each different row of docs that has a window, as in `exact_matches`."""
    lookups = _lookups(docs, windows, id_col, text_col)
    # the terms alone are few and short, so that they can meet the postings before these are shuffled
    rare = written(lookups.select("term", "before", "next").distinct(), "bench-rare")
    fits = F.expr("p.term = r.term AND (r.before IS NULL OR r.before = p.before) AND (r.next IS NULL OR r.next = p.next)")
    listed = _postings(docs, id_col, text_col).alias("p").join(rare.alias("r"), fits, "left_semi").alias("p").join(lookups.alias("r"), fits)
    starts = (
        listed.filter(F.col("pos") >= F.col("offset"))
        .groupBy("doc_id", "row_key", (F.col("pos") - F.col("offset")).alias("start"), "window_key", "n_words", "n_terms")
        .agg(F.count(F.lit(1)).alias("n_met"))
        .filter("n_met >= n_terms")  # repeated rows count more than once
    )
    found = written(
        starts.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("start", "n_words", "window_key")).alias("candidates")), "bench-candidates"
    )
    # only texts with candidates are moved to these; which texts they are is told by a narrow table
    able = written(found.select("doc_id", "row_key"), "bench-able")
    rows = _rows(docs, id_col, text_col, F.col(text_col).alias("body")).alias("d").join(able.alias("f"), F.expr(_SAME_ROW), "left_semi")
    rows = rows.alias("d").join(found.alias("f"), F.expr(_SAME_ROW)).select("d.doc_id", "d.row_key", "body", "candidates")
    same = lambda words, c: window_key(F.slice(words, c["start"] + 1, c["n_words"])) == c["window_key"]
    # the texts' words are handed in as an argument, so that they are found once and not for each candidate
    kept = F.flatten(F.transform(F.array(words_of(F.col("body"))), lambda words: F.filter("candidates", lambda c: same(words, c))))
    checked = written(rows.select("doc_id", "row_key", kept.alias("starts")), "bench-starts")
    return checked.filter(F.size("starts") > 0).dropDuplicates(["doc_id", "row_key"])


def exact_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW
) -> tuple[DataFrame, DataFrame]:
    """(hits, windows).

    hits has a row for each row of docs: ``doc_id, n_words, starts``, where ``starts`` lists
    every occurrence of a window as ``(start, n_words, window_key)``, null if there is none; windows has ``item_id,
    phrase, n_words, window_key``.  Windows are compared by hashes of 64 bits.

    Null and empty texts have no words and no hits; null ids are an ordinary key; rows that
    share id and text are looked up once and all answered; items without words and an empty
    benchmark match nothing.  Extra columns are ignored.
    """
    windows = written(benchmark_windows(benchmark, item_col, text_col, window), "bench-windows")
    found = written(occurrences(docs, windows, id_col, text_col), "bench-found")
    rows = _rows(docs, id_col, text_col, F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    return rows.alias("d").join(found.alias("f"), F.expr(_SAME_ROW), "left").select("d.doc_id", "d.n_words", "f.starts"), windows


def proximity_matches(
    docs: DataFrame, benchmark: DataFrame, slop: int, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW
) -> DataFrame:
    """doc_id, phrase, first_pos: windows whose words all occur within ``window + slop`` positions, in any order.

    The postings of all window terms are cut into overlapping stretches of twice that reach,
    and a stretch counts if one span of the reach has every distinct term.  Null and empty
    texts match nothing.
    """
    reach = window + slop
    terms = benchmark_windows(benchmark, item_col, text_col, window).select("phrase").distinct()
    terms = terms.select("phrase", F.explode(F.array_distinct(F.split("phrase", " "))).alias("term"))
    needed = terms.groupBy("phrase").agg(F.count(F.lit(1)).alias("n_needed"))
    listed = _postings(docs, id_col, text_col).join(terms, "term")
    cut = F.floor(F.col("pos") / reach)
    listed = listed.select("doc_id", "row_key", "phrase", "term", "pos", F.explode(F.array(cut, cut - 1)).alias("stretch"))
    grouped = listed.groupBy("doc_id", "row_key", "phrase", "stretch").agg(
        F.count_distinct("term").alias("n_met"), F.sort_array(F.collect_set(F.struct("pos", "term"))).alias("places")
    )
    near = lambda p: F.size(F.array_distinct(F.transform(
        F.filter("places", lambda q: (q["pos"] >= p["pos"]) & (q["pos"] < p["pos"] + reach)), lambda q: q["term"]
    ))) == F.col("n_needed")
    spans = grouped.join(needed, "phrase").filter("n_met = n_needed").select("doc_id", "phrase", F.filter("places", near).alias("spans"))
    return spans.filter(F.size("spans") > 0).select("doc_id", "phrase", F.explode("spans.pos").alias("first_pos")).distinct()


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    hits, windows = exact_matches(docs, benchmark, id_col, text_col, item_col, window)
    hits = written(hits, "bench-hits")
    covered = lambda s: F.sequence(s["start"], s["start"] + s["n_words"] - 1)
    dirty = hits.filter(F.size("starts") > 0)
    pairs = dirty.select("doc_id", F.xxhash64("starts").alias("starts_key"), F.explode(F.array_distinct("starts.window_key")).alias("window_key"))
    items = (
        pairs.join(windows.select("item_id", "window_key"), "window_key")
        .groupBy("doc_id", "starts_key")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    rows = hits.select(
        "doc_id",
        "n_words",
        F.when(F.size("starts") > 0, F.size(F.array_distinct(F.flatten(F.transform("starts", covered))))).otherwise(0).cast("long").alias("n_hit"),
        F.when(F.size("starts") > 0, F.xxhash64("starts")).alias("starts_key"),
    )
    out = rows.alias("r").join(items.alias("i"), F.expr("r.doc_id <=> i.doc_id AND r.starts_key = i.starts_key"), "left")
    listed = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return out.select(
        "r.doc_id", "n_words", "n_hit",
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without contaminated rows; rows that share an id stand or fall together."""
    windows = written(benchmark_windows(benchmark, "item_id", text_col, WINDOW), "bench-windows")
    dirty = occurrences(docs, windows, id_col, text_col).select(F.col("doc_id").alias("dirty_id"))
    dirty = written(dirty.distinct(), "bench-dirty")
    return docs.alias("d").join(dirty.alias("x").hint("merge"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("x.dirty_id")), "left_anti")


def op7_benchmark_decontamination(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc_words, sizes WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.s, p.n, x.item_id FROM places p JOIN windows x ON p.phrase = x.phrase AND p.n = x.n),
covered AS (
  SELECT doc_id, count(DISTINCT i) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
       CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.listed, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)
"""
