"""Secret scans over an incremental ledger of blobs, in DataFrame operations only.

Every version of every file is addressed by the SHA-256 of its content.  The ledger holds
the (blob, rule, version) triples that have been scanned, findings those with their spans.
A scan reads the content of a blob once, only for the rules whose present version the
ledger lacks, and joins findings back to every path that ever had that content.

Places come from marking: a match is wrapped in a control character (any already in the
text is first swapped for another that no rule can match, which moves nothing), the text
is split there, and running sums over the lengths of the parts give the offsets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import table, whole_text, written

MARK, INSTEAD = "\x01", "\x02"


@dataclass(frozen=True)
class Rule:
    """pattern is searched leftmost and non-overlapping; a match stands if the given group has so many characters."""

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0
    base: bool = True

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules in their order of rank, and one more.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20),
    Rule("hex", 1, r"[0-9a-f]+", 24),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, base=False),
)

LEDGER = "blob string, rule string"
FINDINGS = "blob string, rule string, kind string, rank int, start long, end long"


def _narrow(rule: Rule) -> str:
    """A run of one class that must be so long is found faster when the pattern says so, with the same matches."""
    return {r"[0-9a-f]+": rf"[0-9a-f]{{{rule.least},}}", r"AKIA[A-Z0-9]+": rf"AKIA[A-Z0-9]{{{rule.least - 4},}}"}.get(rule.pattern, rule.pattern)


def _parts(text: Column, rule: Rule, rank: int) -> Column:
    """The parts around and in the matches as (rule, rank, place, size, found); null without a match."""
    marked = F.regexp_replace(text, F.lit(f"(?:{_narrow(rule)})" if rule.group == 0 else rule.pattern), F.lit(f"{MARK}$0{MARK}"))
    found = F.char_length if rule.group == 0 else lambda p: F.char_length(F.regexp_extract(p, rule.pattern, rule.group))
    return F.when(
        F.contains(marked, F.lit(MARK)),
        F.transform(
            F.split(marked, MARK),
            lambda p, i: F.struct(
                F.lit(rule.key).alias("rule"), F.lit(rule.kind).alias("kind"), F.lit(rank).alias("rank"), i.alias("place"),
                F.char_length(p).cast("long").alias("size"), ((i % 2 == 1) & (found(p) >= rule.least)).alias("found"),
            ),
        ),
    )


def address(versions: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return versions.select(F.col(path_col).alias("path"), F.sha2(whole_text(text_col), 256).alias("blob"))


def scan_unseen(
    versions: DataFrame, ledger: DataFrame | None = None, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> tuple[DataFrame, DataFrame]:
    """(scanned, findings): the ledger's new entries and what they found.

    versions has a row per path and version.  Null text is the empty blob; null paths and
    repeated rows share their blob's one scan; an empty table scans nothing.  Extra
    columns are ignored.
    """
    spark = versions.sparkSession
    ledger = spark.createDataFrame([], LEDGER) if ledger is None else ledger
    known = ledger.groupBy("blob").agg(F.collect_set("rule").alias("known"))
    blobs = address(versions, path_col, text_col).groupBy("blob").agg(F.min("path").alias("path"))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    due = blobs.join(known, "blob", "left").select("blob", "path", F.array_except(wanted, F.coalesce("known", F.array().cast("array<string>"))).alias("due"))
    due = written(due.filter(F.size("due") > 0), "secret-due")

    content = versions.select(F.col(path_col).alias("path"), F.sha2(whole_text(text_col), 256).alias("blob"), F.replace(whole_text(text_col), F.lit(MARK), F.lit(INSTEAD)).alias("body"))
    content = content.alias("c").join(due.alias("d"), F.expr("c.blob = d.blob AND c.path <=> d.path")).select("c.blob", "due", "body")
    each = [F.when(F.array_contains("due", r.key), _parts(F.col("body"), r, i)) for i, r in enumerate(rules)]
    parts = content.select("blob", *[e.alias(f"p{i}") for i, e in enumerate(each)])
    parts = parts.select("blob", F.array(*[f"p{i}" for i in range(len(rules))]).alias("lists"))
    parts = parts.select("blob", F.explode(F.flatten(F.filter("lists", lambda p: p.isNotNull()))).alias("p")).select("blob", "p.*")
    # a blob whose representative row is repeated was read more than once: its parts are the same
    parts = parts.dropDuplicates(["blob", "rule", "place"])
    along = Window.partitionBy("blob", "rule").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    findings = (
        parts.withColumn("end", F.sum("size").over(along))
        .filter("found")
        .select("blob", "rule", "kind", "rank", (F.col("end") - F.col("size")).alias("start"), "end")
    )
    return due.select("blob", F.explode("due").alias("rule")), findings


def by_path(versions: DataFrame, findings: DataFrame, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of versions with the spans of its blob, ordered by start and rank."""
    spans = findings.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("spans"))
    return address(versions, path_col, text_col).join(spans, "blob", "left").select(
        "path", "blob", F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")).alias("spans")
    )


def secret_scan(versions: DataFrame, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of versions: counts of the base kinds, a digest of their spans, and all spans."""
    _, findings = scan_unseen(versions, None, path_col, text_col, rules)
    base = [r.kind for r in rules if r.base]
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return by_path(versions, written(findings, "secret-findings"), path_col, text_col, rules).select(
        F.col("path").alias("doc_id"),
        *[of(k) for k in base],
        F.sha2(told(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )


def op9_secret_scan(spark, sf_dir):
    return secret_scan(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH body AS (SELECT doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
marked AS (
  SELECT doc_id, 'assign' AS kind, 0 AS rank, string_split(regexp_replace(t,
    '((?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS parts FROM body
  UNION ALL SELECT doc_id, 'access', 1, string_split(regexp_replace(t, '(AKIA[A-Z0-9]+)', chr(1) || '\1' || chr(1), 'g'), chr(1)) FROM body
  UNION ALL SELECT doc_id, 'hex', 2, string_split(regexp_replace(t, '([0-9a-f]+)', chr(1) || '\1' || chr(1), 'g'), chr(1)) FROM body
  UNION ALL SELECT doc_id, 'pem', 3, string_split(regexp_replace(t, '(-----BEGIN [A-Z ]*PRIVATE KEY-----)', chr(1) || '\1' || chr(1), 'g'), chr(1)) FROM body),
placed AS (
  SELECT doc_id, kind, rank, i, p, sum(length(p)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e
  FROM (SELECT doc_id, kind, rank, unnest(parts) AS p, unnest(range(len(parts))) AS i FROM marked WHERE len(parts) > 1)),
spans AS (
  SELECT doc_id, kind, rank, CAST(e - length(p) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed
  WHERE i % 2 = 1 AND CASE kind
    WHEN 'assign' THEN length(regexp_extract(p, '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 6
    WHEN 'access' THEN length(p) >= 20 WHEN 'hex' THEN length(p) >= 24 ELSE true END),
told AS (
  SELECT doc_id,
         count(*) FILTER (WHERE kind = 'assign') AS n_assign,
         count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN told USING (doc_id)
"""
