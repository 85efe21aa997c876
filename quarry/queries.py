"""The registered queries of the scan engine, each with the SQL that must give the same rows.

A decoding query encodes a column of a table chunk by chunk, stores the components, and
decodes what it reads back; its SQL reads the column.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import codecs as C
from quarry.functions import kernels as K
from quarry.functions.types import date32, date64, timestamp, unsigned
from quarry.operators.predicates import Predicate
from quarry.operators.scan import concat_chunks, delete_positions, number_batches, project, scan
from quarry.plans.zones import store_map, surviving_ranges, zone_map
from quarry.sources.staging import shared_dir, written
from quarry.sources.tables import ROW_OFFSET, open_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ZONE = 1024


def query(sql: str, name: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        SQL[name or f.__name__] = sql
        return f

    return keep


def at(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return open_table(spark, f"{sf_dir}/{table}.parquet").with_row_offset()


# scans and projections


@query("SELECT * FROM orders")
def scan_all(spark, d):
    return scan(spark, f"{d}/orders.parquet")


@query("SELECT event_id, user_id, value FROM events")
def scan_project(spark, d):
    return scan(spark, f"{d}/events.parquet", ["event_id", "user_id", "value"])


@query("SELECT o_orderpriority, o_custkey, o_orderkey FROM orders")
def scan_reorder(spark, d):
    return scan(spark, f"{d}/orders.parquet", ["o_orderpriority", "o_custkey", "o_orderkey"])


@query("SELECT user_id AS first_user, event_id, user_id AS second_user FROM events")
def scan_repeat(spark, d):
    return scan(spark, f"{d}/events.parquet", ["user_id", "event_id", "user_id"]).toDF("first_user", "event_id", "second_user")


@query("SELECT count(*) AS n_rows FROM lineitem")
def scan_row_count(spark, d):
    return project(open_table(spark, f"{d}/lineitem.parquet").df, []).agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT event_id, event_id AS row_offset FROM events")
def scan_row_offset(spark, d):
    return scan(spark, f"{d}/events.parquet", ["event_id"], row_offset=True)


@query("SELECT event_id // 113 AS batch, min(event_id) AS first_row, count(*) AS n_rows FROM events GROUP BY 1")
def scan_batches(spark, d):
    rows = number_batches(scan(spark, f"{d}/events.parquet", ["event_id"], row_offset=True), 113)
    return rows.groupBy("batch").agg(F.min(ROW_OFFSET).alias("first_row"), F.count(F.lit(1)).alias("n_rows"))


@query(
    "WITH z AS (SELECT event_id // 1024 AS zone, max(user_id) AS hi FROM events GROUP BY 1) "
    "SELECT (e.event_id // 1024) * 11 + (e.event_id % 1024) // 100 AS batch, min(e.event_id) AS first_row, count(*) AS n_rows "
    "FROM events e JOIN z ON e.event_id // 1024 = z.zone WHERE NOT z.hi <= 90 GROUP BY 1"
)
def scan_batches_pruned(spark, d):
    rows = scan(spark, f"{d}/events.parquet", ["event_id"], [Predicate("user_id", "GT", 90)], zone_len=ZONE, row_offset=True)
    return number_batches(rows, 100, ZONE).groupBy("batch").agg(F.min(ROW_OFFSET).alias("first_row"), F.count(F.lit(1)).alias("n_rows"))


# zone maps

ZONES_SQL = "SELECT event_id // 1024 AS zone, min(event_id) AS lo, max(event_id) AS hi, count(*) AS n FROM events GROUP BY 1"


@query("SELECT event_id // 1024 AS zone, count(*) AS n_rows, min(user_id) AS lo, max(user_id) AS hi, count(*) - count(user_id) AS null_count FROM events GROUP BY 1")
def zone_map_build(spark, d):
    zones = zone_map(at(spark, d, "events"), ["user_id"], ZONE)
    return zones.select("zone", F.col("rows").alias("n_rows"), "stats_user_id.lo", "stats_user_id.hi", "stats_user_id.null_count")


_SKIP = {"EQ": "{v} < lo OR {v} > hi", "NEQ": "lo = hi AND lo = {v}", "GT": "hi <= {v}", "GTE": "hi < {v}", "LT": "lo >= {v}", "LTE": "lo > {v}"}
_EXACT = {"EQ": "= {v}", "NEQ": "IS DISTINCT FROM {v}", "GT": "> {v}", "GTE": ">= {v}", "LT": "< {v}", "LTE": "<= {v}"}


def _pruned_and_exact(op: str, value: int) -> None:
    def run(spark, d, exact):
        return scan(spark, f"{d}/events.parquet", ["event_id", "user_id"], [Predicate("event_id", op, value)], zone_len=ZONE, exact=exact)

    skip = _SKIP[op].format(v=value)
    query(
        f"WITH z AS ({ZONES_SQL}) SELECT e.event_id, e.user_id FROM events e JOIN z ON e.event_id // 1024 = z.zone WHERE NOT ({skip})",
        f"zone_prune_{op.lower()}",
    )(lambda spark, d: run(spark, d, False))
    query(f"SELECT event_id, user_id FROM events WHERE event_id {_EXACT[op].format(v=value)}", f"zone_exact_{op.lower()}")(lambda spark, d: run(spark, d, True))


for _op, _value in (("EQ", 512), ("NEQ", 512), ("GT", 8700), ("GTE", 7168), ("LT", 1024), ("LTE", 1024)):
    _pruned_and_exact(_op, _value)


@query(
    "WITH z AS (SELECT o_orderkey // 1024 AS zone, min(o_orderkey) AS lo, max(o_orderkey) AS hi, min(o_custkey) AS lo2, max(o_custkey) AS hi2 FROM orders GROUP BY 1) "
    "SELECT o_orderkey, o_custkey FROM orders JOIN z ON o_orderkey // 1024 = zone WHERE NOT (hi <= 300) AND NOT (lo2 > 40) AND NOT (lo >= 5000)"
)
def zone_prune_and(spark, d):
    wanted = [Predicate("o_orderkey", "GT", 300), Predicate("o_custkey", "LTE", 40), Predicate("o_orderkey", "LT", 5000)]
    return scan(spark, f"{d}/orders.parquet", ["o_orderkey", "o_custkey"], wanted, zone_len=ZONE)


@query(f"WITH z AS ({ZONES_SQL}) SELECT e.event_id, e.value FROM events e JOIN z ON e.event_id // 1024 = z.zone WHERE NOT (hi <= 8700)")
def zone_prune_ignored_type(spark, d):
    return scan(spark, f"{d}/events.parquet", ["event_id", "value"], [Predicate("value", "GT", 10**9), Predicate("event_id", "GT", 8700)], zone_len=ZONE)


@query(f"WITH z AS ({ZONES_SQL}) SELECT e.event_id, e.event_type FROM events e JOIN z ON e.event_id // 1024 = z.zone WHERE NOT (hi < 7000)")
def zone_prune_stored_map(spark, d):
    """With a map that is stored and checked; its bounds also let the Parquet reader skip row groups."""
    path = f"{shared_dir(spark)}/zones-{uuid.uuid4().hex}"
    store_map(open_table(spark, f"{d}/events.parquet").df, ["event_id"], ZONE, path)
    return scan(spark, f"{d}/events.parquet", ["event_id", "event_type"], [Predicate("event_id", "GTE", 7000)], zones=path)


_BANDS = "CASE WHEN o_orderkey // 512 % 3 = 1 THEN NULL WHEN o_orderkey // 512 % 3 = 2 AND o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey // 512 % 3 = 0 THEN 5 ELSE o_orderkey END"
_BAND_ZONES = f"SELECT o_orderkey // 512 AS zone, min({_BANDS}) AS lo, max({_BANDS}) AS hi, count(*) AS n, count(*) - count({_BANDS}) AS nulls FROM orders GROUP BY 1"


def banded(spark: SparkSession, d: str) -> DataFrame:
    """Zones of 512 rows: all 5, all null, some null, in turn."""
    band = F.floor(F.col("o_orderkey") / 512) % 3
    v = F.when(band == 0, F.lit(5).cast("bigint")).when((band == 2) & (F.col("o_orderkey") % 7 != 0), F.col("o_orderkey"))
    return at(spark, d, "orders").select("o_orderkey", v.alias("v"), ROW_OFFSET)


def _banded_sql(skip: str) -> str:
    return f"WITH z AS ({_BAND_ZONES}) SELECT o_orderkey, {_BANDS} AS v FROM orders JOIN z ON o_orderkey // 512 = zone WHERE NOT coalesce({skip}, false)"


@query(_banded_sql("nulls = 0 AND lo = hi AND lo = 5"))
def zone_prune_nulls_neq(spark, d):
    """A null differs from 5, so only zones that are known to be full of 5 go."""
    return scan(spark, banded(spark, d), ["o_orderkey", "v"], [Predicate("v", "NEQ", 5)], zone_len=512)


@query(_banded_sql("CASE WHEN nulls = n THEN true ELSE hi < 0 END"))
def zone_prune_all_null(spark, d):
    return scan(spark, banded(spark, d), ["o_orderkey", "v"], [Predicate("v", "GTE", 0)], zone_len=512)


@query(f"SELECT o_orderkey, {_BANDS} AS v FROM orders WHERE {_BANDS} IS DISTINCT FROM 5")
def zone_exact_nulls_neq(spark, d):
    return scan(spark, banded(spark, d), ["o_orderkey", "v"], [Predicate("v", "NEQ", 5)], zone_len=512, exact=True)


def _with_stats(spark: SparkSession, d: str, predicate: Predicate, bad, **changed) -> DataFrame:
    """A scan with a map whose bad zones have other statistics."""
    rows = at(spark, d, "events").select("event_id", ROW_OFFSET)
    zones = zone_map(rows, ["event_id"], ZONE)
    stats = F.col("stats_event_id")
    for name, value in changed.items():
        stats = stats.withField(name, value)
    zones = zones.withColumn("stats_event_id", F.when(bad, stats).otherwise(F.col("stats_event_id")))
    return scan(spark, f"{d}/events.parquet", ["event_id"], [predicate], zones=zones, zone_len=ZONE)


@query(f"WITH z AS ({ZONES_SQL}) SELECT event_id FROM events JOIN z ON event_id // 1024 = zone WHERE zone % 2 = 0 OR NOT hi <= 5000")
def zone_prune_truncated(spark, d):
    """Bounds that are cut off prove nothing: every second zone stays, the others by their bounds."""
    return _with_stats(spark, d, Predicate("event_id", "GT", 5000), F.col("zone") % 2 == 0, hi=F.col("zone"), hi_truncated=F.lit(True))


@query(f"WITH z AS ({ZONES_SQL}) SELECT event_id FROM events JOIN z ON event_id // 1024 = zone WHERE zone % 3 <> 2 OR NOT hi <= 5000")
def zone_prune_corrupt_stats(spark, d):
    """Neither do more nulls than rows, nor a minimum above the maximum."""
    k = F.col("zone") % 3
    return _with_stats(spark, d, Predicate("event_id", "GT", 5000), k != 2, null_count=F.when(k == 0, F.col("rows") + 1).otherwise(F.lit(0)), lo=F.when(k == 1, F.lit(10**10)).otherwise(F.lit(0)))


@query("WITH z AS (SELECT event_id // 1024 AS zone, max(event_id) AS hi FROM events GROUP BY 1), "
       "k AS (SELECT zone, zone - row_number() OVER (ORDER BY zone) AS run FROM z WHERE NOT (hi < 300) AND NOT (zone % 5 = 1)), n AS (SELECT count(*) AS c FROM events) "
       "SELECT min(zone) * 1024 AS start, least((max(zone) + 1) * 1024, (SELECT c FROM n)) AS stop FROM k GROUP BY run")
def zone_surviving_ranges(spark, d):
    """Every fifth zone is known to hold nulls only, so that several ranges are left."""
    stats = F.col("stats_event_id")
    zones = zone_map(at(spark, d, "events"), ["event_id"], ZONE)
    zones = zones.withColumn("stats_event_id", F.when(F.col("zone") % 5 == 1, stats.withField("null_count", F.col("rows"))).otherwise(stats))
    return surviving_ranges(zones, [Predicate("event_id", "GTE", 300)], ZONE)


@query("WITH v AS (SELECT event_id, length(event_type) AS k FROM events), z AS (SELECT event_id // 256 AS zone, min(k) AS lo, max(k) AS hi FROM v GROUP BY 1) "
       "SELECT v.event_id, v.k FROM v JOIN z ON v.event_id // 256 = z.zone WHERE NOT (hi <= 6)")
def zone_prune_dict_values(spark, d):
    """Zones over a dictionary column hold its values, never its codes."""
    rows = at(spark, d, "events").select(ROW_OFFSET, F.length("event_type").cast("bigint").alias("k"))
    decoded = C.layout_dict_decode(*C.layout_dict_encode(rows, "k"), "k").withColumn("event_id", F.col(ROW_OFFSET))
    return scan(spark, decoded, ["event_id", "k"], [Predicate("k", "GT", 6)], zone_len=256)


# rows by position


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT event_id * 7 FROM events WHERE event_type = 'click')")
def positional_delete(spark, d):
    deletes = spark.read.parquet(f"{d}/events.parquet").filter("event_type = 'click'").select((F.col("event_id") * 7).alias(ROW_OFFSET))
    return delete_positions(at(spark, d, "orders"), deletes).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, event_id AS row_offset FROM events")
def chunk_concat(spark, d):
    """Three chunks of uneven length, each with positions of its own."""
    rows = at(spark, d, "events").select("event_id", ROW_OFFSET)
    cuts = [(0, 257), (257, 770), (770, 1 << 62)]
    return concat_chunks([rows.filter((F.col(ROW_OFFSET) >= a) & (F.col(ROW_OFFSET) < b)).withColumn(ROW_OFFSET, F.col(ROW_OFFSET) - a) for a, b in cuts])


# codecs


def _chunks(spark: SparkSession, d: str, table: str, value) -> DataFrame:
    rows = at(spark, d, table)
    return written(C.chunked(rows.select(ROW_OFFSET, (F.col(value) if isinstance(value, str) else value).alias("v")), "v"), "chunks")


def _nulled(name: str, every: int):
    return F.when(F.col(ROW_OFFSET) % every != 0, F.col(name))


def _decoded(decoded: DataFrame, name: str, key: str) -> DataFrame:
    return C.unchunked(decoded, name).withColumnRenamed(ROW_OFFSET, key)


@query("SELECT o_orderkey AS row_id, CAST(NULL AS VARCHAR) AS nothing FROM orders")
def null_decode(spark, d):
    return _decoded(C.null_decode(_chunks(spark, d, "orders", F.lit(None).cast("string")), "string"), "nothing", "row_id")


@query("SELECT o_orderkey AS row_id, o_orderkey // 1024 AS v FROM orders")
def constant_decode(spark, d):
    return _decoded(C.constant_decode(written(C.constant_encode(_chunks(spark, d, "orders", F.floor(F.col("o_orderkey") / 1024))), "encoded")), "v", "row_id")


@query("SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS v FROM orders")
def masked_decode(spark, d):
    return _decoded(C.masked_decode(written(C.masked_encode(_chunks(spark, d, "orders", _nulled("o_totalprice", 5)), F.lit(-1.0)), "encoded"), "double"), "v", "row_id")


@query("SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS v FROM orders")
def dict_decode(spark, d):
    return _decoded(C.dict_decode(written(C.dict_encode(_chunks(spark, d, "orders", _nulled("o_orderpriority", 11))), "encoded")), "v", "row_id")


@query("SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS v FROM orders")
def layout_dict_nullable(spark, d):
    rows = at(spark, d, "orders").select(ROW_OFFSET, _nulled("o_orderstatus", 3).alias("v"))
    return C.layout_dict_decode(*C.layout_dict_encode(rows, "v"), "v").withColumnRenamed(ROW_OFFSET, "row_id")


@query("SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS v FROM orders")
def runend_decode(spark, d):
    return _decoded(C.runend_decode(written(C.runend_encode(_chunks(spark, d, "orders", _nulled("o_orderstatus", 13))), "encoded")), "v", "row_id")


@query("SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey // 50 END AS v FROM orders")
def rle_decode(spark, d):
    value = F.when(F.col(ROW_OFFSET) % 17 != 0, F.floor(F.col("o_orderkey") / 50))
    return _decoded(C.rle_decode(written(C.rle_encode(_chunks(spark, d, "orders", value)), "encoded")), "v", "row_id")


@query("SELECT o_orderkey AS row_id, o_orderkey * 29 - 80000 AS v FROM orders")
def sequence_decode(spark, d):
    return _decoded(C.sequence_decode(written(C.sequence_encode(_chunks(spark, d, "orders", F.col("o_orderkey") * 29 - 80000)), "encoded")), "v", "row_id")


@query("SELECT event_id AS row_id, CASE WHEN event_id % 19 <> 0 THEN event_type END AS v FROM events")
def sparse_decode(spark, d):
    return _decoded(C.sparse_decode(written(C.sparse_encode(_chunks(spark, d, "events", _nulled("event_type", 19)), F.lit("view")), "encoded")), "v", "row_id")


@query("SELECT o_orderkey AS row_id, o_custkey AS v FROM orders")
def for_decode(spark, d):
    return _decoded(C.for_decode(written(C.for_encode(_chunks(spark, d, "orders", "o_custkey")), "encoded")), "v", "row_id")


@query("SELECT o_orderkey AS row_id, o_custkey - 700 AS v FROM orders")
def zigzag_decode(spark, d):
    return _decoded(C.zigzag_decode(written(C.zigzag_encode(_chunks(spark, d, "orders", F.col("o_custkey") - 700)), "encoded")), "v", "row_id")


@query("SELECT o_orderkey AS row_id, o_custkey * 1009 - 9223372036854775000 AS v FROM orders")
def delta_decode(spark, d):
    value = (F.col("o_custkey") * 1009).cast("decimal(20,0)") - F.lit("9223372036854775000").cast("decimal(20,0)")
    return _decoded(C.delta_decode(written(C.delta_encode(_chunks(spark, d, "orders", value.cast("bigint"))), "encoded")), "v", "row_id")


@query("SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 23 <> 0 THEN o_custkey END AS v FROM orders")
def bitpacked_decode(spark, d):
    """Nine bits a value; customers from 512 on are patches."""
    return _decoded(K.bitpacked_decode(written(K.bitpacked_encode(_chunks(spark, d, "orders", _nulled("o_custkey", 23)), 9), "encoded"), 9), "v", "row_id")


@query("SELECT o_orderkey AS row_id, o_totalprice > 50000 AS v FROM orders")
def bool_bitmap_decode(spark, d):
    return _decoded(K.bool_decode(written(K.bool_encode(_chunks(spark, d, "orders", F.col("o_totalprice") > 50000), 3), "encoded")), "v", "row_id")


@query("SELECT o_orderkey AS row_id, o_orderstatus = 'F' AS v FROM orders")
def bytebool_decode(spark, d):
    return _decoded(K.bytebool_decode(written(K.bytebool_encode(_chunks(spark, d, "orders", F.col("o_orderstatus") == "F")), "encoded")), "v", "row_id")


@query("SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice END AS v FROM orders")
def primitive_decode(spark, d):
    return _decoded(K.primitive_decode(written(K.primitive_encode(_chunks(spark, d, "orders", _nulled("o_totalprice", 6)), "float64"), "encoded"), "float64", "double"), "v", "row_id")


@query("SELECT event_id AS row_id, CASE WHEN event_id % 97 = 0 THEN value / 3 ELSE round(value, 2) END AS v FROM events")
def alp_decode(spark, d):
    """Two decimals as integers; thirds do not fit and are patches."""
    value = F.when(F.col("event_id") % 97 == 0, F.col("value") / 3).otherwise(F.round("value", 2))
    return _decoded(C.alp_decode(written(C.alp_encode(_chunks(spark, d, "events", value), 5, 3), "encoded"), 5, 3), "v", "row_id")


@query("SELECT event_id AS row_id, CASE WHEN event_id % 29 <> 0 THEN value / 7 END AS v FROM events")
def alprd_decode(spark, d):
    value = F.when(F.col("event_id") % 29 != 0, F.col("value") / 7)
    return _decoded(K.alprd_decode(written(K.alprd_encode(_chunks(spark, d, "events", value)), "encoded")), "v", "row_id")


@query("SELECT event_id AS row_id, CASE WHEN event_id % 31 <> 0 THEN ts END AS v FROM events")
def datetimeparts_decode(spark, d):
    return _decoded(C.datetime_parts_decode(written(C.datetime_parts_encode(_chunks(spark, d, "events", _nulled("ts", 31))), "encoded")), "v", "row_id")


@query("SELECT o_orderkey AS row_id, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) AS v FROM orders")
def decimal_parts_decode(spark, d):
    unscaled = F.round(F.col("o_totalprice") * 100).cast("bigint")
    parts = _chunks(spark, d, "orders", unscaled).withColumnRenamed("vals", "parts")
    return _decoded(C.decimal_parts_decode(parts, 18, 2), "v", "row_id").withColumn("v", F.col("v").cast("string"))


@query("SELECT o_orderkey AS row_id, CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS VARCHAR) AS v FROM orders")
def decimal_bytes_decode(spark, d):
    value = (F.round(F.col("o_totalprice") * 100).cast("decimal(18,0)") / 100).cast("decimal(15,2)")
    return _decoded(K.decimal_decode(written(K.decimal_encode(_chunks(spark, d, "orders", value), 16), "encoded"), 16, 15, 2), "v", "row_id").withColumn("v", F.col("v").cast("string"))


@query("SELECT o_orderkey AS row_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS v FROM orders")
def date_ext_decode(spark, d):
    days = at(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.unix_date(F.to_date("o_orderdate")).cast("bigint").alias("days"))
    return days.select("row_id", date32(F.col("days")).cast("string").alias("v"))


@query("SELECT c_custkey AS row_id, CASE WHEN row_number() OVER (ORDER BY c_custkey) % 7 <> 1 THEN c_name END AS v FROM customer")
def onpair_decode(spark, d):
    return _strings(spark, d, C.tokens_encode, C.tokens_decode)


@query("SELECT c_custkey AS row_id, CASE WHEN row_number() OVER (ORDER BY c_custkey) % 7 <> 1 THEN c_name END AS v FROM customer")
def varbin_decode(spark, d):
    return _strings(spark, d, C.varbin_encode, C.varbin_decode)


@query("SELECT c_custkey AS row_id, CASE WHEN row_number() OVER (ORDER BY c_custkey) % 7 <> 1 THEN c_name END AS v FROM customer")
def varbinview_decode(spark, d):
    return _strings(spark, d, K.views_encode, K.views_decode)


@query("SELECT c_custkey AS row_id, CASE WHEN row_number() OVER (ORDER BY c_custkey) % 7 <> 1 THEN c_name END AS v FROM customer")
def fsst_decode(spark, d):
    return _strings(spark, d, K.symbols_encode, K.symbols_decode)


@query("SELECT c_custkey AS row_id, CASE WHEN row_number() OVER (ORDER BY c_custkey) % 7 <> 1 THEN c_name END AS v FROM customer")
def zstd_decode(spark, d):
    return _strings(spark, d, K.zstd_encode, K.zstd_decode)


def _strings(spark, d, encode, decode) -> DataFrame:
    """Customer names, every seventh null, decoded and put back beside their keys chunk by chunk."""
    rows = at(spark, d, "customer")
    decoded = decode(written(encode(written(C.chunked(rows.select(ROW_OFFSET, _nulled("c_name", 7).alias("v")), "v"), "chunks")), "encoded"))
    return C.unchunked(C.zipped({"row_id": C.chunked(rows, "c_custkey"), "v": decoded}), "s").select("s.row_id", "s.v")


@query("SELECT o_orderkey AS row_id, o_orderstatus AS status, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS cust FROM orders")
def struct_decode(spark, d):
    """A struct whose fields are coded apart, with a validity of its own."""
    rows = at(spark, d, "orders")
    status = C.dict_decode(written(C.dict_encode(C.chunked(rows.select(ROW_OFFSET, F.col("o_orderstatus").alias("v")), "v")), "encoded"))
    cust = C.masked_decode(written(C.masked_encode(C.chunked(rows.select(ROW_OFFSET, _nulled("o_custkey", 4).alias("v")), "v"), F.lit(0)), "encoded"), "bigint")
    both = C.unchunked(C.zipped({"status": status, "cust": cust}), "s")
    return both.select(F.col(ROW_OFFSET).alias("row_id"), "s.status", "s.cust")


# types


@query(
    "SELECT event_id AS row_id, CAST(event_id % 256 AS SMALLINT) AS u8, CAST(event_id * 13 % 65536 AS INTEGER) AS u16, "
    "CAST(event_id * 500009 % 4294967296 AS BIGINT) AS u32, CAST(18446744073709551615 - CAST(event_id AS HUGEINT) AS VARCHAR) AS u64 FROM events"
)
def types_unsigned(spark, d):
    """Unsigned integers kept as signed ones of their width, widened again."""
    e = F.col("event_id")
    signed = lambda x, bits, kind: F.when(x >= 1 << (bits - 1), x - (1 << bits)).otherwise(x).cast(kind)
    kept = at(spark, d, "events").select(
        e.alias("row_id"), signed(e % 256, 8, "tinyint").alias("a"), signed(e * 13 % 65536, 16, "smallint").alias("b"),
        signed(e * 500009 % (1 << 32), 32, "int").alias("c"), (F.lit(-1).cast("bigint") - e).alias("d"),
    )
    return kept.select("row_id", unsigned(F.col("a"), 8).alias("u8"), unsigned(F.col("b"), 16).alias("u16"), unsigned(F.col("c"), 32).alias("u32"), unsigned(F.col("d"), 64).cast("string").alias("u64"))


@query(
    "SELECT event_id AS row_id, date_trunc('second', ts) AS s, date_trunc('milliseconds', ts) AS ms, ts AS us, epoch_us(ts) * 1000 AS ns, CAST(CAST(ts AS DATE) AS VARCHAR) AS d64 FROM events"
)
def types_timestamps(spark, d):
    """Ticks of each unit; nanoseconds stay numbers."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ticks = at(spark, d, "events").select(F.col("event_id").alias("row_id"), us.alias("us"), F.floor(us / 1000).alias("ms"), F.floor(us / 1_000_000).alias("s"), (us * 1000).alias("ns"))
    return ticks.select("row_id", timestamp(F.col("s"), "s").alias("s"), timestamp(F.col("ms"), "ms").alias("ms"), timestamp(F.col("us"), "us").alias("us"),
                        timestamp(F.col("ns"), "ns").alias("ns"), date64(F.floor(F.col("s") / 86400) * 86_400_000).cast("string").alias("d64"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
