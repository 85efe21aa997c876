import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.errors import InvalidData
from quarry.operators.predicates import OPS, Predicate, exact, excludes
from quarry.operators.scan import concat_chunks, delete_positions, number_batches, project, record_batches, scan
from quarry.plans.zones import store_map, surviving_ranges, zone_map
from quarry.sources.tables import open_table

MATCHES = {"EQ": lambda x, v: x is not None and x == v, "NEQ": lambda x, v: x is None or x != v, "GT": lambda x, v: x is not None and x > v,
           "GTE": lambda x, v: x is not None and x >= v, "LT": lambda x, v: x is not None and x < v, "LTE": lambda x, v: x is not None and x <= v}
STATS = "lo bigint, hi bigint, null_count bigint, lo_truncated boolean, hi_truncated boolean"


def rows_of(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_offset bigint, v bigint")


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.none(), st.integers(-3, 3), st.sampled_from([-(2**63), 2**63 - 1, 2**53 + 1])), min_size=1, max_size=40), value=st.integers(-4, 4))
def test_pruned_holds_exact_for_all_comparisons(spark, values, value):
    rows = rows_of(spark, values)
    zones = zone_map(rows, ["v"], 8)
    proofs = zones.select("zone", *[excludes(Predicate("v", op, value), F.col("stats_v"), F.col("rows")).alias(op) for op in OPS]).collect()
    for z in proofs:
        zone = values[z["zone"] * 8 : z["zone"] * 8 + 8]
        for op in OPS:
            if z[op]:
                assert not any(MATCHES[op](x, value) for x in zone)
    got = rows.select("row_offset", *[exact(Predicate("v", op, value)).alias(op) for op in OPS]).collect()
    for r in got:
        for op in OPS:
            assert bool(r[op]) == MATCHES[op](values[r["row_offset"]], value)


@pytest.mark.parametrize(
    ("stats", "rows", "op", "value", "skips"),
    [
        (None, 5, "EQ", 1, False),
        ((1, 2, 0, False, False), 5, "EQ", 3, True),
        ((1, 2, 6, False, False), 5, "EQ", 3, False),  # more nulls than rows
        ((None, None, 5, False, False), 5, "EQ", 3, True),
        ((None, None, 5, False, False), 5, "NEQ", 3, False),
        ((None, 2, 0, False, False), 5, "GT", 3, False),
        ((1, 2, 0, True, False), 5, "GT", 3, False),
        ((1, 2, 0, False, None), 5, "GT", 3, False),
        ((3, 2, 0, False, False), 5, "GT", 9, False),
        ((4, 4, 0, False, False), 5, "NEQ", 4, True),
        ((4, 4, None, False, False), 5, "NEQ", 4, False),
        ((4, 4, 1, False, False), 5, "NEQ", 4, False),
        ((2**53 + 1, 2**53 + 1, 0, False, False), 5, "GT", 2**53, False),
        ((2**53 + 1, 2**53 + 1, 0, False, False), 5, "LT", 2**53 + 1, True),
        ((1, 4, None, False, False), 5, "GTE", 5, True),
        ((1, 4, None, False, False), 5, "LTE", 0, True),
    ],
)
def test_decision_rules(spark, stats, rows, op, value, skips):
    zone = spark.createDataFrame([(stats, rows)], f"stats struct<{STATS}>, rows bigint")
    assert zone.select(excludes(Predicate("v", op, value), F.col("stats"), F.col("rows"))).first()[0] is skips


def test_conjunction_and_ignored_types(spark):
    rows = spark.createDataFrame([(i, i, float(i)) for i in range(100)], "row_offset bigint, v bigint, x double")
    got = scan(spark, rows, ["v"], [Predicate("v", "GTE", 30), Predicate("v", "LT", 41), Predicate("x", "GT", 1000)], zone_len=10)
    assert sorted(r.v for r in got.collect()) == list(range(30, 50))


def test_stored_map_prunes_alike(spark):
    rows = rows_of(spark, [None] * 10 + list(range(50)))
    zones = zone_map(rows, ["v"], 10)
    for op in OPS:
        wanted = [Predicate("v", op, 20)]
        a = scan(spark, rows, ["v"], wanted, zone_len=10, row_offset=True)
        b = scan(spark, rows, ["v"], wanted, zone_len=10, zones=zones, row_offset=True)
        assert sorted(r.row_offset for r in a.collect()) == sorted(r.row_offset for r in b.collect())


def test_ranges_merge_neighbours(spark):
    rows = rows_of(spark, [0] * 10 + [5] * 20 + [0] * 10 + [5] * 3)
    zones = zone_map(rows, ["v"], 10)
    assert sorted(map(tuple, surviving_ranges(zones, [Predicate("v", "EQ", 5)], 10).collect())) == [(10, 30), (40, 43)]


def test_errors(spark):
    rows = rows_of(spark, [1, 2])
    with pytest.raises(InvalidData):
        Predicate("v", "LIKE", 1)
    with pytest.raises(InvalidData):
        scan(spark, rows, ["nothing"])
    with pytest.raises(InvalidData):
        scan(spark, rows, ["v"], [Predicate("nothing", "EQ", 1)])
    with pytest.raises(InvalidData):
        number_batches(rows, -1)


def test_files_positions_and_projection(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 4).select("id", (F.col("id") % 7).alias("k")).write.parquet(path)
    table = open_table(spark, path)
    assert table.num_rows() == 1000 and table.schema.names == ["id", "k"]
    placed = table.with_row_offset()
    assert sorted(r.row_offset for r in placed.collect()) == list(range(1000))
    assert placed.filter("id = row_offset").count() == 1000
    assert project(table.df, []).columns == [] and project(table.df, []).count() == 1000
    assert scan(spark, path, ["k", "id", "k"]).columns == ["k", "id", "k"]
    assert table.df.select("k").inputFiles()
    plan = scan(spark, path, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<k:bigint>" in plan


def test_batches(spark):
    rows = rows_of(spark, range(25))
    got = list(record_batches(rows.filter("v < 7 OR v >= 12"), 5))
    assert [(o, b.num_rows) for o, b in got] == [(0, 5), (5, 2), (12, 5), (17, 5), (22, 3)]
    assert got[2][1].column(0).to_pylist() == [12, 13, 14, 15, 16]
    assert list(record_batches(rows.filter("v < 0"))) == []
    by_zone = number_batches(rows, 4, 10).groupBy("batch").agg(F.min("row_offset").alias("a"), F.count("*").alias("n")).orderBy("a").collect()
    assert [(r.a, r.n) for r in by_zone] == [(0, 4), (4, 4), (8, 2), (10, 4), (14, 4), (18, 2), (20, 4), (24, 1)]


def test_deletes_and_chunks(spark):
    rows = rows_of(spark, range(10))
    gone = spark.createDataFrame([(3,), (3,), (9,), (77,)], "row_offset bigint")
    assert sorted(r.v for r in delete_positions(rows, gone).collect()) == [0, 1, 2, 4, 5, 6, 7, 8]
    both = concat_chunks([rows, rows_of(spark, [5, 6]), rows_of(spark, [])])
    assert sorted(map(tuple, both.collect()))[-2:] == [(10, 5), (11, 6)]
    with pytest.raises(InvalidData):
        concat_chunks([])


# bad statistics and names, through the scan

BAD = {
    "hi cut off": {"hi_truncated": "true"}, "lo cut off": {"lo_truncated": "true"}, "no hi": {"hi": "CAST(NULL AS BIGINT)"}, "no lo": {"lo": "CAST(NULL AS BIGINT)"},
    "more nulls than rows": {"null_count": "11L"}, "turned round": {"lo": "1000000L"}, "negative nulls": {"null_count": "-1L"}, "no flag": {"hi_truncated": "CAST(NULL AS BOOLEAN)"},
}


@pytest.mark.parametrize("bad", BAD)
def test_bad_statistics_lose_no_row(spark, bad):
    """Rows 0 to 99 in zones of ten, the last of which has bad statistics."""
    rows = rows_of(spark, range(100))
    stats = F.col("stats_v")
    for name, value in BAD[bad].items():
        stats = stats.withField(name, F.expr(value))
    zones = zone_map(rows, ["v"], 10).withColumn("stats_v", F.when(F.col("zone") == 9, stats).otherwise(F.col("stats_v"))).cache()
    for op in OPS:
        wanted = {v for v in range(100) if MATCHES[op](v, 85)}
        for exactly in (True, False):
            got = {r.v for r in scan(spark, rows, ["v"], [Predicate("v", op, 85)], zones=zones, zone_len=10, exact=exactly).collect()}
            assert got == wanted if exactly else got >= wanted | set(range(90, 100)), (bad, op)


def test_a_map_of_less_than_the_table_keeps_the_rest(spark):
    rows = rows_of(spark, range(100))
    zones = zone_map(rows.filter("v < 50"), ["v"], 10)
    assert {r.v for r in scan(spark, rows, ["v"], [Predicate("v", "GTE", 45)], zones=zones, zone_len=10).collect()} == set(range(40, 100))
    missing = zone_map(rows, ["v"], 10).withColumn("stats_v", F.when(F.col("zone") != 9, F.col("stats_v")))
    assert {r.v for r in scan(spark, rows, ["v"], [Predicate("v", "GTE", 85)], zones=missing, zone_len=10, exact=True).collect()} == set(range(85, 100))


@pytest.mark.parametrize("value", [10.5, "3", None, True, 1 << 63, -(1 << 63) - 1])
def test_values_that_are_no_64_bit_integers(value):
    with pytest.raises(InvalidData):
        Predicate("v", "LT", value)


def test_columns_called_row_offset_and_zone(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, 99 - i, i % 3) for i in range(100)], "v bigint, row_offset bigint, zone bigint").coalesce(1).write.parquet(path)
    assert scan(spark, path).columns == ["v", "row_offset", "zone"] and scan(spark, path).count() == 100
    got = scan(spark, path, predicates=[Predicate("row_offset", "GTE", 95)], zone_len=10).collect()
    assert {r.v for r in got} == set(range(10)) and {r.zone for r in got} == {0, 1, 2}
    with pytest.raises(InvalidData):
        scan(spark, path, ["v"], row_offset=True)


@pytest.fixture
def clustered(spark, tmp_path):
    """Twenty row groups' worth of rising numbers in two files."""
    path = str(tmp_path / "events")
    spark.range(0, 200_000, 1, 2).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h")).write.option("parquet.block.size", 1 << 18).option("parquet.page.row.count.limit", 2000).parquet(path)
    zones = str(tmp_path / "map")
    store_map(spark.read.parquet(path), ["id"], 1000, zones)
    return path, zones


def scanned_rows(df):
    """Rows that the file scan of the text column handed on."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    todo, n = [plan], 0
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "FileSourceScanExec" and "h" in [c.split("#")[0] for c in p.output().mkString(",").split(",")]:
            n += p.metrics().apply("numOutputRows").value()
        children = p.executedPlan() if kind == "AdaptiveSparkPlanExec" else p.plan() if kind.endswith("QueryStageExec") else None
        todo += [children] if children is not None else [p.children().apply(i) for i in range(p.children().size())]
    return n


def test_a_stored_map_reads_less(spark, clustered):
    path, zones = clustered
    wanted = [Predicate("id", "GTE", 190_500)]
    full, some = scan(spark, path, ["id", "h"], wanted, zone_len=1000), scan(spark, path, ["id", "h"], wanted, zones=zones)
    assert {r.id for r in some.collect()} == {r.id for r in full.collect()} == set(range(190_000, 200_000))
    assert 10_000 <= scanned_rows(some) < scanned_rows(full) / 2
    assert scan(spark, path, ["id"], [Predicate("id", "LT", -5)], zones=zones).count() == 0


def test_a_stored_map_that_does_not_fit_skips_nothing(spark, clustered, tmp_path):
    path, zones = clustered
    wanted = [Predicate("id", "GTE", 199_000)]
    n = lambda z: scan(spark, path, ["id"], wanted, zones=z).count()
    assert n(zones) == 1000 and n(str(tmp_path / "nothing")) == 200_000
    other = str(tmp_path / "other")
    spark.read.parquet(zones).withColumn("note", F.lit("{}")).write.parquet(other)
    assert n(other) == 200_000
    odd = str(tmp_path / "odd")
    spark.read.parquet(zones).withColumn("stats_id", F.lit("x")).write.parquet(odd)
    assert n(odd) == 200_000
    for f in (tmp_path / "map").glob("part-*"):
        f.write_bytes(f.read_bytes()[:200] + b"damage" * 20)
    for f in (tmp_path / "map").glob(".part-*"):
        f.unlink()
    assert n(zones) == 200_000
    spark.range(200_000, 200_010).select("id", F.lit("new").alias("h")).write.mode("append").parquet(path)
    store_map(spark.read.parquet(path), ["id"], 1000, zones)
    assert 1010 <= n(zones) < 10_000
    spark.range(200_010, 200_020).select("id", F.lit("new").alias("h")).write.mode("append").parquet(path)
    assert n(zones) == 200_020


def test_ranges_run_on_over_stretches(spark):
    zones = spark.range(10_000).select(F.col("id").alias("zone"), F.lit(2).cast("long").alias("rows"), F.struct(
        F.when(F.col("id").isin(0, 5000), 0).otherwise(9).cast("long").alias("lo"), F.when(F.col("id").isin(0, 5000), 0).otherwise(9).cast("long").alias("hi"), F.lit(0).cast("long").alias("null_count"),
        F.lit(False).alias("lo_truncated"), F.lit(False).alias("hi_truncated")).alias("stats_v"))
    got = sorted((r.start, r.stop) for r in surviving_ranges(zones, [Predicate("v", "GT", 5)], 2).collect())
    assert got == [(2, 10_000), (10_002, 20_000)]


def test_ranges_of_many_zones(spark):
    """Thousands of runs in each stretch, and some over its border: found by counting, so that the work grows as the zones do."""
    n = 3 * 4096 + 100
    keep = [i % 2 == 0 or i // 4096 == 1 and i % 4096 > 3000 or i in (4095, 8192, 8193) or i * 7919 % 13 == 1 for i in range(n)]
    zones = spark.range(n).selectExpr("id AS zone", "CASE WHEN id = " + str(n - 1) + " THEN 3L ELSE 10L END AS rows", "id AS v")
    zones = zones.join(spark.createDataFrame(list(enumerate(keep)), "v bigint, kept boolean"), "v").selectExpr(
        "zone", "rows", "named_struct('lo', CAST(kept AS BIGINT), 'hi', CAST(kept AS BIGINT), 'null_count', 0L, 'lo_truncated', false, 'hi_truncated', false) AS stats_v"
    )
    wanted, start = [], None
    for i, k in enumerate([*keep, False]):
        if k and start is None:
            start = i
        if not k and start is not None:
            wanted.append((start * 10, min(i * 10, (n - 1) * 10 + 3)))
            start = None
    ranges = surviving_ranges(zones, [Predicate("v", "EQ", 1)], 10)
    assert "array_contains" not in ranges._jdf.queryExecution().toString()  # a look at all zones for each
    assert sorted(map(tuple, ranges.collect())) == wanted and len(wanted) > 3000
