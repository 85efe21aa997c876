"""Zone maps: minimum, maximum and null count of columns for every stretch of rows, and scans that skip by them.

A map may be stored beside its table.  It then tells which files it was made of, with their
sizes and times of change, and is only used for just these; anything that cannot be read or
does not fit keeps all rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegralType, LongType, StructType

from quarry.errors import InvalidData
from quarry.operators.predicates import Predicate, all_null, excludes, prunable, usable
from quarry.sources.staging import written
from quarry.sources.tables import ROW_OFFSET, with_row_offset

ZONE = "zone"


def zone_of(zone_len: int, offset: str = ROW_OFFSET) -> Column:
    if zone_len <= 0:
        raise InvalidData("a zone has one row at least")
    return F.expr(f"`{offset}` DIV {zone_len}")


def zone_map(rows: DataFrame, columns: Iterable[str], zone_len: int, offset: str = ROW_OFFSET) -> DataFrame:
    """``zone, rows`` and a struct ``stats_<column>`` for each column; rows must have its positions in the offset column.

    One pass with partial aggregation.  The map has a row per zone, so written beside the
    table it serves every later scan.
    """
    stats = [
        F.struct(
            F.min(c).cast("long").alias("lo"), F.max(c).cast("long").alias("hi"), F.count_if(F.col(c).isNull()).alias("null_count"),
            F.lit(False).alias("lo_truncated"), F.lit(False).alias("hi_truncated"),
        ).alias(f"stats_{c}")
        for c in dict.fromkeys(columns)
    ]
    return rows.groupBy(zone_of(zone_len, offset).alias(ZONE)).agg(F.count(F.lit(1)).alias("rows"), *stats)


def surviving(zones: DataFrame, predicates: Iterable[Predicate]) -> DataFrame:
    """The zones that no predicate rules out; a predicate whose column has no statistics rules out nothing."""
    proofs = [excludes(p, F.col(f"stats_{p.column}"), F.col("rows")) for p in predicates if f"stats_{p.column}" in zones.columns]
    return zones.filter(~reduce(lambda a, b: a | b, proofs, F.lit(False)))


def surviving_ranges(zones: DataFrame, predicates: Iterable[Predicate], zone_len: int) -> DataFrame:
    """``start, stop``: surviving zones as row ranges, neighbours merged.

    Runs are found within stretches of 4096 zones by counting, and the few that reach a
    stretch's border are merged with those of the next by one pass over them.  The zone
    map is made once, as the runs are stored before they are merged.
    """
    kept = surviving(zones, predicates).select(ZONE, "rows", F.expr(f"{ZONE} DIV 4096").alias("stretch"))
    # zones of a run rise as fast as their numbers
    run = F.col(ZONE) - F.row_number().over(Window.partitionBy("stretch").orderBy(ZONE))
    end = F.max(ZONE).over(Window.partitionBy("stretch"))
    runs = kept.withColumns({"run": run, "end": end}).groupBy("stretch", "run", "end").agg(F.min(ZONE).alias("first"), F.max(ZONE).alias("last"), F.max_by("rows", ZONE).alias("last_rows"))
    stop = F.when(F.col("last") == F.col("end"), F.col("last") * zone_len + F.col("last_rows")).otherwise((F.col("last") + 1) * zone_len)
    ranges = written(runs.select((F.col("first") * zone_len).alias("start"), stop.alias("stop")), "zone-ranges")
    # only ranges that touch a stretch's border can go on in the next one, two a stretch at most
    width = 4096 * zone_len
    at_border = (F.col("start") % width == 0) | (F.col("stop") % width == 0)
    inner, outer = ranges.filter(~at_border), ranges.filter(at_border)
    new = outer.alias("b").join(outer.select(F.col("stop").alias("met")), F.col("b.start") == F.col("met"), "left")
    heads = new.filter("met IS NULL").select("start")
    tails = outer.alias("b").join(outer.select(F.col("start").alias("met")), F.col("b.stop") == F.col("met"), "left").filter("met IS NULL").select("stop")
    number = lambda df, c: df.select(F.expr(f"row_number() OVER (ORDER BY {c})").alias("k"), c)
    return inner.union(number(heads, "start").join(number(tails, "stop"), "k").select("start", "stop"))


def prune(rows: DataFrame, zones: DataFrame, predicates: Iterable[Predicate], zone_len: int, offset: str = ROW_OFFSET) -> DataFrame:
    """The rows of surviving zones: all matches, and perhaps others.

    Zones that the map does not have are kept, as nothing is known of them.
    """
    predicates = prunable(predicates, rows.schema)
    if not predicates:
        return rows
    gone = zones.join(surviving(zones, predicates).select(ZONE), ZONE, "left_anti").select(F.col(ZONE).alias("__gone")).distinct()
    return rows.join(gone, zone_of(zone_len, offset) == F.col("__gone"), "left_anti")


def value_bounds(zones: DataFrame, predicates: Iterable[Predicate], rows_of_table: int | None = None) -> Column | None:
    """What every row of a surviving zone fulfils, for the Parquet reader to skip row groups by.

    The values of surviving zones lie between their least minimum and greatest maximum, or
    are null.  A column with a surviving zone whose bounds cannot be relied on gets no bounds, and no column
    does if the map's zones do not make up the whole table.  Costs one job over a stored map.
    """
    predicates = list(predicates)
    names = [c for c in dict.fromkeys(p.column for p in predicates) if f"stats_{c}" in zones.columns]
    if not names:
        return None
    if rows_of_table is not None:
        size = zones.agg(F.sum("rows").alias("n"), F.count_distinct(ZONE).alias("z"), F.count(F.lit(1)).alias("c"), F.max(ZONE).alias("last")).first()
        if size["n"] != rows_of_table or not size["z"] == size["c"] == size["last"] + 1:
            return None
    stats = {c: F.col(f"stats_{c}") for c in names}
    found = surviving(zones, predicates).agg(
        *[F.min(s["lo"]).alias(f"lo_{c}") for c, s in stats.items()], *[F.max(s["hi"]).alias(f"hi_{c}") for c, s in stats.items()],
        *[F.count_if(~usable(s, F.col("rows")) & ~all_null(s, F.col("rows"))).alias(f"gap_{c}") for c, s in stats.items()],
    ).first()
    parts = [F.col(f"`{c}`").isNull() | F.col(f"`{c}`").between(found[f"lo_{c}"], found[f"hi_{c}"]) for c in names if not found[f"gap_{c}"] and found[f"lo_{c}"] is not None]
    return reduce(lambda a, b: a & b, parts) if parts else None


def fingerprint(df: DataFrame) -> str:
    """The files of a table with their sizes and times of change, none of which is opened."""
    files = df.sparkSession.read.format("binaryFile").load(df.inputFiles()).select("path", "length", "modificationTime")
    row = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("s")).first()
    return f"{row['n']}:{row['s']}"


def store_map(df: DataFrame, columns: Iterable[str], zone_len: int, path: str) -> None:
    """Write the zone map of a table of files to path, with what tells whether it still fits."""
    note = json.dumps({"zone_len": zone_len, "of": fingerprint(df)})
    columns = list(dict.fromkeys(columns))
    rows = with_row_offset(df.select(*columns), "__at")
    zone_map(rows, columns, zone_len, "__at").withColumn("note", F.lit(note)).coalesce(1).write.mode("overwrite").parquet(path)


def load_map(spark: SparkSession, df: DataFrame, path: str) -> tuple[DataFrame, int] | None:
    """A stored map and its zone length; None if it is not there, cannot be read, or is not of these files."""
    try:
        zones = spark.read.parquet(path)
        if not {ZONE, "rows", "note"} <= set(zones.columns) or not all(_is_stats(zones.schema[c].dataType) for c in zones.columns if c.startswith("stats_")):
            return None
        if not isinstance(zones.schema[ZONE].dataType, LongType) or not isinstance(zones.schema["rows"].dataType, LongType):
            return None
        notes = zones.select("note").distinct().limit(2).collect()
        note = json.loads(notes[0]["note"]) if len(notes) == 1 else {}
        if note.get("of") != fingerprint(df) or type(note.get("zone_len")) is not int or note["zone_len"] < 1:
            return None
        zones.agg(*[F.max(F.hash(c)) for c in zones.columns]).first()  # a damaged file shows itself here
        return zones.drop("note"), note["zone_len"]
    except (AnalysisException, PySparkException, ValueError, TypeError, AttributeError):
        return None
    except Exception as e:  # noqa: BLE001
        if type(e).__name__ in ("Py4JJavaError", "SparkConnectGrpcException"):  # what reading a damaged file raises
            return None
        raise


def _is_stats(kind) -> bool:
    if not isinstance(kind, StructType):
        return False
    of = {f.name: f.dataType for f in kind.fields}
    return all(isinstance(of.get(c), IntegralType) for c in ("lo", "hi", "null_count")) and all(isinstance(of.get(c), BooleanType) for c in ("lo_truncated", "hi_truncated"))
