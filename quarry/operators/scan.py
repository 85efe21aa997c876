"""The scan: columns in the order asked for, rows in physical order with their positions, zones skipped by statistics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import InvalidData
from quarry.operators.predicates import Predicate, exact_all, prunable
from quarry.plans.zones import ZONE, load_map, prune, value_bounds, zone_map, zone_of
from quarry.sources.tables import ROW_OFFSET, open_table, with_row_offset

BATCH, ZONE_LEN = 65_536, 8192


def project(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """None: all columns; an empty list: rows without columns; a name may come more than once."""
    if columns is None:
        return df
    for c in columns:
        if c not in df.columns:
            raise InvalidData(f"no column {c!r}")
    return df.select(*columns)


def scan(
    spark: SparkSession,
    source: str | DataFrame,
    columns: Sequence[str] | None = None,
    predicates: Iterable[Predicate] = (),
    *,
    zones: DataFrame | str | None = None,
    zone_len: int = ZONE_LEN,
    exact: bool = False,
    row_offset: bool = False,
) -> DataFrame:
    """Rows of a Parquet path, or of a DataFrame that has its ``row_offset``.

    Predicates, all of which must hold, skip zones only, so the result may hold rows that
    do not match; with exact they are applied to each row as well.  Predicates on columns
    that are not signed integers skip nothing.  Columns of predicates need not be among
    those returned.

    zones is the path of a map written by `store_map`, or a map as a DataFrame.  The bounds of
    its surviving zones are handed to the Parquet reader, which skips row groups by them, so that
    less is read; a stored map that is not of this version of the table, or cannot be
    read, skips nothing.  Without a map one is built from the predicates' columns, which
    gives the same rows but saves no reading.

    A column of a file that is called row_offset is an ordinary one; positions cannot be
    asked for beside it.
    """
    predicates = list(predicates)
    from_files = isinstance(source, str)
    df = open_table(spark, source).df if from_files else source
    at = "__row_offset" if from_files else ROW_OFFSET
    if from_files and at in df.columns or row_offset and from_files and ROW_OFFSET in df.columns:
        raise InvalidData(f"{source} has a column for positions of its own")
    if not from_files and ROW_OFFSET not in df.columns and (row_offset or prunable(predicates, df.schema)):
        df = with_row_offset(df)
    names = [c for c in df.columns if from_files or c != ROW_OFFSET] if columns is None else list(columns)
    wanted = prunable(predicates, df.schema)
    rows = with_row_offset(df, at) if from_files and (wanted or row_offset) else df
    if wanted:
        rows = _skip(spark, df, rows, zones, wanted, zone_len, at)
    if exact:
        rows = rows.filter(exact_all(predicates))
    if row_offset and from_files:
        rows = rows.withColumnRenamed(at, ROW_OFFSET)
    return project(rows, [*names, ROW_OFFSET] if row_offset and ROW_OFFSET not in names else names)


def _skip(spark, df, rows, zones, wanted, zone_len, at):
    if isinstance(zones, str):
        found = load_map(spark, df, zones)
        if found is None:
            return rows
        zones, zone_len = found
    if zones is None:
        columns = list(dict.fromkeys(p.column for p in wanted))
        zones = zone_map(rows.select(at, *columns), columns, zone_len, at)
    elif (bounds := value_bounds(zones, wanted, df.select().count())) is not None:
        rows = rows.filter(bounds)
    return prune(rows, zones, wanted, zone_len, at)


def number_batches(rows: DataFrame, batch_size: int = 0, zone_len: int | None = None) -> DataFrame:
    """rows, with their ``row_offset``, and the ``batch`` each is in: batches end at batch_size rows and at zones' ends."""
    if batch_size < 0:
        raise InvalidData("a batch cannot have a negative size")
    size = batch_size or BATCH
    if zone_len is None:
        return rows.withColumn("batch", F.expr(f"{ROW_OFFSET} DIV {size}"))
    zone_of(zone_len)  # refuses lengths below one
    return rows.withColumn("batch", F.expr(f"({ROW_OFFSET} DIV {zone_len}) * {-(-zone_len // size)} + ({ROW_OFFSET} % {zone_len}) DIV {size}"))


def record_batches(rows: DataFrame, batch_size: int = 0) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(offset of the first row, batch) in physical order; for consumers outside Spark.

    Spark sorts ranges of positions apart and hands over Arrow batches, a partition at a
    time; a batch ends where positions do not run on.
    """
    size = batch_size or BATCH
    if batch_size < 0:
        raise InvalidData("a batch cannot have a negative size")
    ordered = rows.orderBy(ROW_OFFSET)
    schema = rows.limit(0).toArrow().schema
    names = [c for c in rows.columns if c != ROW_OFFSET]

    def packed(batches):
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["data"])

    held = schema.empty_table()

    def full(table: pa.Table, end: bool):
        """(whole batches, what may still grow)."""
        out = []
        while len(table):
            at = table[ROW_OFFSET].to_numpy()
            breaks = (at[1:] != at[:-1] + 1).nonzero()[0]
            n = min(size, int(breaks[0]) + 1 if len(breaks) else len(at))
            if n == len(at) < size and not end:
                break
            out.append((int(at[0]), table.slice(0, n).select(names).combine_chunks().to_batches()))
            table = table.slice(n)
        return out, table

    def one(offset, batches, n):
        return offset, batches[0] if batches else pa.RecordBatch.from_struct_array(pa.array([{}] * n, pa.struct([])))

    for row in ordered.mapInArrow(packed, "data binary").toLocalIterator(prefetchPartitions=True):
        held = pa.concat_tables([held, pa.ipc.open_stream(row["data"]).read_all().cast(schema)])
        done, held = full(held, False)
        yield from (one(o, b, 0) for o, b in done)
    done, _ = full(held, True)
    yield from (one(o, b, 0) for o, b in done)


def delete_positions(rows: DataFrame, deletes: DataFrame) -> DataFrame:
    """rows without those whose ``row_offset`` is among the deletes'."""
    return rows.join(deletes.select(ROW_OFFSET).distinct(), ROW_OFFSET, "left_anti")


def concat_chunks(chunks: Sequence[DataFrame]) -> DataFrame:
    """Chunks one after another; positions run on, each chunk counting its own from 0."""
    if not chunks:
        raise InvalidData("there is no chunk")
    start, out = 0, None
    for chunk in chunks:
        if chunk.columns != chunks[0].columns:
            raise InvalidData("chunks differ in their columns")
        moved = chunk.withColumn(ROW_OFFSET, F.col(ROW_OFFSET) + F.lit(start))
        start += chunk.select().count()
        out = moved if out is None else out.unionByName(moved)
    return out


__all__ = ["BATCH", "ZONE", "ZONE_LEN", "concat_chunks", "delete_positions", "number_batches", "project", "record_batches", "scan"]
