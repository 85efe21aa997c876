"""Tables to scan: schema and row count without reading data, and physical row positions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.errors import InvalidData

ROW_OFFSET = "row_offset"


@dataclass
class Table:
    """A Parquet table; opening it reads footers only."""

    spark: SparkSession
    path: str

    @cached_property
    def df(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    @property
    def schema(self) -> StructType:
        return self.df.schema

    def num_rows(self) -> int:
        """From row-group metadata: the plan reads no column."""
        return self.df.select().count()

    def with_row_offset(self) -> DataFrame:
        return with_row_offset(self.df)


def open_table(spark: SparkSession, path: str) -> Table:
    table = Table(spark, path)
    names = table.schema.names
    if len(set(names)) != len(names):
        raise InvalidData(f"{path} has a column name more than once")
    return table


def with_row_offset(df: DataFrame, name: str = ROW_OFFSET) -> DataFrame:
    """df, read from files, with each row's physical position as a column of that name.

    Within a file it is Parquet's row index.  Files follow each other by name: their row
    counts, a row per file and taken from metadata, are summed up and joined; a table of
    one file needs no join.  The position does not depend on what is filtered later.
    """
    if name in df.columns:
        raise InvalidData(f"the table has a column {name!r} of its own; give positions another name")
    if len(df.inputFiles()) <= 1:
        return df.withColumn(name, F.col("_metadata.row_index"))
    sizes = df.select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("file").alias("__file"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    placed = df.withColumns({"__path": F.col("_metadata.file_path"), "__index": F.col("_metadata.row_index")})
    # a row per file of the table, which the driver lists in any case
    placed = placed.join(F.broadcast(starts), F.col("__path") == F.col("__file"))
    return placed.withColumn(name, F.col("__start") + F.col("__index")).drop("__path", "__index", "__file", "__start")
