"""Tables between steps: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from quarry.errors import InvalidData

FOLDER = "spark.checkpoint.dir"
#: Lets Spark delete the shuffle files of a query as soon as it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of areas that are open, and the temporary folder of a process on one machine without a shared one.
_AREAS: list[str] = []
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where none is set, a session on one machine gets a temporary one; on a cluster that is
    an error, as executors would each write to a disk of their own.
    """
    if _AREAS:
        return _AREAS[-1]
    found = spark.conf.get(FOLDER, None)
    if not found:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise InvalidData(f"{FOLDER} must name a folder that the driver and all executors share")
        found = _OWN.setdefault("folder", _OWN.get("folder") or tempfile.mkdtemp(prefix="quarry-"))
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back.

    Unlike cached blocks, the files outlive a lost executor, and their sizes tell Spark
    whether a later join may broadcast them.  The shuffles behind df are done with, and
    their files go, so the disks need to hold those of one step at a time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is stored within leaves no shuffle files behind."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


@contextmanager
def staging_area(spark: SparkSession) -> Iterator[str]:
    """Tables written within go to a folder of their own, which is deleted at the end; results must be stored by then."""
    area = f"{shared_dir(spark)}/area-{uuid.uuid4().hex}"
    _AREAS.append(area)
    try:
        yield area
    finally:
        _AREAS.remove(area)
        path = spark._jvm.org.apache.hadoop.fs.Path(area)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
