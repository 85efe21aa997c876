"""What the corpus operators have in common: text folding, row identity, shared tables."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.staging import shuffles_dropped, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: Column | str) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` does just that to a text whose characters are single bytes, and is much
    faster than ``translate``, which only the other texts need.
    """
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, string.ascii_uppercase, string.ascii_lowercase)
    )


def row_key(text: Column) -> Column:
    """Tells rows apart that share a doc_id but not a text."""
    return F.xxhash64(text)


__all__ = ["ascii_lower", "row_key", "shuffles_dropped", "table", "whole_text", "written"]
