"""Comparisons of a column with a 64-bit integer: as proof that a zone holds no match, and as exact filters."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StructType

from quarry.errors import InvalidData

OPS = ("EQ", "NEQ", "GT", "GTE", "LT", "LTE")
SIGNED = (ByteType, ShortType, IntegerType, LongType)


@dataclass(frozen=True)
class Predicate:
    column: str
    op: str
    value: int

    def __post_init__(self):
        if self.op not in OPS:
            raise InvalidData(f"unknown comparison {self.op!r}")
        if type(self.value) is not int or not -(1 << 63) <= self.value < 1 << 63:
            raise InvalidData(f"columns are compared with 64-bit integers, not with {self.value!r}")


def prunable(predicates: Iterable[Predicate], schema: StructType) -> list[Predicate]:
    """Those on signed integers; the others never prune.  A column that is not there is an error."""
    predicates = list(predicates)
    for p in predicates:
        if p.column not in schema.names:
            raise InvalidData(f"no column {p.column!r}")
    return [p for p in predicates if isinstance(schema[p.column].dataType, SIGNED)]


def exact(p: Predicate) -> Column:
    """NEQ holds for nulls, the other comparisons do not."""
    c, v = F.col(p.column), F.lit(p.value)
    return {"EQ": c == v, "NEQ": ~c.eqNullSafe(v), "GT": c > v, "GTE": c >= v, "LT": c < v, "LTE": c <= v}[p.op]


def exact_all(predicates: Iterable[Predicate]) -> Column:
    return reduce(lambda a, b: a & b, map(exact, predicates), F.lit(True))


def usable(stats: Column, rows: Column) -> Column:
    """Whether bounds can be relied on: there, whole, and not at odds with themselves or the zone's size; never null."""
    lo, hi, nulls = stats["lo"], stats["hi"], stats["null_count"]
    whole = ~F.coalesce(stats["lo_truncated"], F.lit(True)) & ~F.coalesce(stats["hi_truncated"], F.lit(True))
    return F.coalesce(stats.isNotNull() & whole & (lo <= hi) & F.coalesce((nulls >= 0) & (nulls <= rows), F.lit(True)), F.lit(False))


def all_null(stats: Column, rows: Column) -> Column:
    return F.coalesce(stats["null_count"] == rows, F.lit(False))


def excludes(p: Predicate, stats: Column, rows: Column) -> Column:
    """True where a zone's statistics prove that none of its rows match; never null.

    stats is a struct ``lo, hi, null_count, lo_truncated, hi_truncated``.  Statistics that
    are missing, cut off or at odds with themselves prove nothing.
    """
    lo, hi, nulls = stats["lo"], stats["hi"], stats["null_count"]
    v = F.lit(p.value).cast("long")
    known_full = F.coalesce(nulls == 0, F.lit(False))
    proof = {
        "EQ": (v < lo) | (v > hi), "NEQ": known_full & (lo == hi) & (lo == v), "GT": hi <= v, "GTE": hi < v, "LT": lo >= v, "LTE": lo > v,
    }[p.op]
    return (
        F.when(stats.isNull() | F.coalesce((nulls > rows) | (nulls < 0), F.lit(False)), False)
        .when(all_null(stats, rows) & F.lit(p.op != "NEQ"), True)
        .when(~usable(stats, rows), False)
        .otherwise(F.coalesce(proof, F.lit(False)))
    )
