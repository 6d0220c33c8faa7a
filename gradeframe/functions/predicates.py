"""Predicates made of literals, which reach the scan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_any_of(rows: Iterable[Sequence], columns: Sequence[str]) -> Column:
    """The columns are one of these rows, nulls equal. On partition columns it prunes folders before any read.

    The rows are literals of the plan, so their number must be bounded, as that of a table's partitions is.
    """
    tests = [
        reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(columns, row, strict=True)]) for row in rows
    ]
    while len(tests) > 1:  # balanced, so that many rows don't nest deeply
        tests = [reduce(Column.__or__, tests[i : i + 2]) for i in range(0, len(tests), 2)]
    return tests[0] if tests else F.lit(False)
