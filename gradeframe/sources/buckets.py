"""Tables written in buckets of their keys, so that joins and windows on these keys need no shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int, name: str | None = None) -> DataFrame:
    """Write a table at ``path`` in buckets by a hash of ``keys``, sorted within each, and return it as a table.

    Rows are dealt to the buckets before they are written, so there is one file per bucket and not one per
    bucket and task. Two tables are co-located if keys, their types and the number of buckets agree.
    """
    name = name or f"bucketed_{uuid.uuid4().hex[:12]}"
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)
