"""Rows of metrics: each source fills its own and leaves the others at zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metric_row(df: DataFrame, keys: Sequence[str | Column], metrics: dict[str, str], **own: Column) -> DataFrame:
    """keys and all metrics (name -> type), those not in `own` at zero."""
    filled = [own[name].cast(kind).alias(name) if name in own else F.lit(0).cast(kind).alias(name) for name, kind in metrics.items()]
    return df.select(*keys, *filled)


def by_source(counts: dict[str, Column]) -> Column:
    """An array of (source, ct) for the counts that are positive, in the order given."""
    pairs = F.array(*(F.struct(F.lit(k).alias("source"), v.cast("bigint").alias("ct")) for k, v in counts.items()))
    return F.filter(pairs, lambda p: p["ct"] > 0)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other)
    return out
