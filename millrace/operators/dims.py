"""Dimension joins: any number of look-ups, missing rows give nulls.

Whether a dimension is broadcast is left to the planner's size threshold, which sees sizes as they are at run time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DimSpec:
    """A look-up: the fact's column `fk` meets the dimension's `key`; columns maps new names to columns or expressions.

    at: the fact's time, if the dimension has versions (see versions_of) and the one in force then is meant."""

    table: DataFrame
    fk: str
    columns: dict[str, str | Column]
    key: str = "id"
    drop: Sequence[str] = field(default_factory=tuple)
    at: str | None = None


def versions_of(changes: DataFrame, keys: Sequence[str], ts: str = "ts", order: str = "seq", op: str | None = None) -> DataFrame:
    """The rows of a dimension's change log with the time each was in force, [since, until): to the next one of its key; until is
    null for the last one. Of rows of one time the last by `order` counts. op: a column in which '-D' ends a key's row."""
    by = Window.partitionBy(*keys).orderBy(ts, order)
    lasting = changes.withColumn("until", F.lead(ts).over(by)).filter(F.col("until").isNull() | (F.col("until") > F.col(ts)))
    lasting = lasting.withColumnRenamed(ts, "since").drop(order)
    return lasting.filter(F.col(op) != "-D").drop(op) if op else lasting


def join_dims(df: DataFrame, specs: Sequence[DimSpec]) -> DataFrame:
    """Left joins in the order given, so a look-up can use what an earlier one found."""
    for k, spec in enumerate(specs):
        name = f"__dim{k}"
        times = [F.col("since").alias(f"{name}_since"), F.col("until").alias(f"{name}_until")] if spec.at else []
        dim = spec.table.select(F.col(spec.key).alias(name), *times, *((F.col(c) if isinstance(c, str) else c).alias(new) for new, c in spec.columns.items()))
        # Storage keeps dimensions as strings: keys meet in the fact's type.
        kind = df.schema[spec.fk].dataType
        on = F.col(spec.fk) == F.col(name)
        if spec.at:
            on &= (F.col(spec.at) >= F.col(f"{name}_since")) & (F.col(f"{name}_until").isNull() | (F.col(spec.at) < F.col(f"{name}_until")))
        df = df.join(dim.withColumn(name, F.col(name).cast(kind)), on, "left").drop(name, f"{name}_since", f"{name}_until", *spec.drop)
    return df
