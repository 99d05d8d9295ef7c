"""Versioned rows: which state of a record is the current one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findwell.plans.scratch import materialize


def effective_time(updated: str = "updated_at", created: str = "created_at") -> Column:
    """Time of a state: ``updated``, or ``created`` where that is null; null if both are."""
    return F.coalesce(F.col(updated), F.col(created))


def current_rows(states: DataFrame, values: dict[str, Column], key: str = "id") -> DataFrame:
    """One row (key, effective_at, *values) per key: the state of greatest effective time.

    An aggregate with map-side combine, so a key that holds a third of all rows leaves each task
    as one row. Null times lose against any time. States tied in time are ordered by the values,
    so the result doesn't depend on row order. Rows with a null key have no identity and are left
    out. An empty table gives an empty result; further columns are ignored.
    """
    packed = F.struct(effective_time().alias("__at"), *[c.alias(f"__v{i}") for i, c in enumerate(values.values())])
    best = states.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(packed).alias("__s"))
    return best.select(
        F.col("__key").alias(key),
        F.col("__s.__at").alias("effective_at"),
        *[F.col(f"__s.__v{i}").alias(n) for i, n in enumerate(values)],
    )


def current_contents(states: DataFrame, values: list[str], key: str = "id", updated: str = "updated_at", created: str = "created_at") -> DataFrame:
    """(key, *values) of the current rows, for values too long to be moved through an aggregate.

    Which state is current is found from the key and the times alone; the rows are then picked by a
    join with that narrow table, which Spark sends to all tasks where it is small and sorts where it
    isn't, so that long values aren't moved needlessly and superseded ones never. Only keys with several
    rows of the greatest time go through an aggregate of their values (the greatest is taken, so the
    result doesn't depend on row order). Null keys are left out; nulls of time lose against any time.
    """
    rows = states.where(F.col(key).isNotNull())
    at = effective_time(updated, created)
    narrow = rows.select(F.col(key).alias("__key"), at.alias("__at")).groupBy("__key", "__at").agg(F.count(F.lit(1)).alias("__rows"))
    newest = narrow.groupBy("__key").agg(F.max(F.struct("__at", "__rows")).alias("__n")).select("__key", F.col("__n.__at").alias("__newest"), F.col("__n.__rows").alias("__rows"))
    newest = materialize(newest, "newest")  # so that its size is known before the values are read
    picked = rows.select(F.col(key).alias("__id"), at.alias("__at"), *[F.col(v).alias(f"__v{i}") for i, v in enumerate(values)])
    picked = picked.join(newest, (F.col("__id") == F.col("__key")) & F.col("__at").eqNullSafe(F.col("__newest")))
    packed = [f"__v{i}" for i in range(len(values))]
    single = picked.where("__rows = 1").select("__id", *packed)
    tied = picked.where("__rows > 1").groupBy("__id").agg(F.max(F.struct(*packed)).alias("__s")).select("__id", *[F.col(f"__s.{p}").alias(p) for p in packed])
    return single.unionByName(tied).select(F.col("__id").alias(key), *[F.col(p).alias(v) for p, v in zip(packed, values)])
