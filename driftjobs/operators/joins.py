"""Joins with what was valid at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftjobs.constants import KEY
from driftjobs.operators.keys import join_same
from driftjobs.operators.windows import latest, tie


def live_only(df: DataFrame) -> DataFrame:
    """Rows that are not deleted."""
    return df.where(F.col("deleted_at").isNull())


def with_active(snapshots: DataFrame, by: Sequence[str] = KEY, time: str = "time") -> DataFrame:
    """Append-only snapshots with ``is_active``: the latest of each key."""
    order = Window.partitionBy(*by).orderBy(F.col(time).desc())
    return snapshots.withColumn("is_active", F.row_number().over(order) == 1)


def active_baselines(snapshots: DataFrame, by: Sequence[str] = KEY, time: str = "time") -> DataFrame:
    return latest(snapshots, by, time)


def join_active_baseline(windows: DataFrame, snapshots: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Left join of each key's latest snapshot. Spark broadcasts it if its measured size is small."""
    return join_same(windows, active_baselines(snapshots, by), by, "left")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], grain: str = "day") -> DataFrame:
    """``left`` with the ``values`` of the latest row of ``right`` not after its time, null if there is none; null keys and times find none.

    Within a grain of time both sides pass in one order, so a busy key spreads over its grains. What is
    valid at a grain's start is carried over from the grains before it, of which a key has one row each. Rows that
    can find nothing are set aside and don't move. Of rows of ``right`` of one time that of the greatest values counts.
    """
    rest = [c for c in left.columns if c not in by]
    fine = lambda time: F.col(time).isNotNull() & ~F.greatest(*[F.col(c).isNull() for c in (*by, *by)])
    at = lambda time: F.date_trunc(grain, time).alias("__grain")
    key = [*by, "__grain"]
    known = right.where(fine(right_time)).select(*by, at(right_time), F.col(right_time).alias("__t"), tie(right, values).alias("__tie"), F.struct(*values).alias("__right"))
    ends = known.groupBy(*key).agg(F.max_by("__right", F.struct("__t", "__tie")).alias("__last"))
    grains = ends.select(*key, "__last").unionByName(left.where(fine(left_time)).select(*by, at(left_time)).distinct(), allowMissingColumns=True)
    grains = grains.groupBy(*key).agg(F.first("__last", ignorenulls=True).alias("__last"))
    before = Window.partitionBy(*by).orderBy("__grain").rowsBetween(Window.unboundedPreceding, -1)
    opening = grains.select(*key, F.last("__last", ignorenulls=True).over(before).alias("__right"), F.lit(0).alias("__side")).where("__right is not null")
    a = left.where(fine(left_time)).select(*by, at(left_time), F.col(left_time).alias("__t"), F.lit(2).alias("__side"), F.struct(*rest).alias("__left"))
    both = a.unionByName(known.withColumn("__side", F.lit(1)), allowMissingColumns=True).unionByName(opening, allowMissingColumns=True)
    seen = Window.partitionBy(*key).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__found", F.last("__right", ignorenulls=True).over(seen)).where("__side = 2")
    found = found.select(*by, "__left.*", *[F.col("__found")[v].alias(v) for v in values])
    kinds = dict(right.dtypes)
    aside = left.where(~F.coalesce(fine(left_time), F.lit(False))).select(*by, *rest, *[F.lit(None).cast(kinds[v]).alias(v) for v in values])
    return found.unionByName(aside)


def join_baseline_asof(windows: DataFrame, snapshots: DataFrame, values: Sequence[str], by: Sequence[str] = KEY) -> DataFrame:
    """The snapshot that was active when each window ended."""
    return asof_join(windows, snapshots, by, "window_end", "time", values)


def join_latest_deployment(df: DataFrame, endpoints: DataFrame, deployments: DataFrame, as_of: Column) -> DataFrame:
    """``df`` with ``deployed_at`` of its project's latest deployment not after ``as_of``, and the hours since."""
    projects = live_only(endpoints).select(F.col("id").alias("endpoint_id"), "project_id")
    rows = df.withColumn("__as_of", as_of).join(projects, "endpoint_id", "left")
    found = asof_join(rows, deployments, ["project_id"], "__as_of", "deployed_at", ["deployed_at"])
    hours = (F.unix_micros("__as_of") - F.unix_micros("deployed_at")) / 3.6e9
    return found.withColumn("deployment_recency_hours", hours).drop("__as_of")
