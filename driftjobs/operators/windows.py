"""Time windows, replay chunks, newest and oldest rows, and the persistence of anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftjobs.constants import KEY, NEWEST_PER_WINDOW, OLDEST_PER_BASELINE, PERSIST_DOWN, PERSIST_SECONDS, PERSIST_UP, REPLAY_CHUNK
from driftjobs.operators.keys import join_same


def tumbling_windows(obs: DataFrame, duration: str = "15 minutes") -> DataFrame:
    """``obs`` with the event-time window of each row."""
    own = F.window("time", duration)
    return obs.withColumns({"window_start": own["start"], "window_end": own["end"]})


def newest(df: DataFrame, by: Sequence[str], most: int = NEWEST_PER_WINDOW, time: str = "time", tie: str = "request_id") -> DataFrame:
    """The newest rows of each group. Spark keeps no more than ``most`` rows of a group while it sorts."""
    order = Window.partitionBy(*by).orderBy(F.col(time).desc(), F.col(tie))
    return df.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= most).drop("__rank")


def latest(df: DataFrame, by: Sequence[str], time: str = "time") -> DataFrame:
    """The latest row of each group, by partial aggregates instead of a sort; of rows of one time that of the greatest values (``tie``)."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(time, tie(df, rest))).alias("__row")).where(F.col(f"__row.{time}").isNotNull()).select(*by, "__row.*")


def tie(df: DataFrame, columns: Sequence[str]) -> Column:
    """What decides between rows of one time: their columns' values in order, where these have an order."""
    kinds = dict(df.dtypes)
    return F.struct(*[F.to_json(F.struct(F.col(c).alias(c))) if "map<" in kinds[c] or "variant" in kinds[c] else F.col(c) for c in columns])


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column], time: str = "time", grain: str = "day") -> DataFrame:
    """``df`` with ``row_no`` from 0 by ``order`` within ``by``; ``order`` begins with the time. Null keys are keys, null times come first.

    A hot group is no hot task: rows are ranked within a grain of time, and a running sum over the few
    counts of grains gives each grain's offset.
    """
    grained = df.withColumn("__grain", F.date_trunc(grain, time))
    counts = grained.groupBy(*by, "__grain").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__grain").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "__grain", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*by, "__grain").orderBy(*order)
    ranked = join_same(grained.withColumn("__at", F.row_number().over(inside) - 1), offsets, [*by, "__grain"])
    return ranked.withColumn("row_no", F.col("__before") + F.col("__at")).drop("__grain", "__at", "__before")


def replay_chunks(obs: DataFrame, size: int = REPLAY_CHUNK, by: Sequence[str] = ("endpoint_id",)) -> DataFrame:
    """``obs`` with ``chunk``: consecutive rows of each group, ``size`` at a time, the last chunk short."""
    rows = numbered(obs, by, [F.col("time"), F.col("request_id")])
    return rows.withColumn("chunk", F.floor(F.col("row_no") / size).cast("long")).drop("row_no")


def baseline_vectors(vectors: DataFrame, as_of: Column, days: Column | int = 7, most: int = OLDEST_PER_BASELINE, keep: str = "oldest", by: Sequence[str] = KEY) -> DataFrame:
    """The vectors that a baseline as of a time is made of, with ``age``: 0 for the newest of them.

    ``keep`` says which are kept of more than ``most``; "oldest" is how the monitor has always done it.
    """
    start = as_of - F.make_dt_interval(F.lit(days) if isinstance(days, int) else days)
    rows = vectors.where((F.col("window_start") >= start) & (F.col("window_start") <= as_of))
    order = F.col("window_start") if keep == "oldest" else F.col("window_start").desc()
    rows = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("__rank") <= most).drop("__rank")
    return rows.withColumn("age", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("window_start").desc())) - 1)


def anomaly_persistence(scores: DataFrame, by: Sequence[str] = KEY, time: str = "window_start", score: str = "score", state: DataFrame | None = None) -> DataFrame:
    """``scores`` with ``persistence``: how many anomalous windows in a row came before this one.

    A score of 4 or more adds one, one under 2 starts anew, others hold; the count is forgotten 24 hours
    after it last grew. One row a window, so ordering a key's rows in one task is small work. ``state`` says what
    keys had before (``persistence_state``).
    """
    return _persisting(scores, by, time, score, state).where("not __before").drop("__before", "__weight", "__grew", "__lost", "__run")


def persistence_state(scores: DataFrame, by: Sequence[str] = KEY, time: str = "window_start", score: str = "score", state: DataFrame | None = None) -> DataFrame:
    """``by``, ``count`` and ``grew`` (when it last grew) behind the scores, of keys whose count isn't 0 and may still be asked for.

    Later scores come after these; a count that no such one can meet, for it last grew 24 hours before the first of these, goes.
    """
    rows = _persisting(scores, by, time, score, state)
    had = F.when(F.col("__before"), 0).otherwise(F.col("persistence"))
    up, down = F.col(score) >= PERSIST_UP, F.col(score) < PERSIST_DOWN
    after = rows.select(*by, F.col(time).alias("__at"), F.when(up, had + F.col("__weight")).when(down, 0).otherwise(had).alias("count"), F.when(up, F.col(time)).otherwise(F.col("__grew")).alias("grew"), "__before")
    last = after.groupBy(*by).agg(F.max_by(F.struct("count", "grew"), "__at").alias("x")).select(*by, "x.*").where("count > 0")
    first = scores.agg(F.min(time)).first()[0]
    return last if first is None else last.where(F.unix_micros("grew") > F.unix_micros(F.lit(first)) - PERSIST_SECONDS * 1_000_000)


def _persisting(scores: DataFrame, by: Sequence[str], time: str, score: str, state: DataFrame | None) -> DataFrame:
    """``scores`` and a row for what each key had before (``__before``), as if so many windows had come when its count last grew."""
    scores = scores.withColumns({"__before": F.lit(False), "__weight": F.lit(1).cast("long")})
    if state is not None:
        kind = scores.schema[time].dataType
        past = state.select(*by, F.col("grew").cast(kind).alias(time), F.lit(PERSIST_UP).cast(scores.schema[score].dataType).alias(score), F.lit(True).alias("__before"), F.col("count").cast("long").alias("__weight"))
        scores = scores.unionByName(past, allowMissingColumns=True)
    past = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*by).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up, down = F.col(score) >= PERSIST_UP, F.col(score) < PERSIST_DOWN
    rows = scores.withColumn("__grew", F.last(F.when(up, F.col(time)), ignorenulls=True).over(past))
    gap = F.unix_micros(time) - F.unix_micros("__grew")
    rows = rows.withColumn("__lost", F.col("__grew").isNull() | (gap >= PERSIST_SECONDS * 1_000_000))
    resets = F.coalesce(F.sum(F.when(down, 1).otherwise(0)).over(past), F.lit(0))
    restarts = F.sum(F.when(up & F.col("__lost"), 1).otherwise(0)).over(so_far)
    rows = rows.withColumn("__run", resets + restarts)
    run = Window.partitionBy(*by, "__run").orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    count = F.coalesce(F.sum(F.when(up, F.col("__weight")).otherwise(0)).over(run), F.lit(0))
    return rows.withColumn("persistence", F.when(F.col("__lost"), 0).otherwise(count).cast("long"))


def drift_timeline(scores: DataFrame, bucket: str = "1 day", by: Sequence[str] = ("endpoint_id",)) -> DataFrame:
    """Average, greatest score and number of windows by time bucket."""
    own = F.window("window_start", bucket)["start"].alias("bucket")
    return scores.groupBy(*by, own).agg(F.avg("score").alias("avg_score"), F.max("score").alias("max_score"), F.count(F.lit(1)).alias("windows"))
