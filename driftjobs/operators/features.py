"""Feature vectors of windows: response level, and by field of the payload.

``by`` names the columns of a window's key, so that time windows and replay chunks share the code. Null keys are keys.

Everything that a vector holds is drawn from counted values: how often a window has a latency, a status code, or a value under
a path of its payloads. Counts of parts of a window add up, so a batch and the state of a stream hold the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftjobs.constants import MAX_ENUM, MAX_FIELDS, MAX_VOCABULARY
from driftjobs.functions.payload import canonicalize, read_payload
from driftjobs.operators.keys import join_same
from driftjobs.sources.io import written

LATENCY_QUANTILES = (0.5, 0.95, 0.99)
FIELD_QUANTILES = (0.25, 0.5, 0.75, 0.95, 0.99)
SHARES = (0.25, 0.5, 0.75, 0.95, 0.99)
#: A value: what it is a value of (``part``, and for leaves of payloads the path), its kind, and the value as number, text and length.
VALUE = ("part", "path", "kind", "num", "str", "len")
NUMBERS = ("int", "float", "bool")
SMALL_BYTES = 64 << 20


def _array(values: Sequence[float]):
    return F.array(*[F.lit(v) for v in values])


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Exact quantiles of each group, with linear interpolation: ``by`` and an array ``q``; groups without values have no row.

    Equal values are counted before they move, and ranks are running counts over a group's distinct values
    in order, which spill to disk: no group lies in memory, however many values it has.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    group = Window.partitionBy(*by)
    ranked = counts.withColumns({"__upto": F.sum("__n").over(group.orderBy("__v")), "__all": F.sum("__n").over(group)})
    last = F.col("__all") - 1
    at = lambda rank: F.min(F.when(F.col("__upto") > rank, F.col("__v")))

    def quantile(share: float) -> Column:
        rank = last * share
        low, high = F.floor(rank), F.ceil(rank)
        part = F.max(rank - low)
        return at(low) * (1 - part) + at(high) * part

    return ranked.groupBy(*by).agg(F.array(*[quantile(s) for s in shares]).alias("q"))


def _latency_sketch(obs: DataFrame, by: Sequence[str], shares: Sequence[float], accuracy: int) -> DataFrame:
    return obs.groupBy(*by).agg(F.percentile_approx("latency_ms", _array(shares), F.lit(accuracy)).alias("__q"))


def latency_stats_approx(obs: DataFrame, by: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """Latency quantiles from a sketch of fixed size: elements of the data, without interpolation, whose ranks may be off. ``latency_stats_ranked`` has the right ones."""
    rows = _latency_sketch(obs, by, LATENCY_QUANTILES, accuracy)
    return rows.select(*by, *[F.col("__q")[i].cast("double").alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


def latency_stats_ranked(obs: DataFrame, by: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """Latency quantiles as elements of the data: exactly those of rank ceil(share * n), from a sketch and counts. Groups without latencies have no row.

    The sketch cuts a group's latencies into ranges, a narrow one about each quantile. Rows are counted by range, and only in ranges
    that such a rank falls into by value; so a hot group is neither moved nor ranked as a whole. Which ranges these are
    the counts say: cuts that are off cost time and change nothing.
    """
    rows = obs.where(F.col("latency_ms").isNotNull()).select(*by, "latency_ms")
    about = sorted({min(max(s + d / accuracy, 0.0), 1.0) for s in LATENCY_QUANTILES for d in (-2, 2)})
    cuts = written(_latency_sketch(rows, by, about, accuracy))
    cut = join_same(rows, cuts, by).withColumn("__range", F.size(F.filter("__q", lambda c: c < F.col("latency_ms")))).drop("__q")
    group = Window.partitionBy(*by)
    counts = cut.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n")).withColumns({"__upto": F.sum("__n").over(group.orderBy("__range")), "__all": F.sum("__n").over(group)})
    ranks = [F.greatest(F.ceil(F.lit(Decimal(str(s))) * F.col("__all")).cast("long"), F.lit(1)) - (F.col("__upto") - F.col("__n")) for s in LATENCY_QUANTILES]
    asked = counts.select(*by, "__range", F.array(*[F.when(r.between(1, F.col("__n")), r) for r in ranks]).alias("__ranks"))
    asked = written(asked.where(F.exists("__ranks", lambda r: r.isNotNull())))
    values = join_same(cut, asked, [*by, "__range"]).groupBy(*by, "__range", "__ranks", F.col("latency_ms").cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = values.withColumn("__upto", F.sum("__n").over(Window.partitionBy(*by, "__range").orderBy("__v")))
    return ranked.groupBy(*by).agg(*[F.min(F.when(F.col("__upto") >= F.col("__ranks")[i], F.col("__v"))).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


def status_distribution(obs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of each status code among rows that have one."""
    counts = obs.where(F.col("status_code").isNotNull()).groupBy(*by, F.col("status_code").cast("string").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    return counts.select(*by, "code", "n", F.round(share, 6).alias("rate"))


def payload_entropy(obs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Shannon entropy in bits of non-empty payload hashes: sums over counts, so that nothing is collected."""
    counts = obs.where("payload_hash <> ''").groupBy(*by, "payload_hash").agg(F.count(F.lit(1)).cast("double").alias("n"))
    sums = counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    return sums.select(*by, F.round(F.log2("n") - F.col("nlogn") / F.col("n"), 4).alias("payload_entropy"))


def hashed_payloads(obs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of each payload only what ``window_schema_hash`` needs; nothing is written."""
    hashed = obs.where("payload_sample is not null").select(*by, "time", "request_id", canonicalize("payload_sample").alias("c"))
    return hashed.select(*by, "time", "request_id", "c.is_object", "c.schema_hash")


def window_schema_hash(payloads: DataFrame, by: Sequence[str]) -> DataFrame:
    """Hash of the types of the newest payload that is an object, and its short version."""
    order = F.struct(-F.unix_micros("time"), "request_id")
    newest = payloads.where("is_object").groupBy(*by).agg(F.min_by("schema_hash", order).alias("schema_hash"))
    return newest.withColumn("schema_version", F.concat(F.lit("v:"), F.substring("schema_hash", 1, 8)))


def values_of(obs: DataFrame, by: Sequence[str], payloads: bool = True) -> DataFrame:
    """A row for each value that counts in a window: VALUE, and ``seen``, whose least is the first (the newest row is first).

    Each row gives one of part "row", its latency, size, status code and non-empty payload hash; with ``payloads`` also
    "payload" if that is JSON, "schema" (the hash of an object's types) and its leaves: "visit" for each path, and a row for each value.
    """

    def value(part: str, fits: Column | None = None, kind: str | None = None, num: Column | None = None, text: Column | None = None) -> Column:
        found = F.struct(F.lit(part).alias("part"), F.lit(None).cast("string").alias("path"), F.lit(kind).cast("string").alias("kind"), (F.lit(None) if num is None else num).cast("double").alias("num"), (F.lit(None) if text is None else text).cast("string").alias("str"), F.lit(None).cast("int").alias("len"), F.lit(0).alias("pos"))
        return found if fits is None else F.when(fits, found)

    latency, size, code = F.col("latency_ms"), F.col("response_size_bytes"), F.col("status_code")
    own = [value("row"), value("latency", latency.isNotNull(), "float", latency), value("size", size.isNotNull(), "float", size), value("status", code.isNotNull(), "str", text=code), value("hash", F.col("payload_hash") != "", "str", text=F.col("payload_hash"))]
    rows = obs.withColumn("__p", read_payload("payload_sample")) if payloads else obs
    if payloads:
        own += [value("payload", F.col("__p.parsed")), value("schema", F.col("__p.is_object"), "str", text=F.col("__p.schema_hash"))]
    found = F.array_compact(F.array(*own))
    if payloads:
        leaves = F.transform("__p.leaves", lambda x, i: F.struct(F.lit("leaf").alias("part"), x["path"].alias("path"), x["kind"].alias("kind"), x["num"].alias("num"), x["str"].alias("str"), x["len"].alias("len"), i.alias("pos")))
        found = F.concat(found, F.coalesce(leaves, F.array()))
    rows = rows.select(*by, "time", "request_id", F.explode(found).alias("__v"))
    seen = F.struct((-F.unix_micros("time")).alias("at"), "request_id", F.col("__v.pos").alias("pos"))
    return rows.select(*by, "time", *[F.col(f"__v.{c}").alias(c) for c in VALUE], seen.alias("seen"))


def counted(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """``values`` counted: ``n`` and the first ``seen``. Parts of a window may be counted apart and the counts summed (``summed``)."""
    return values.groupBy(*by, *VALUE).agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("seen"))


def summed(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts of parts of windows as counts of whole windows."""
    return counts.groupBy(*by, *VALUE).agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))


def count_values(obs: DataFrame, by: Sequence[str], payloads: bool = True) -> DataFrame:
    """Counted values of whole windows, written for what reads them: each payload is parsed once."""
    return written(counted(values_of(on_all_cores(obs) if payloads else obs, by, payloads), by))


def on_all_cores(obs: DataFrame) -> DataFrame:
    """``obs``, dealt out over all cores if it is small (SMALL_BYTES): it may lie in one file then, and parsing is more work than moving it."""
    if obs.isStreaming or int(str(obs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL_BYTES:
        return obs
    return obs.repartition(obs.sparkSession.sparkContext.defaultParallelism)


def summaries(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row for each window, part and path: how many values of each kind, moments, exact quantiles, words and their shares.

    Counts move once, to the task of their window and path. There means and ranks are sums over a group's distinct values in
    order, which spill to disk: no group lies in memory. Deviations are taken from the mean, so great
    numbers that differ little keep their spread. A path gathers its words only if there are MAX_ENUM at most.
    """
    group = [*by, "part", "path"]
    kind = F.col("kind")
    rows = counts.repartition(*group).withColumns({
        "__g": F.when(kind.isin(*NUMBERS), F.lit("num")).otherwise(F.coalesce(kind, F.lit(""))),
        "__x": F.when(kind.isin(*NUMBERS), F.col("num")).when(kind.isin("str", "list"), F.col("len").cast("double")),
    })
    own = Window.partitionBy(*group, "__g")
    n = F.when(F.col("__x").isNotNull(), F.col("n")).otherwise(0)
    rows = rows.withColumns({
        "__all": F.sum(n).over(own),
        "__mean": F.sum(F.col("n") * F.col("__x")).over(own) / F.nullif(F.sum(n).over(own), F.lit(0)),
        "__upto": F.sum(n).over(own.orderBy("__x")),
        "__words": F.count(F.lit(1)).over(own),
        "__total": F.sum("n").over(own),
    })
    of = lambda g, c: F.when(F.col("__g") == g, c)
    amount = lambda fits: F.coalesce(F.sum(F.when(fits, F.col("n"))), F.lit(0))
    square = F.col("n") * F.pow(F.col("__x") - F.col("__mean"), 2)

    def quantile(share: float) -> Column:
        rank = (F.col("__all") - 1) * F.lit(share)
        at = lambda r: F.min(of("num", F.when(F.col("__upto") > r, F.col("__x"))))
        part = F.max(of("num", rank - F.floor(rank)))
        return at(F.floor(rank)) * (1 - part) + at(F.ceil(rank)) * part

    def deviation(g: str) -> Column:
        over = F.max(of(g, F.col("__all"))) - 1
        return F.when(over > 0, F.sqrt(F.sum(of(g, square)) / over))

    total = F.max(of("str", F.col("__total"))).cast("double")
    listed = (F.col("__words") <= MAX_ENUM) | (F.col("part") == "status")
    words = F.collect_list(of("str", F.when(listed, F.struct("str", F.round(F.col("n") / F.col("__total"), 6)))))
    kinds = ("visit", "null", "str", *NUMBERS, "list")
    return rows.groupBy(*group).agg(
        F.sum("n").alias("n_all"),
        *[amount(kind == k).alias(f"n_{k}") for k in kinds],
        *[F.min(F.when(kind == k, F.col("seen"))).alias(f"first_{k}") for k in kinds],
        F.min(F.struct("seen", "str")).alias("first_word"),
        *[F.max(of(g, F.col("__mean"))).alias(f"{g}_mean") for g in ("num", "str", "list")],
        *[deviation(g).alias(f"{g}_std") for g in ("num", "str", "list")],
        F.min(of("num", F.col("__x"))).alias("num_min"),
        F.max(of("num", F.col("__x"))).alias("num_max"),
        (F.sum(F.when(kind == "bool", F.col("n") * F.col("__x"))) / F.sum(F.when(kind == "bool", F.col("n")))).alias("true_share"),
        F.array(*[quantile(s) for s in SHARES]).alias("q"),
        F.max(of("str", F.col("__words"))).alias("n_words"),
        (F.log2(total) - F.sum(of("str", F.col("n") * F.log2("n"))) / total).alias("entropy"),
        F.map_from_entries(F.array_sort(words)).alias("shares"),
    )


def response_level(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """The response-level vector of each window from ``summaries``; statistics of no values are 0."""
    of = lambda part, c: F.first(F.when(F.col("part") == part, c), ignorenulls=True)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    q = dict(zip(SHARES, (F.col("q")[k] for k in range(len(SHARES))), strict=True))
    schema = of("schema", F.col("first_word.str"))
    return found.where("part <> 'leaf'").groupBy(*by).agg(
        F.coalesce(of("row", F.col("n_all")), F.lit(0)).alias("sample_count"),
        zero(of("latency", F.col("num_mean"))).alias("mean"),
        zero(of("latency", F.col("num_std"))).alias("std"),
        zero(of("size", F.col("num_mean"))).alias("size_mean"),
        zero(of("size", F.col("num_std"))).alias("size_std"),
        *[zero(of("latency", q[share])).alias(name) for share, name in zip(LATENCY_QUANTILES, ("p50", "p95", "p99"), strict=True)],
        zero(of("size", q[0.95])).alias("size_p95"),
        F.coalesce(of("status", F.col("shares")), F.create_map().cast("map<string,double>")).alias("status_codes"),
        F.abs(zero(of("hash", F.round("entropy", 4)))).alias("payload_entropy"),
        schema.alias("schema_hash"),
        F.concat(F.lit("v:"), F.substring(schema, 1, 8)).alias("schema_version"),
    )


def response_stats(obs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sample count, latency and size statistics, from counted values: one scan."""
    rows = response_level(summaries(counted(values_of(obs, by, payloads=False).where(F.col("part").isin("row", "latency", "size")), by), by), by)
    return rows.drop("status_codes", "payload_entropy", "schema_hash", "schema_version")


def response_features(obs: DataFrame, by: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """The response-level vector of each window, status shares as a map. ``counts`` are those of ``count_values``, if they are at hand."""
    counts = counted(values_of(obs, by).where("part <> 'leaf'"), by) if counts is None else counts.where("part <> 'leaf'")
    return response_level(summaries(counts, by), by)


def field_features(counts: DataFrame, by: Sequence[str], most: int = MAX_FIELDS) -> DataFrame:
    """One row for each window and path that has values: presence, nulls, types, and statistics of the dominant type.

    The newest row is the first; among equally common types the first seen is dominant. Paths beyond the
    ``most`` most present are left out, later seen ones first.
    """
    totals = counts.where("part = 'payload'").select(*by, F.col("n").alias("payloads"))
    return fields_of(summaries(counts.where("part = 'leaf'"), by), totals, by, most)


def fields_of(found: DataFrame, totals: DataFrame, by: Sequence[str], most: int = MAX_FIELDS) -> DataFrame:
    kinds = ("str", *NUMBERS, "list")
    rows = found.where("part = 'leaf'").withColumn("n_values", F.col("n_all") - F.col("n_visit")).where("n_values > 0")
    rows = join_same(rows, totals, by)
    common = F.array_max(F.array(*[F.col(f"n_{k}") for k in kinds]))
    candidates = [F.when((F.col(f"n_{k}") == common) & (common > 0), F.struct(F.col(f"first_{k}").alias("at"), F.lit(k).alias("kind"))) for k in kinds]
    rows = rows.withColumn("kind", F.array_min(F.array_compact(F.array(*candidates)))["kind"])
    non_null = F.col("n_values") - F.col("n_null")
    numeric, text, items = F.col("kind").isin("int", "float"), F.col("kind") == "str", F.col("kind") == "list"
    when_number = lambda c: F.when(numeric & F.col("num_mean").isNotNull(), F.round(c, 6))
    deviation = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    names = {"str": "string", "int": "number", "float": "number", "bool": "boolean", "list": "array"}
    rows = rows.select(
        *by,
        "path",
        F.least("first_null", *[f"first_{k}" for k in kinds]).alias("first_seen"),
        F.round(F.col("n_visit") / F.col("payloads"), 6).alias("presence_rate"),
        F.round(F.col("n_null") / F.col("n_values"), 6).alias("null_rate"),
        F.coalesce(F.round(common / F.nullif(non_null, F.lit(0)), 6), F.lit(0.0)).alias("type_consistency"),
        F.coalesce(F.create_map(*[F.lit(x) for p in names.items() for x in p])[F.col("kind")], F.lit("null")).alias("dominant_type"),
        F.when(F.col("kind") == "bool", F.round("true_share", 6)).otherwise(when_number(F.col("num_mean"))).alias("mean"),
        when_number(deviation("num_std")).alias("std"),
        *[when_number(F.col("q")[i]).alias(n) for i, n in enumerate(("p25", "p50", "p75", "p95", "p99"))],
        when_number(F.col("num_min")).alias("min_val"),
        when_number(F.col("num_max")).alias("max_val"),
        F.when(text, F.round("str_mean", 6)).when(items, F.round("list_mean", 6)).alias("mean_length"),
        F.when(text, F.round(deviation("str_std"), 6)).when(items, F.round(deviation("list_std"), 6)).alias("std_length"),
        F.when(text, F.least("n_words", F.lit(MAX_VOCABULARY)).cast("int")).alias("vocabulary_size"),
        F.when(text, F.abs(F.round("entropy", 6))).alias("vocabulary_entropy"),
        F.when(text & (F.col("n_words") <= MAX_ENUM), F.col("shares")).alias("enum_distribution"),
    )
    order = Window.partitionBy(*by).orderBy(F.col("presence_rate").desc(), "first_seen")
    return rows.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= most).drop("__rank", "first_seen")


def assemble_feature_vector(responses: DataFrame, fields: DataFrame, by: Sequence[str]) -> DataFrame:
    """One nested row a window: ``response_level`` and ``fields`` by path."""
    nested = fields.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("path", F.struct(*[c for c in fields.columns if c not in (*by, "path")])))).alias("fields"))
    level = F.struct(*[c for c in responses.columns if c not in (*by, "sample_count", "window_end")])
    kept = [c for c in ("window_end", "sample_count") if c in responses.columns and c not in by]
    return join_same(responses.select(*by, *kept, level.alias("response_level")), nested, by, "left")
