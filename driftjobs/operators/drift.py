"""Drift: windows against baselines, detector by detector, and what the detectors add up to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftjobs import constants as C
from driftjobs.functions.confidence import severity
from driftjobs.functions.stats import clamp_z, jensen_shannon_divergence, population_stability_index, proportion_z_test, rate_z_score, safe_pct_change
from driftjobs.functions.summary import alert_summary
from driftjobs.operators.keys import join_same

COMPONENT = ("place", "feature_name", "drift_type", "baseline_value", "observed_value", "deviation_z", "deviation_pct", "weight")


def _component(place: int, name: Column | str, kind: str, base: Column, seen: Column, z: Column, pct: Column | None, fires: Column) -> Column:
    """A component if it fires, else null. ``place`` is the detector's place in the order of detectors."""
    pct = safe_pct_change(seen, base) if pct is None else pct
    values = (F.lit(place), F.lit(name) if isinstance(name, str) else name, F.lit(kind), base.cast("double"), seen.cast("double"), F.round(clamp_z(z), 4), F.round(pct, 4), F.lit(C.DRIFT_WEIGHTS[kind]))
    return F.when(fires, F.struct(*[v.alias(n) for n, v in zip(COMPONENT, values, strict=True)]))


def _fired(rows: DataFrame, by: Sequence[str], components: Sequence[Column]) -> DataFrame:
    """The components that fired, one row each."""
    return rows.select(*by, F.explode(F.array_compact(F.array(*components))).alias("x")).select(*by, "x.*")


def response_components(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Detectors of latency, size, entropy and schema, over windows ``c`` and their baselines ``b`` (two structs)."""
    c, b = (lambda n: F.col(f"c.{n}")), (lambda n: F.col(f"b.{n}"))

    def shift(place: int, feature: str, name: str, spread: str, level: str, kind: str) -> Column:
        z = rate_z_score(c(name), b(name), b(spread))
        return _component(place, feature, kind, b(name), c(name), z, None, ((b(spread) > 0) | (b(level) > 0)) & (F.abs(z) >= C.Z_TRIGGER))

    ratio = (b("payload_entropy") - c("payload_entropy")) / F.when(b("payload_entropy") > C.ENTROPY_MIN, b("payload_entropy"))
    changed = (b("schema_hash") != "") & (c("schema_hash") != "") & (b("schema_hash") != c("schema_hash"))
    return _fired(rows, by, [
        shift(1, "latency.p95", "p95", "std", "mean", "latency_shift"),
        shift(2, "latency.mean", "mean", "std", "mean", "latency_shift"),
        shift(4, "response_size.mean", "size_mean", "size_std", "size_mean", "response_size_shift"),
        _component(5, "payload.entropy", "payload_entropy_drop", b("payload_entropy"), c("payload_entropy"), ratio * 5, None, ratio > C.ENTROPY_DROP),
        _component(6, "payload.schema_hash", "structural_change", F.lit(0.0), F.lit(1.0), F.lit(4.0), F.lit(100.0), changed),
    ])


def status_components(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The detector of error codes, where the mix of codes as a whole has moved."""
    base, seen = F.col("b.status_codes"), F.col("c.status_codes")
    moved = rows.where((F.size(base) > 0) & (F.size(seen) > 0) & (population_stability_index(base, seen) >= C.PSI_TRIGGER))
    codes = moved.select(*by, "c.sample_count", base.alias("p"), seen.alias("q"), F.explode(F.array_union(F.map_keys(base), F.map_keys(seen))).alias("code"))
    codes = codes.where(F.try_to_number("code", F.lit("999999")) >= C.ERROR_STATUS)
    was, now = (F.coalesce(F.try_element_at(m, F.col("code")), F.lit(0.0)) for m in ("p", "q"))
    z = proportion_z_test(now, was, F.col("sample_count"))
    name = F.concat(F.lit("status_code."), F.col("code"), F.lit("_rate"))
    return _fired(codes, by, [_component(3, name, "status_code_shift", was, now, z, None, (F.abs(now - was) > C.STATUS_DIFF_MIN) & (F.abs(z) >= C.Z_TRIGGER))])


def compare_fields(windows: DataFrame, fields: DataFrame, base_fields: DataFrame, by: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Each window's fields beside its baseline's: ``c``, ``b`` or both. ``windows`` are those to compare, with sample counts.

    Baseline fields are spread over the windows of their key first, so that a field which a window lacks is seen.
    """
    struct = lambda df, own, name: df.select(*own, "path", F.struct(*[x for x in df.columns if x not in (*own, "path")]).alias(name))
    expected = join_same(windows.select(*by), struct(base_fields, key, "b"), key)
    found = join_same(struct(fields, by, "c"), windows.select(*by), by, "left_semi")
    return join_same(join_same(expected, found, [*by, "path"], "full_outer"), windows.select(*by, "sample_count"), by)


def field_components(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Detectors over fields: gone, new, and seven over fields on both sides."""
    c, b = (lambda n: F.col(f"c.{n}")), (lambda n: F.col(f"b.{n}"))
    gone, new = F.col("c").isNull() & F.col("b").isNotNull(), F.col("b").isNull()
    both = F.col("c").isNotNull() & F.col("b").isNotNull()
    name = lambda end="": F.concat(F.lit("field."), F.col("path"), F.lit(end))
    n, one, zero, all_ = F.col("sample_count"), F.lit(1.0), F.lit(0.0), F.lit(100.0)
    null_z = proportion_z_test(c("null_rate"), b("null_rate"), n)
    here_z = proportion_z_test(c("presence_rate"), b("presence_rate"), n)
    steady = F.greatest(1 - b("type_consistency"), F.lit(0.01))
    spread = F.when(b("std") > 0, b("std")).otherwise(1.0)
    mean_z = rate_z_score(c("mean"), b("mean"), spread)
    words = c("vocabulary_size") / F.when(b("vocabulary_size") > 0, b("vocabulary_size"))
    pairs = pairs.withColumn("__jsd", jensen_shannon_divergence(b("enum_distribution"), c("enum_distribution")))
    jsd = F.col("__jsd")
    listed = (F.size(b("enum_distribution")) > 0) & (F.size(c("enum_distribution")) > 0)
    entropy = lambda side: F.coalesce(side("vocabulary_entropy"), zero)
    typed = (b("dominant_type") != "null") & (c("dominant_type") != "null") & (b("dominant_type") != c("dominant_type"))
    return _fired(pairs, by, [
        _component(7, name(), "field_disappeared", b("presence_rate"), zero, F.lit(5.0), F.lit(-100.0), gone & (b("presence_rate") > C.PRESENCE_MIN)),
        _component(8, name(".null_rate"), "null_rate_spike", b("null_rate"), c("null_rate"), null_z, None, both & (c("null_rate") - b("null_rate") > C.NULL_RATE_RISE) & (F.abs(null_z) >= C.Z_TRIGGER)),
        _component(9, name(".type_consistency"), "type_consistency_drop", b("type_consistency"), c("type_consistency"), (b("type_consistency") - c("type_consistency")) / steady, None, both & (b("type_consistency") > C.CONSISTENCY_MIN) & (c("type_consistency") < b("type_consistency") - C.CONSISTENCY_DROP)),
        _component(10, name(".type"), "schema_type_change", zero, one, F.lit(5.0), all_, both & typed & (b("type_consistency") > C.TYPE_CONSISTENCY_MIN)),
        _component(11, name(".presence_rate"), "presence_rate_drop", b("presence_rate"), c("presence_rate"), here_z, None, both & (b("presence_rate") - c("presence_rate") > C.PRESENCE_DROP) & (b("presence_rate") > C.PRESENCE_MIN) & (F.abs(here_z) >= C.Z_TRIGGER)),
        _component(12, name(".mean"), "numeric_distribution_shift", b("mean"), c("mean"), mean_z, None, both & (F.abs(mean_z) >= C.Z_TRIGGER)),
        _component(13, name(".vocabulary"), "vocabulary_collapse", b("vocabulary_size"), c("vocabulary_size"), (1 - words) * 6, None, both & (words < C.VOCABULARY_RATIO)),
        _component(14, name(".enum_distribution"), "enum_collapse", entropy(b), entropy(c), jsd * 8, None, both & listed & (jsd >= C.JSD_TRIGGER)),
        _component(15, name(), "structural_change", zero, c("presence_rate"), F.lit(3.0), all_, new & (c("presence_rate") > C.PRESENCE_MIN)),
    ])


def drift_components(responses: DataFrame, fields: DataFrame, base: DataFrame, base_fields: DataFrame, by: Sequence[str], key: Sequence[str] = C.KEY) -> DataFrame:
    """All components of windows whose key has a baseline with samples."""
    rest = [x for x in responses.columns if x not in by]
    base = base.where("sample_count > 0")
    others = base.select(*key, F.struct(*[x for x in base.columns if x not in key]).alias("b"))
    rows = join_same(responses.select(*by, F.struct(*rest).alias("c")), others, key)
    windows = rows.select(*by, "c.sample_count")
    pairs = compare_fields(windows, fields, base_fields, by, key)
    return response_components(rows, by).unionByName(status_components(rows, by)).unionByName(field_components(pairs, by))


def drift_total(components: DataFrame, by: Sequence[str], top: int = 3) -> DataFrame:
    """Score, severity, alert type, all components (``found``, in the detectors' order) and the weightiest (``top``) of windows that have any.

    The severity is that of the score before rounding.
    """
    impact = F.abs("deviation_z") * F.col("weight")
    sums = components.groupBy(*by).agg(F.sum(impact).alias("s"), F.sum("weight").alias("w"), F.array_sort(F.collect_list(F.struct(*COMPONENT))).alias("found"))  # a window has a few components for each of its 500 fields at most
    ranked = F.array_sort(F.transform("found", lambda x: F.struct((-F.abs(x["deviation_z"]) * x["weight"]).alias("rank"), x.alias("component"))))
    score = F.least(F.lit(10.0), F.col("s") / F.col("w"))
    rows = sums.withColumns({"severity": severity(score), "top": F.transform(F.slice(ranked, 1, top), lambda x: x["component"])}).withColumn("score", F.round(score, 4))
    return rows.select(*by, "score", "severity", F.when(F.col("severity").isNotNull(), F.col("top")[0]["drift_type"]).alias("alert_type"), F.size("found").cast("long").alias("components"), "found", "top")


def score_drift(responses: DataFrame, fields: DataFrame, base: DataFrame, base_fields: DataFrame, by: Sequence[str], key: Sequence[str] = C.KEY, model_version: str = C.MODEL_VERSION) -> DataFrame:
    """A row for every window: quiet ones, and those without a baseline, score 0. ``components`` counts those in ``found``."""
    totals = drift_total(drift_components(responses, fields, base, base_fields, by, key), by)
    rows = join_same(responses.select(*by, "sample_count"), totals, by, "left")
    rows = rows.withColumns({"score": F.coalesce("score", F.lit(0.0)), "components": F.coalesce("components", F.lit(0).cast("long")), "model_version": F.lit(model_version)})
    return rows.withColumn("summary", alert_summary(F.col("score"), F.col("severity"), F.col("top"))).drop("top")
