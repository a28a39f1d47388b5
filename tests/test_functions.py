"""Column functions against values worked out by hand, and against properties on random input."""

import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftjobs.constants import MASKS
from driftjobs.functions import confidence as conf
from driftjobs.functions import stats
from driftjobs.functions.payload import _canonicalize, _leaves, _mask, canonicalize, flatten_payload, mask_string, read_payload, safe_json
from driftjobs.functions.summary import alert_summary, describe_component


def values(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


L = F.lit


def test_rate_z_score(spark):
    z = stats.rate_z_score
    got = values(spark, z(L(130.0), L(100.0), L(10.0)), z(L(70.0), L(100.0), L(10.0)), z(L(110.0), L(100.0), L(0.0)), z(L(90.0), L(100.0), L(0.0)), z(L(5.0), L(5.0), L(0.0)))
    assert got == (3.0, -3.0, 5.0, -5.0, 0.0)


def test_proportion_z_and_pct(spark):
    p, c = stats.proportion_z_test, stats.safe_pct_change
    got = values(spark, p(L(0.15), L(0.02), L(500)), p(L(0.5), L(0.1), L(0)), c(L(150.0), L(100.0)), c(L(1.0), L(0.0)), c(L(0.0), L(0.0)), c(L(-1.0), L(-2.0)))
    assert got[0] == pytest.approx(0.13 / math.sqrt(0.02 * 0.98 / 500))
    assert got[1:] == (0.0, 50.0, 100.0, 0.0, 50.0)


def test_laplace(spark):
    both = lambda p, q, e: stats.smoothed(stats.aligned(p, q), e)
    m = lambda **kw: F.create_map(*[L(x) for k, v in kw.items() for x in (k, float(v))]).cast("map<string,double>")
    first, second, empty = values(spark, both(m(A=10, B=20), m(A=10), 1.0), both(m(A=10), m(B=1), 1.0), stats.jensen_shannon_divergence(m(), m()))
    assert [x.p for x in first] == pytest.approx([11 / 32, 21 / 32])
    assert [x.p for x in second] == pytest.approx([11 / 12, 1 / 12])
    assert empty == 0


def _smooth(p, q):
    keys = sorted(set(p) | set(q))
    share = lambda d: {k: (d.get(k, 0) + 1e-3) / (sum(d.values()) + 1e-3 * len(keys)) for k in keys}
    return share(p), share(q)


maps = st.dictionaries(st.sampled_from("abcdef"), st.floats(0, 1), min_size=1, max_size=5)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(maps, maps), min_size=60, max_size=60))
def test_divergences_on_random_maps(spark, pairs):
    df = spark.createDataFrame([(i, p, q) for i, (p, q) in enumerate(pairs)], "i int, p map<string,double>, q map<string,double>")
    p, q = F.col("p"), F.col("q")
    rows = df.select("i", stats.jensen_shannon_divergence(p, q).alias("jsd"), stats.jensen_shannon_divergence(q, p).alias("back"), stats.jensen_shannon_divergence(p, p).alias("self"), stats.kl_divergence(p, q).alias("kl"), stats.population_stability_index(p, q).alias("psi")).collect()
    for r in rows:
        a, b = _smooth(*pairs[r.i])
        kl = lambda x, y: sum(x[k] * math.log2(x[k] / y[k]) for k in x)
        middle = {k: (a[k] + b[k]) / 2 for k in a}
        assert r.jsd == pytest.approx(kl(a, middle) / 2 + kl(b, middle) / 2, abs=1e-9) and r.jsd == pytest.approx(r.back, abs=1e-9)
        assert 0 <= r.jsd <= 1 and r.self == pytest.approx(0, abs=1e-12)
        assert r.kl == pytest.approx(kl(a, b), abs=1e-9)
        assert r.psi == pytest.approx(sum((b[k] - a[k]) * math.log(b[k] / a[k]) for k in a), abs=1e-9)


def test_severity_levels_alerts(spark):
    assert values(spark, *[conf.severity(L(x)) for x in (1.99, 2.0, 4.0, 6.0, 8.0, 10.0)]) == (None, "low", "medium", "high", "critical", "critical")
    assert values(spark, *[conf.confidence_level(L(x)) for x in (0.39, 0.40, 0.65, 0.85)]) == ("low", "moderate", "high", "production_trusted")
    cases = [(8.0, "low"), (6.0, "moderate"), (6.0, "low"), (4.0, "high"), (2.0, "production_trusted"), (2.0, "high"), (1.99, "production_trusted")]
    assert values(spark, *[conf.should_alert(L(s), L(c)) for s, c in cases]) == (True, True, False, True, True, False, False)


def test_maturity_and_recompute(spark):
    assert values(spark, *[conf.maturity_state(L(n)) for n in (99, 100, 999, 1000, 4999, 5000)]) == ("initializing", "learning", "learning", "stabilizing", "stabilizing", "production_trusted")
    assert values(spark, conf.maturity_state(L(5000), 50.0), conf.window_days(L("sparse_traffic"))) == ("sparse_traffic", 30)
    again = conf.should_recompute_baseline
    assert values(spark, again(L(10), L(0)), again(L(9), L(0)), again(L(110), L(100)), again(L(109), L(100)), again(L(100), L(100), 85.0)) == (True, False, True, False, True)


def test_confidence(spark):
    full = conf.confidence(L("production_trusted"), L(10_000), L(0.0), L(14), L(None).cast("double"), L(0))
    fresh = conf.confidence(L("production_trusted"), L(10_000), L(0.0), L(14), L(0.1), L(2))
    a, b = values(spark, full, fresh)
    assert (a.score, a.level) == (1.0, "production_trusted")
    assert b.factors.deployment == 0.2 and b.score == pytest.approx(min(1.0, 0.84 + 0.1))


def test_masks(spark):
    cases = {
        "550e8400-e29b-41d4-a716-446655440000": "__UUID__",
        "2024-01-01T00:00:00Z": "__TIMESTAMP__",
        "123456": "__NUMERIC_ID__",
        "12345": "12345",
        "a.b@example.com": "__EMAIL__",
        "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2Q": "__JWT__",
        "+1 (415) 555-0100": "__PHONE__",
        "10.0.0.1": "__IP__",
        "fe80:0000:0000:0001": "__IP__",
        "plain": "plain",
        "": "",
    }
    got = values(spark, *[mask_string(L(k)) for k in cases])
    assert got == tuple(cases.values())
    assert [json.loads(x)["v"] for x in _canonicalize([json.dumps({"v": k}) for k in cases])["normalized"]] == list(cases.values())


ODD_PARTS = ["12", "٣٤٥", "²", "é", "_", "a", "@", ".", "-", "+", "(", ")", " ", "\u00a0", "\u2003", "\n", "\r", "\u2028", "T", ":", "2024-01-01T00:00:00", "e\u0301", "eyJ", "550e8400-e29b-41d4-a716-446655440000", "10.0.0.1", "fe80:0:1", "x@y.zz"]


def test_masks_are_the_same_in_the_jvm_and_in_python(spark):
    draw = random.Random(7)
    texts = ["".join(draw.choice(ODD_PARTS) for _ in range(draw.randrange(1, 9))) for _ in range(4000)]
    texts += [t + end for t in ("123456", "١٢٣٤٥٦", "a@b.c", "é@ü.ß", "10.0.0.1", "550e8400-e29b-41d4-a716-446655440000", "+1 555\u00a0123 45") for end in ("", "\n", "\r\n", "\u2028", "\n\n")]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("m", mask_string(F.col("t")))
    assert [r.m for r in df.orderBy("i").collect()] == [_mask(t) for t in texts]
    assert {_mask(t) for t in texts} >= {mask for _, mask in MASKS if mask != "__JWT__"}


def test_payloads_that_break_parsers(spark):
    """Lone surrogates become U+FFFD; JSON that nests too deep is bad JSON; numbers count if they are finite doubles."""
    deep = "[" * 200_000 + "]" * 200_000
    texts = ['{"b":"\\ud800","k\\udfff":1}', deep, '{"a":' * 600 + "1" + "}" * 600, '{"a":' * 400 + "1" + "}" * 400, '{"n":1.5e308,"m":1e999,"o":1' + "0" * 400 + "}", '{"s":"' + "[" * 600 + '"}', '{"p":"\\ud83d\\ude00"}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", flatten_payload("t").alias("f"), canonicalize("t").alias("c"), read_payload("t").alias("r")).orderBy("i").collect()
    assert [(x.path, x.str) for x in rows[0].f if x.kind != "visit"] == [("b", "\ufffd"), ("k\ufffd", None)] and rows[0].c.normalized == '{"b":"\\ud800","k\\udfff":1}'
    assert [r.f is None for r in rows] == [False, True, True, False, False, False, False] == [not r.r.parsed for r in rows]
    assert {x.path: x.num for x in rows[4].f if x.kind != "visit"} == {"n": 1.5e308, "m": None, "o": None}
    assert rows[5].f[1].len == 600 and rows[6].f[1].str == "😀"
    assert [r.c.schema_hash for r in rows if r.r.is_object] == [r.r.schema_hash for r in rows if r.r.is_object] and rows[1].c.schema_hash == "74234e98afe7498f"


def test_entropy_of_values(spark):
    lists = [["a", "b", "a", None], [], ["x"] * 5, [str(i) for i in range(16)], [None, None]]
    rows = spark.createDataFrame(list(enumerate(lists)), "i int, v array<string>").select("i", stats.shannon_entropy(F.col("v")).alias("e")).orderBy("i").collect()
    assert [r.e for r in rows] == pytest.approx([1.5, 0, 0, 4, 0])


def test_flattening():
    rows = _leaves({"a": {"b": 1}, "c": [{"d": None}, {"d": "x"}, 2.5, [1, 2]], "e": []})
    assert [(p, k) for p, k, *_ in rows] == [
        ("a", "visit"), ("c", "visit"), ("e", "visit"), ("a.b", "visit"), ("a.b", "int"), ("c[]", "visit"), ("c[].d", "visit"),
        ("c[].d", "null"), ("c[].d", "str"), ("c[]", "float"), ("c[]", "list"), ("e[]", "visit"),
    ]
    deep = {"a": {"b": {"c": {"d": {"e": {"f": {"g": 1}}}}}}}
    assert max(p.count(".") for p, *_ in _leaves(deep)) == 5
    assert _leaves([1]) == [] and _leaves(None) is None


def test_payload_columns(spark):
    texts = ['{"b":1.0,"a":true}', "{bad", None, "null", '"text"']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", flatten_payload("t").alias("f"), canonicalize("t").alias("c"), safe_json(F.col("t"), "{}").alias("s")).orderBy("i").collect()
    assert [r.f is None for r in rows] == [False, True, True, True, False] and rows[4].f == []
    assert rows[0].c.normalized == '{"a":true,"b":1.0}' and rows[2].c.payload_hash == rows[3].c.payload_hash == "74234e98afe7498f"
    assert [r.c.is_object for r in rows] == [True, False, False, False, False]
    assert rows[1].s == "{}" and rows[2].s == "{}" and rows[0].s == texts[0]


def test_every_sentence_and_its_ties(spark):
    """All seven formats, with numbers that lie on ties and just beside them, against Python's own formatting."""
    draw = random.Random(9)
    numbers = [0.25, 0.35, 0.15, 2.5, 0.125, 1.005, 0.00005, -0.04, 0.05, 99.95, 1e6 + 0.25, -2.25, 12345.67855]
    kinds = {"null_rate_spike": "null rate increased", "field_disappeared": "field disappeared", "latency_shift": "latency shifted", "response_size_shift": "response size shifted", "enum_collapse": "enum distribution collapsed", "structural_change": "new field appeared", "schema_type_change": "field type changed", "status_code_shift": "error rate increased", "type_consistency_drop": "type consistency dropped"}
    rows = [(i, "field.a.b.mean", draw.choice(list(kinds)), *(draw.choice(numbers) * draw.choice([1, 1, draw.random()]) for _ in range(4))) for i in range(600)]

    def plain(_, name, kind, b, o, z, p):
        head = f"a → b → mean: {kinds[kind]}"
        return {
            "null_rate_spike": f"{head} from {b:.1%} to {o:.1%} (z={z:.1f})",
            "field_disappeared": f"{head} (was present {b:.0%} of the time)",
            "latency_shift": f"{head} from {b:.1f} to {o:.1f} ({p:+.1f}%)",
            "response_size_shift": f"{head} from {b:.1f} to {o:.1f} ({p:+.1f}%)",
            "enum_collapse": f"{head} (JSD-based, z={z:.1f})",
            "structural_change": f"{head} with {o:.0%} presence",
            "schema_type_change": head,
        }.get(kind, f"{head} (baseline={b:.4f}, observed={o:.4f}, z={z:.1f})")

    names = ("i", "feature_name", "drift_type", "baseline_value", "observed_value", "deviation_z", "deviation_pct")
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n == 'i' else 'string' if n.endswith(('name', 'type')) else 'double'}" for n in names))
    got = df.select("i", describe_component(F.struct(*names[1:])).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [plain(*r) for r in rows]


def test_summary(spark):
    part = lambda name, kind, b, o, z, p: F.struct(L(name).alias("feature_name"), L(kind).alias("drift_type"), L(b).alias("baseline_value"), L(o).alias("observed_value"), L(z).alias("deviation_z"), L(p).alias("deviation_pct"))
    top = F.array(part("field.user.email.null_rate", "null_rate_spike", 0.02, 0.6, 9.04, 2900.0), part("latency.p95", "latency_shift", 200.0, 500.0, 5.0, 150.0), part("field.x", "field_disappeared", 0.9, 0.0, 5.0, -100.0))
    text, none = values(spark, alert_summary(L(9.5), L("critical"), top), alert_summary(L(0.0), L(None).cast("string"), F.slice(top, 1, 0)))
    assert text == "[CRITICAL] Drift score: 9.50. user → email → null_rate: null rate increased from 2.0% to 60.0% (z=9.0); latency → p95: latency shifted from 200.0 to 500.0 (+150.0%); x: field disappeared (was present 90% of the time)."
    assert none == "No significant behavioral drift detected."
