"""Rules as Columns against a plain evaluator, on random trees and events."""

import math
import re
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdictflow.plans import rules as R
from verdictflow.schema import BLOCK, EVENT, FLAG, PASS

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
RESULTS = [("eval", "watch", FLAG, "seen", None, False), ("eval", "watch", PASS, "again", None, True), ("inference", "model", PASS, None, 0.5, False), ("inference", "model", PASS, None, 0.9, False), ("inference", "late", PASS, "fail_open", None, True)]
STAGES = {"ingest": (PASS, 0), "eval": (FLAG, 2), "inference": (PASS, 0)}


def number(text):
    if text is None or len(text) > 63 or not re.fullmatch(r"\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", text, re.A):
        return None
    x = float(text)
    return None if math.isinf(x) else x


def evaluate(rule, e):
    tags, age = e["tags"], (NOW - e["timestamp"]) // timedelta(microseconds=1)
    first = lambda k: next((v for n, v in tags if n == k), None)
    of = lambda i, scored=False: next((r for r in RESULTS if r[1] == i and (not scored or r[4] is not None)), None)
    match rule:
        case R.And(left=a, right=b):
            return bool(a and b) and evaluate(a, e) and evaluate(b, e)
        case R.Or(left=a, right=b):
            return bool(a and b) and (evaluate(a, e) or evaluate(b, e))
        case R.Not(expr=x):
            return not x or not evaluate(x, e)
        case R.StageVerdictIs(stage=s, verdict=v):
            return s in STAGES and STAGES[s][0] == v
        case R.StageIsDegraded(stage=s):
            return s in STAGES and STAGES[s][1] != 0
        case R.EvaluatorScoreAbove(evaluator=i, threshold=t):
            return any(r[1] == i and r[4] is not None and r[4] >= t for r in RESULTS)
        case R.EvaluatorScoreBetween(evaluator=i, low=a, high=b):
            r = of(i, True)
            return a < b and r is not None and a <= r[4] < b
        case R.EvaluatorWasSkipped(evaluator=i):
            return (r := of(i)) is not None and r[5]
        case R.EvaluatorReasonIs(evaluator=i, reason=x):
            return (r := of(i)) is not None and r[3] == x
        case R.TagEquals(key=k, value=v):
            return (k, v) in tags
        case R.TagExists(key=k):
            return any(n == k for n, _ in tags)
        case R.TagContains(key=k, part=p):
            return first(k) is not None and p in first(k)
        case R.TagStartsWith(key=k, prefix=p):
            return first(k) is not None and first(k).startswith(p)
        case R.TagIn(key=k, values=v):
            return first(k) in v
        case R.TagValueLessThan(key=k, bound=b):
            return (n := number(first(k))) is not None and n < b
        case R.TagValueGreaterThan(key=k, bound=b):
            return (n := number(first(k))) is not None and n > b
        case R.TagValueBetween(key=k, low=a, high=b):
            return a < b and (n := number(first(k))) is not None and a <= n < b
        case R.EventTypeIs(type=t):
            return e["event_type"] == t
        case R.EventTypeIn(types=t):
            return e["event_type"] in t
        case R.TenantIs(tenant=t):
            return e["tenant_id"] == t
        case R.EventOlderThan(ms=m):
            return age > 0 and age > m * 1000
        case R.EventNewerThan(ms=m):
            return 0 <= age < m * 1000
    raise AssertionError(rule)


KEYS, VALUES = ["a", "b", "c"], ["", "x", "xy", "7", "7.5", " 8", "5 ", "1d", "nan", "inf", "1e400", "0x10", "-3", "1e2", ".5", "5.", "9" * 63, "9" * 64, "é"]
EVENTS = [
    {"event_id": i, "tenant_id": t, "entity_id": "e", "event_type": y, "timestamp": NOW - timedelta(milliseconds=m, microseconds=us), "payload": None, "tags": tags}
    for i, (t, y, m, us, tags) in enumerate(
        [("t1", "click", 0, 0, []), ("t2", "view", 1, 0, [("a", "x"), ("a", "7"), ("b", "")]), ("t1", "click", 1000, 1, [("b", "7.5"), ("c", "xy")]), ("t3", "", -5, 0, [("c", "nan")]), ("", "buy", 60_000, 0, [("a", "-3")])]
        + [("t1", "view", 10 * k, k, [("a", v), ("b", VALUES[-1 - k])]) for k, v in enumerate(VALUES)]
    )
]

key, value, num = st.sampled_from(KEYS), st.sampled_from(VALUES), st.sampled_from([-5.0, 0.0, 0.5, 7.0, 7.5, 8.0, 100.0, 1e30])
stage, ids = st.sampled_from(["ingest", "eval", "inference", "policy"]), st.sampled_from(["watch", "model", "late", "none"])
LEAF = st.one_of(
    st.builds(R.StageVerdictIs, stage, st.integers(0, 2)), st.builds(R.StageIsDegraded, stage), st.builds(R.EvaluatorScoreAbove, ids, st.sampled_from([0.25, 0.5, 0.75, 1.0])),
    st.builds(R.EvaluatorScoreBetween, ids, st.sampled_from([0.25, 0.5, 0.75]), st.sampled_from([0.25, 0.5, 0.75])), st.builds(R.EvaluatorWasSkipped, ids), st.builds(R.EvaluatorReasonIs, ids, st.sampled_from(["seen", "again", "fail_open"])),
    st.builds(R.TagEquals, key, value), st.builds(R.TagExists, key), st.builds(R.TagContains, key, value), st.builds(R.TagStartsWith, key, value), st.builds(R.TagIn, key, st.lists(value, max_size=3).map(tuple)),
    st.builds(R.TagValueLessThan, key, num), st.builds(R.TagValueGreaterThan, key, num), st.builds(R.TagValueBetween, key, num, num), st.builds(R.EventTypeIs, st.sampled_from(["click", ""])),
    st.builds(R.EventTypeIn, st.lists(st.sampled_from(["click", "view"]), max_size=2).map(tuple)), st.builds(R.TenantIs, st.sampled_from(["t1", "t9"])), st.builds(R.EventOlderThan, st.sampled_from([0, 1, 1000])), st.builds(R.EventNewerThan, st.sampled_from([0, 1, 1000])),
)
TREE = st.recursive(LEAF, lambda c: st.one_of(st.builds(R.And, c, c), st.builds(R.Or, c, c), st.builds(R.Not, c), st.builds(R.And, c, st.none()), st.builds(R.Or, st.none(), c), st.just(R.Not(None))), max_leaves=5)


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame([tuple(e[f.name] for f in EVENT.fields) for e in EVENTS], EVENT).cache()


def scope():
    fields = ["evaluator_id", "verdict", "reason_code", "score", "skipped"]
    rows = [F.struct(F.lit(i).alias("evaluator_id"), F.lit(v).alias("verdict"), F.lit(r).cast("string").alias("reason_code"), F.lit(s).cast("float").alias("score"), F.lit(k).alias("skipped")) for _, i, v, r, s, k in RESULTS]
    assert len(fields) == 5
    return R.Scope(as_of=F.lit(NOW), results=F.array(*rows), verdicts={k: F.lit(v) for k, (v, _) in STAGES.items()}, degraded={k: F.lit(d) for k, (_, d) in STAGES.items()})


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(TREE, min_size=25, max_size=25))
def test_trees(events, trees):
    s = scope()
    for r in events.select("event_id", *[t.test(s).alias(f"r{i}") for i, t in enumerate(trees)]).collect():
        for i, t in enumerate(trees):
            assert r[f"r{i}"] is evaluate(t, EVENTS[r["event_id"]]), (t, EVENTS[r["event_id"]])


def test_json_form():
    r = R.from_dict({"and": [{"stage_verdict_is": {"stage": "eval", "verdict": "flag"}}, {"not": {"tag_in": {"key": "a", "values": ["1"]}}}, {"or": [{"tag_exists": {"key": "b"}}]}]})
    assert r == R.And(R.And(R.StageVerdictIs("eval", FLAG), R.Not(R.TagIn("a", ("1",)))), R.TagExists("b"))
    from verdictflow.errors import ConfigError

    for bad in ({}, {"and": []}, {"nonsense": {}}, {"tag_in": {"key": "a"}}, {"stage_verdict_is": {"stage": "eval", "verdict": "maybe"}}):
        with pytest.raises(ConfigError):
            R.from_dict(bad)
    assert BLOCK == 2
