import json
import threading
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictflow.errors import ConfigError, EmissionError, EvaluatorError, PipelineError, StoreError, SyncSubmitError
from verdictflow.functions import epoch_of
from verdictflow.operators import compose as C
from verdictflow.operators import metrics, ratelimit, routing
from verdictflow.operators.evaluators import AllowDeny, ColumnEvaluator, Historical, PythonEvaluator, Scorer, Threshold, plugin
from verdictflow.plans import rules as R
from verdictflow.plans.config import Emit, FailureMode, PipelineConfig, Policy, Sharding
from verdictflow.plans.pipeline import Pipeline, compile, stage_of
from verdictflow.plans.registry import DecisionTypes
from verdictflow.queries import fleet_config
from verdictflow.schema import BLOCK, DECISION, EVALUATOR_ERROR, EVENT, FLAG, INGEST_VALIDATION_FAILED, PASS, STATE_STORE_UNAVAILABLE, WINDOW_STATE
from verdictflow.sinks import audit_lines, decision_json, decisions_from_json, emit
from verdictflow.sinks.targets import JsonFiles, Noop, ParquetFiles
from verdictflow.sources import CasStore, Snapshot, expire, http_events, list_frame, load_topology, read_list, read_with_fallback
from verdictflow.sources.state import apply_changes, lookup
from verdictflow.streaming import running_counts, session_counts, token_buckets

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def events(spark, rows):
    """rows: (tenant, entity, type, milliseconds after T0, tags)."""
    return spark.createDataFrame([(i + 1, t, e, y, T0 + timedelta(milliseconds=ms), None, list(tags.items()) if isinstance(tags, dict) else tags) for i, (t, e, y, ms, tags) in enumerate(rows)], EVENT)


def config(**kw):
    return PipelineConfig("p", **kw).with_targets(Noop())


def decide(c, df, as_of=T0):
    return sorted(compile(c.build(), F.lit(as_of))(df).collect(), key=lambda d: d["event_id"])


@pytest.mark.parametrize("rule,votes,verdict", [
    ("any_block", "FB", BLOCK), ("any_block", "FF", FLAG), ("any_block", "PP", PASS), ("any_flag", "PF", FLAG), ("any_flag", "FB", BLOCK), ("unanimous", "BB", BLOCK), ("unanimous", "FB", PASS), ("unanimous", "B", BLOCK), ("unanimous", "", PASS),
    ("majority", "BBF", BLOCK), ("majority", "BFF", PASS), ("majority", "BP", PASS), ("majority", "", PASS), ("weighted_score", "BB", PASS), ("any_block", "", PASS),
])
def test_composition(spark, rule, votes, verdict):
    assert spark.range(1).select(C.compose(rule, [F.lit("PFB".index(v)) for v in votes]).alias("v")).first()["v"] == verdict


def test_defaults_and_row_count(spark):
    df = events(spark, [("acme", f"user-{i}", "api_call", 0, {}) for i in range(10)])
    ds = decide(config().with_evaluators(ColumnEvaluator("ok", F.lit(PASS))), df)
    assert len(ds) == 10 and all(d["final_verdict"] == PASS and len(d["stage_outputs"]) == 2 and d["degraded_reason"] == 0 for d in ds)
    assert compile(config(), F.lit(T0))(df).schema.fieldNames() == DECISION.fieldNames()


def test_ingest(spark):
    ds = decide(config(), events(spark, [("t", "", "x", 0, {}), (None, "e", "x", 0, {}), ("t", "e", "x", -30_000, {}), ("t", "e", "x", -30_001, {}), ("t", "e", "x", 60_000, {})]))
    assert [(d["final_verdict"], d["degraded_reason"]) for d in ds] == [(PASS, INGEST_VALIDATION_FAILED), (PASS, INGEST_VALIDATION_FAILED), (PASS, 0), (FLAG, 0), (PASS, 0)]
    assert ds[3]["stage_outputs"][0]["evaluator_results"][0]["reason_code"] == "late_arrival"


def test_threshold_windows(spark):
    rows = [("t", "A", "x", i, {}) for i in range(150)] + [("t", "B", "x", i, {}) for i in range(50)] + [("t", "A", "x", 60_000 + i, {}) for i in range(3)]
    ds = decide(config().with_evaluators(Threshold(100, 60_000)), events(spark, rows), T0 + timedelta(milliseconds=100))
    flagged = [d["event_id"] for d in ds if d["final_verdict"] == FLAG]
    assert flagged == list(range(101, 151))
    r = ds[100]["stage_outputs"][1]["evaluator_results"][0]
    assert r["evaluator_id"] == "threshold_evaluator" and r["reason_code"] == "threshold_exceeded" and json.loads(r["metadata"]) == {"window_count": 101, "threshold": 100.0, "window_name": "default"}


def test_threshold_kinds(spark):
    df = events(spark, [("t", "A", "x", i, {"v": str(v), "g": g}) for i, (v, g) in enumerate([(5, "a"), (5, "b"), ("oops", "a"), (7, "a"), (5, "a")])])
    flags = lambda e: [d["final_verdict"] for d in decide(config().with_evaluators(e), df)]
    assert flags(Threshold(9, 60_000, "sum", value_tag="v")) == [0, 1, 1, 1, 1]
    assert flags(Threshold(2, 60_000, "distinct", value_tag="v")) == [0, 0, 0, 1, 1]
    assert flags(Threshold(2, 60_000, "distinct", value_tag="v", stub=True)) == [0, 0, 1, 1, 1]
    assert flags(Threshold(2, 60_000, group_by="tag", tag="g")) == [0, 0, 0, 1, 1]
    assert flags(Threshold(2, 60_000, group_by="tag", tag="none")) == [0, 0, 1, 1, 1]


def test_carry_over_and_history(spark):
    df = events(spark, [("t", "A", "x", i, {}) for i in range(80)])
    first = Threshold(100, 60_000).totals(df)
    more = events(spark, [("t", "A", "x", 100 + i, {}) for i in range(30)])
    assert sum(d["final_verdict"] == FLAG for d in decide(config().with_evaluators(Threshold(100, 60_000, prior=first)), more)) == 10
    now = spark.range(1).select(epoch_of(F.lit(T0), 60_000).alias("e")).first()["e"]
    state = spark.createDataFrame([("t", "A", "default", now - k, 10.0, 1) for k in range(5)], WINDOW_STATE)
    h = lambda n, thr: decide(config().with_evaluators(Historical(state, F.lit(T0), num_windows=n, threshold=thr)), events(spark, [("t", "A", "x", 0, {}), ("t", "B", "x", 0, {})]))
    assert [d["final_verdict"] for d in h(3, 30)] == [FLAG, PASS] and [d["final_verdict"] for d in h(2, 30)] == [PASS, PASS]


def test_lists(spark, tmp_path):
    f = tmp_path / "allow.txt"
    f.write_bytes(b"entity-A\r\n\nentity-C\nentity-A\n")
    assert read_list(str(f)) == ("entity-A", "entity-C") and read_list("") == () and {r["value"] for r in list_frame(spark, str(f)).collect()} == {"entity-A", "entity-C"}
    with pytest.raises(ConfigError):
        read_list(str(tmp_path / "none"))
    df = events(spark, [("t", f"entity-{x}", "x", 0, {}) for x in "ABZ"] + [("t", None, "x", 0, {})])
    for allow in (read_list(str(f)), list_frame(spark, str(f))):
        ds = decide(config().with_evaluators(AllowDeny(allow, ["entity-B", "entity-A"], default=FLAG)), df)
        assert [d["final_verdict"] for d in ds] == [PASS, BLOCK, FLAG, FLAG]
        assert [d["stage_outputs"][1]["evaluator_results"][0]["reason_code"] for d in ds] == ["allow_list_match", "deny_list_match", "default", "default"]


def test_python_evaluators_and_failures(spark):
    df = events(spark, [("t", "e", y, 0, {}) for y in ("ok", "bad", "boom")])

    def judge(e):
        if e["event_type"] == "boom":
            raise RuntimeError
        return (FLAG, "bad_type") if e["event_type"] == "bad" else PASS

    for mode, verdict, reason in ((FailureMode.FAIL_OPEN, PASS, "fail_open"), (FailureMode.FAIL_CLOSED, BLOCK, "fail_closed"), (FailureMode.EMIT_DEGRADED, PASS, "degraded")):
        ds = decide(config().with_evaluators(PythonEvaluator("judge", judge), failure_mode=mode), df)
        assert [d["final_verdict"] for d in ds] == [PASS, FLAG, verdict] and [d["degraded_reason"] for d in ds] == [0, 0, EVALUATOR_ERROR]
        r = ds[2]["stage_outputs"][1]["evaluator_results"][0]
        assert r["evaluator_id"] == "evaluator_0" and r["reason_code"] == reason and r["skipped"]


def test_scorers(spark):
    import time

    df = events(spark, [("t", "e", "x", 0, {"s": s}) for s in ("0.9", "0.3")])
    good = Scorer("model", load=lambda: lambda rows: np.where(rows["event_id"] == 1, 0.9, 0.3), columns=("event_id",))
    assert [d["final_verdict"] for d in decide(config().with_inference(good, score_threshold=0.75), df)] == [FLAG, PASS]

    def slow():
        def run(rows):
            time.sleep(0.2)
            return rows["event_id"] * 0.1

        return run

    late = decide(config().with_inference(Scorer("slow", load=slow, columns=("event_id",), timeout_ms=50)), df)
    assert all(d["degraded_reason"] == 1 and d["final_verdict"] == PASS and d["stage_outputs"][1]["evaluator_results"][0]["evaluator_id"] == "inference_evaluator_0" for d in late)
    broken = decide(config().with_inference(Scorer("broken", load=lambda: 1 / 0, columns=("event_id",)), failure_mode=FailureMode.FAIL_CLOSED), df)
    assert all(d["degraded_reason"] == 2 and d["final_verdict"] == PASS for d in broken)  # a mean of scores ignores verdicts
    p = Policy().add(R.StageVerdictIs("eval", FLAG) & R.EvaluatorScoreAbove("model", 0.8), 1, BLOCK, "both")
    ds = decide(config().with_evaluators(ColumnEvaluator("f", F.lit(FLAG))).with_inference(good).with_policy(p), df)
    assert [d["final_verdict"] for d in ds] == [BLOCK, FLAG] and ds[0]["stage_outputs"][3]["evaluator_results"][0]["reason_code"] == "both"


def test_plugins(tmp_path, monkeypatch):
    monkeypatch.syspath_prepend(tmp_path)
    (tmp_path / "plug_ok.py").write_text("from pyspark.sql import functions as F\nfrom verdictflow.operators.evaluators import ColumnEvaluator\nABI_VERSION = 1\ndef create_evaluator(c):\n    return ColumnEvaluator(c['id'], F.lit(1))\n")
    (tmp_path / "plug_old.py").write_text("ABI_VERSION = 0\ncreate_evaluator = None\n")
    (tmp_path / "plug_none.py").write_text("ABI_VERSION = 1\n")
    assert plugin("plug_ok", {"id": "x"}).id == "x"
    for name in ("plug_missing", "plug_old", "plug_none"):
        with pytest.raises(EvaluatorError, match="EvaluatorLoadFailed"):
            plugin(name)


def policy_of(spark, types, rules, rows=({"a": "1"},)):
    p = Policy()
    for r in rules:
        p.add(*r)
    c = config().with_policy(p)
    if types:
        c.with_decision_types(types)
    return decide(c, events(spark, [("t", "e", "x", 0, t) for t in rows]))


def test_policy(spark):
    yes, no = R.TagExists("a"), R.TagExists("zz")
    types = lambda: DecisionTypes().add("block", priority=0).add("notify", priority=50).add("pass", priority=200)
    ids = lambda d: [r["evaluator_id"] for r in d["stage_outputs"][-1]["evaluator_results"]]
    act = lambda d: [a["decision_type_id"] for a in d["active_decisions"]]
    (d,) = policy_of(spark, None, [(yes, 2, BLOCK, "second"), (yes, 1, FLAG, "first")])
    assert ids(d) == ["first"] and d["final_verdict"] == FLAG and act(d) == []
    (d,) = policy_of(spark, types(), [(no, 1, BLOCK, "n", "block")])
    assert ids(d) == [] and d["final_verdict"] == PASS
    (d,) = policy_of(spark, types(), [(yes, 1, FLAG, "n", "notify"), (yes, 2, BLOCK, "b", "block"), (yes, 3, PASS, "n2", "notify"), (yes, 4, FLAG, "plain")])
    assert ids(d) == ["plain", "n", "b"] and act(d) == ["block", "notify"] and d["final_verdict"] == BLOCK
    (d,) = policy_of(spark, types().exclude("pass", "block"), [(yes, 1, PASS, "p", "pass"), (yes, 2, BLOCK, "b", "block")])
    assert act(d) == ["block"]
    tie = DecisionTypes().add("x", priority=5).add("y", priority=5).exclude("y", "x")
    (d,) = policy_of(spark, tie, [(yes, 1, FLAG, "rx", "x"), (yes, 2, BLOCK, "ry", "y")])
    assert act(d) == ["y"]


@pytest.mark.parametrize("celsius,build,ring,kind,active,verdict", [
    (20, 3, "field", "view", ["mute"], PASS), (160, 3, "field", "view", ["ticket"], FLAG), (20, 95, "canary", "boot", ["pull"], BLOCK), (20, 95, "lab", "boot", ["sample"], BLOCK), (151, 95, "field", "view", ["pull", "ticket"], BLOCK), (150, 89, "canary", "view", ["sample", "mute"], FLAG),
])
def test_fleet(spark, celsius, build, ring, kind, active, verdict):
    (d,) = decide(fleet_config(), events(spark, [("plant", "device", kind, 0, {"celsius": str(celsius), "build": str(build), "ring": ring})]))
    assert ([a["decision_type_id"] for a in d["active_decisions"]], d["final_verdict"]) == (active, verdict)


def test_registry():
    t = DecisionTypes().add("a", priority=5).add("b", priority=5).add("c", priority=1)
    assert [x.id for x in t.types] == ["c", "b", "a"]
    for bad in (lambda: t.add(""), lambda: t.add("a"), lambda: t.exclude("a", "zz")):
        with pytest.raises(ConfigError):
            bad()


def test_validation():
    def code(c):
        with pytest.raises(ConfigError) as e:
            c.build()
        return e.value.code

    assert config().build()
    assert code(PipelineConfig("p")) == "RequiredStageMissing"
    assert code(config().with_evaluators(timeout_ms=400)) == "LatencyBudgetExceeded"
    c = config()
    c.sharding = Sharding(4, 4)
    assert code(c) == "InvalidShardingConfig"
    assert code(config().with_policy(Policy().add(R.StageVerdictIs("inference", FLAG)))) == "UndefinedStageDependency"
    assert config().with_policy(Policy().add(R.StageIsDegraded("inference") | R.StageVerdictIs("emit", FLAG))).build()
    assert code(config().with_policy(Policy().add(R.TagExists("a"), decision_type="x"))) == "InvalidPolicyRule"
    assert code(PipelineConfig("").with_targets(Noop())) == "InvalidConfig"


def test_json_config(spark, tmp_path):
    (tmp_path / "trusted.txt").write_text("entity-A\n")
    d = {
        "pipeline_id": "fleet", "latency_budget_ms": 300, "sharding": {"num_cells": 16, "cells_per_tenant": 4},
        "stages": {
            "ingest": {"skew_tolerance_ms": 5000},
            "lightweight_eval": {"composition": "any_block", "evaluators": [{"type": "allow_deny", "config": {"list_source": f"file://{tmp_path}/trusted.txt", "default": "flag"}}, {"type": "threshold", "config": {"window_duration_ms": 60000, "group_by": "entity_id", "threshold": 2}}]},
            "ml_inference": {"composition": "weighted_score", "score_threshold": 0.75, "evaluators": [{"type": "tag_score", "config": {"id": "model", "tag": "s"}}]},
            "policy_eval": {"rules": [{"rule_id": "r", "priority": 1, "action": "block", "expression": {"and": [{"stage_verdict_is": {"stage": "lightweight_eval", "verdict": "flag"}}, {"score_above": {"evaluator": "model", "threshold": 0.8}}]}}]},
            "emit": {"targets": [{"type": "noop"}]},
        },
    }
    ds = decide(PipelineConfig.from_json(json.dumps(d)), events(spark, [("t", "entity-A", "x", 0, {"s": "0.9"}), ("t", "entity-B", "x", 0, {"s": "0.9"}), ("t", "entity-B", "x", 0, {"s": "0.1"})]))
    assert [x["final_verdict"] for x in ds] == [FLAG, BLOCK, FLAG]
    for bad in ("{", json.dumps({"pipeline_id": "x", "stages": {}}), json.dumps(d | {"stages": d["stages"] | {"emit": {"targets": [{"type": "smoke"}]}}})):
        with pytest.raises(ConfigError):
            PipelineConfig.from_json(bad)


def test_formats(spark):
    d = compile(fleet_config().build(), F.lit(T0))(events(spark, [("plant", 'e"1', "boot", 0, {"build": "99"}), ("plant", "e2", "boot", 0, {})]))
    assert decisions_from_json(decision_json(d)).collect() == d.collect()
    lines = [json.loads(r["value"]) for r in audit_lines(d).collect()]
    assert lines[0] == {"event_id": 1, "tenant_id": "plant", "entity_id": 'e"1', "final_verdict": "block", "degraded": False, "elapsed_us": 0}
    assert "active_decisions" not in json.loads(decision_json(d).collect()[1]["value"])


def test_emission(spark, tmp_path):
    d = compile(config(), F.lit(T0))(events(spark, [("t", f"e{i}", "x", 0, {}) for i in range(5)]))
    tries, waits = [], []

    def flaky(df):
        tries.append(1)
        if len(tries) < 3:
            raise EmissionError("TargetUnavailable")

    def dead(df):
        raise EmissionError("TargetUnavailable")

    dropped = emit(d, Emit([flaky, dead, ParquetFiles(str(tmp_path / "p")), JsonFiles(str(tmp_path / "j"))]), sleep=waits.append)
    assert dropped == 5 and len(tries) == 3 and waits == [0.01, 0.02, 0.01, 0.02, 0.04] and spark.read.parquet(str(tmp_path / "p")).count() == 5 and spark.read.text(str(tmp_path / "j")).count() == 5


def test_state(spark, tmp_path):
    s = Snapshot(spark, str(tmp_path / "state"))
    row = lambda e, a=10.0, v=1: ("t", "A", "w", e, a, v)
    frame = lambda *rows: spark.createDataFrame(list(rows), WINDOW_STATE)
    assert lookup(s.warm(), "t", "A", "w", 0) == (0.0, 0)
    s.upsert(frame(row(0), row(1), row(5)))
    s.upsert(frame(row(1, 20.0, 2)))
    assert lookup(s.warm(), "t", "A", "w", 1) == (20.0, 2) and s.query_range("t", "A", "w", 0, 1) == 30.0
    assert s.archive(5) == [0, 1] and s.warm().count() == 1 and s.query_range("t", "A", "w", 0, 5) == 40.0
    s.upsert(frame(row(1, 5.0)))  # a late write to an archived epoch
    assert s.archive(5) == [1] and s.query_range("t", "A", "w", 1, 1) == 25.0 and s.archive(5) == []
    s.delete(frame(row(5)))
    assert s.warm().count() == 0 and s.cold().count() == 2
    changes = spark.createDataFrame([(*row(0), 1, True), (*row(0, 7.0), 2, False), (*row(1), 1, True)], "tenant_id string, entity_id string, window_name string, epoch long, aggregate double, version long, seq int, deleted boolean")
    assert [(r["epoch"], r["aggregate"]) for r in apply_changes(s.cold(), changes).collect()] == [(0, 7.0)]
    assert expire(s.cold(), frame(row(0))).count() == 1
    back, bit = read_with_fallback(spark, str(tmp_path / "none"), frame(row(9)))
    assert back.count() == 1 and spark.range(1).select(bit.alias("b")).first()["b"] == STATE_STORE_UNAVAILABLE
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        spark.read.parquet(str(tmp_path / "broken")).count()
    assert StoreError("Unavailable").code == "Unavailable"


def test_archive_broken_off(spark, tmp_path, monkeypatch):
    """Whatever step a move to the cold tier is stopped after, nothing counts twice or is lost."""
    for step in range(4):
        s = Snapshot(spark, str(tmp_path / f"s{step}"))
        s.upsert(spark.createDataFrame([("t", "A", "w", e, 10.0, 1) for e in (0, 1, 7)], WINDOW_STATE))
        calls = []

        def broken(name, of=Snapshot):
            real = getattr(of, name)

            def run(self, *a):
                calls.append(name)
                if len(calls) > step:
                    raise OSError("stopped")
                return real(self, *a)

            return run

        with monkeypatch.context() as m:
            for name in ("_replace", "_drop"):
                m.setattr(Snapshot, name, broken(name))
            if step < 3:
                with pytest.raises(OSError):
                    s.archive(5)
            else:
                s.archive(5)
        again = Snapshot(spark, s.path)
        assert again.query_range("t", "A", "w", 0, 9) == 30.0
        assert again.archive(5) == [] and again.cold().count() == 2 and again.warm().count() == 1


def test_conditional_update(spark, tmp_path):
    s = Snapshot(spark, str(tmp_path / "s"))
    s.upsert(spark.createDataFrame([("t", "A", "w", e, 10.0, e + 1) for e in range(3)], WINDOW_STATE))
    changes = spark.createDataFrame([("t", "A", "w", e, a, v) for e, a, v in ((0, 1.0, 1), (1, 2.0, 1), (2, 3.0, 3), (9, 4.0, 0), (9, 5.0, 0))], "tenant_id string, entity_id string, window_name string, epoch long, aggregate double, expected long")
    assert sorted((r["epoch"], r["aggregate"], r["applied"]) for r in s.update(changes).collect()) == [(0, 1.0, True), (1, 2.0, False), (2, 3.0, True), (9, 4.0, True), (9, 5.0, False)]
    assert sorted((r["epoch"], r["aggregate"], r["version"]) for r in s.warm().collect()) == [(0, 1.0, 2), (1, 10.0, 2), (2, 3.0, 4), (9, 4.0, 1)]


def test_write_back(spark, tmp_path, monkeypatch):
    from verdictflow.sources import WriteBack

    s = Snapshot(spark, str(tmp_path / "s"))
    store, key = WriteBack(s), ("t", "A", "w", 0)
    assert store.get(*key) == (0.0, 0) and store.compare_and_set(key, 0, 1.0) and store.compare_and_set(key, 1, 2.0) and not store.compare_and_set(key, 0, 9.0)
    assert s.warm().count() == 0 and store.query_range("t", "A", "w", 0, 9) == 2.0
    assert WriteBack(s).get(*key) == (2.0, 2)  # recovery
    store.compare_and_set(key, 2, 3.0)
    with monkeypatch.context() as m:
        m.setattr(Snapshot, "upsert", lambda *a: (_ for _ in ()).throw(OSError("down")))
        with pytest.raises(OSError):
            store.flush()
    assert store.flush() == 1 and lookup(s.warm(), *key) == (3.0, 3)  # what failed was kept
    store.expire(*key)
    assert store.get(*key) == (0.0, 0) and store.compare_and_set(key, 0, 5.0) and store.flush() == 2
    assert lookup(s.warm(), *key) == (5.0, 1)
    store.expire(*key)
    store.flush()
    assert s.warm().count() == 0


def test_cap_against_folding(spark):
    rng = np.random.default_rng(3)
    rows = [("ab"[int(rng.integers(2))], i, int(rng.integers(60)), 0) for i in range(120)]
    rows = [(t, i, b, b + int(rng.integers(1, 15))) for t, i, b, _ in rows]
    got = {r["event_id"] for r in ratelimit.cap(spark.createDataFrame(rows, "tenant_id string, event_id long, begin long, end long"), 2).filter("admitted").collect()}
    want = set()
    for t in "ab":
        open_ = []
        for _, i, b, e in sorted((x for x in rows if x[0] == t), key=lambda x: (x[2], x[1])):
            open_ = [x for x in open_ if x > b]
            if len(open_) < 2:
                open_.append(e)
                want.add(i)
    assert got == want


def test_cas():
    gone = []
    s = CasStore(lambda k, v: gone.append((k, v)))
    assert s.get("k") == (0.0, 0) and s.compare_and_set(("k",), 0, 1.0) and not s.compare_and_set(("k",), 0, 9.0) and s.get("k") == (1.0, 1)

    def add():
        for _ in range(50):
            while not s.compare_and_set(("n",), (x := s.get("n"))[1], x[0] + 1):
                pass

    ts = [threading.Thread(target=add) for _ in range(8)]
    [t.start() for t in ts]
    [t.join() for t in ts]
    assert s.get("n") == (400.0, 400)
    s.expire("k")
    assert gone == [(("k",), (1.0, 1))] and s.get("k") == (0.0, 0)


def test_routing(spark, tmp_path):
    names = spark.createDataFrame([(f"tenant-{i}",) for i in range(200)], "tenant_id string")
    for n, k in ((16, 4), (16, 15), (8, 8), (31, 4)):
        for r in names.select(routing.cells(F.col("tenant_id"), n, k).alias("c")).collect():
            assert len(set(r["c"])) == k and all(0 <= x < n for x in r["c"])
    assert sum(r["pairs"] for r in routing.shared_owner_pairs(names, 31, 4).collect()) < 20
    (tmp_path / "t.json").write_text(json.dumps([{"id": i, "address": f"h{i}"} for i in range(8)]))
    hints = routing.redirect_hint(names, load_topology(spark, str(tmp_path / "t.json")), 8, 2)
    assert all(len(r["hint"].split(",")) == 2 for r in hints.collect()) and hints.count() == 200
    assert all(r["hint"] == "" for r in routing.redirect_hint(names, None, 8, 2).collect())
    assert names.filter(routing.owns(F.col("tenant_id"), 3, 1, 1)).count() == 200
    assert json.loads(routing.topology_json(0, 1, 1)) == {"fleet_routing": "disabled"}


def test_rate_limits(spark):
    df = events(spark, [("a", "e", "x", i, {}) for i in range(15)] + [("b", "e", "x", 0, {})] * 2)
    n = lambda x: {r["tenant_id"]: r["count"] for r in x.filter("admitted").groupBy("tenant_id").count().collect()}
    assert n(ratelimit.admit(df, 10)) == {"a": 10, "b": 2}
    assert n(ratelimit.admit(df, 10, 500, "continuous")) == {"a": 15, "b": 2}  # half a token a millisecond
    assert n(ratelimit.admit(df, 3, 0, "continuous")) == {"a": 3, "b": 2}
    c = config()
    from verdictflow.plans.config import RateLimit

    c.rate_limit = RateLimit(10, refill="none")
    out = Pipeline(c, F.lit(T0)).start().run(df)
    assert out.decisions.count() == 12 and out.rejected.count() == 5


def test_buckets_last(spark):
    """A batch and single events take from the same bucket; a refilling one is filled by event time."""
    from verdictflow.plans.config import RateLimit

    one = lambda ms, tenant="a": {"event_id": 1, "tenant_id": tenant, "entity_id": "e", "event_type": "x", "timestamp": T0 + timedelta(milliseconds=ms), "tags": []}

    def admitted(p, *at):
        n = 0
        for ms in at:
            try:
                p.evaluate_one(spark, one(ms))
                n += 1
            except SyncSubmitError as e:
                assert (e.code, e.detail) == ("RateLimited", "Exhausted")
        return n

    c = config()
    c.rate_limit = RateLimit(3, refill="none")
    assert admitted(Pipeline(c, F.lit(T0)).start(), *range(6)) == 3
    p = Pipeline(c, F.lit(T0)).start()
    df = events(spark, [("a", "e", "x", i, {}) for i in range(2)] + [("b", "e", "x", i, {}) for i in range(5)])
    assert [p.run(df).decisions.count() for _ in range(2)] == [5, 5]
    assert p.submit(df).rejected.count() == 2 and admitted(p, 0, 1) == 1 and p.submit(df).decisions.count() == 0
    c.rate_limit = RateLimit(2, 1000, refill="continuous")  # a token a millisecond
    p = Pipeline(c, F.lit(T0)).start()
    assert admitted(p, 0, 0, 0, 1, 1) == 3 and p.submit(events(spark, [("a", "e", "x", 2, {})] * 3)).decisions.count() >= 1
    c.rate_limit = RateLimit(10, max_concurrent=0, refill="none")
    with pytest.raises(SyncSubmitError) as e:
        Pipeline(c, F.lit(T0)).start().evaluate_one(spark, one(0))
    assert (e.value.code, e.value.detail) == ("RateLimited", "ConcurrencyCapReached")


@pytest.mark.parametrize("capacity", [1, 3, 40])
def test_burst_against_ranks(spark, capacity):
    rng = np.random.default_rng(capacity)
    rows = [("ab"[int(rng.integers(2))], "e", "x", int(rng.integers(50)), {}) for _ in range(300)]
    df = events(spark, rows)
    got = {r["event_id"] for r in ratelimit.admit(df, capacity).filter("admitted").collect()}
    want = {i + 1 for t in "ab" for _, i in sorted((r[3], i) for i, r in enumerate(rows) if r[0] == t)[:capacity]}
    assert got == want
    left = {r["tenant_id"]: r["level"] for r in ratelimit.after(df.filter("event_id <= 20"), capacity).collect()}
    assert left == {t: 1_000_000 * max(0, capacity - sum(r[0] == t for r in rows[:20])) for t in {r[0] for r in rows[:20]}}


@pytest.mark.parametrize("kind", ["count", "distinct"])
def test_stream_goes_on_counting(spark, tmp_path, kind):
    """150 events of one entity in three micro-batches and two runs: those after the hundredth are flagged, as in one batch."""
    df = events(spark, [("t", "A", "x", i, {"v": str(i)}) for i in range(150)] + [("t", "B", "x", i, {"v": str(i)}) for i in range(50)])
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    c = config().with_evaluators(Threshold(100, 60_000, kind, value_tag="v")).with_targets(ParquetFiles(out))
    for parts in ([(1, 70), (71, 120)], [(121, 200)]):
        write_files(df, src, parts)
        p = Pipeline(c, F.lit(T0)).start()
        p.stream(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(src), str(tmp_path / "ck"))
        p.drain(120)
    back = spark.read.parquet(out)
    assert back.count() == 200 and sorted(r["event_id"] for r in back.filter(F.col("final_verdict") == FLAG).collect()) == list(range(101, 151))


def test_stream_buckets_and_repeated_batches(spark, tmp_path):
    from verdictflow.plans.config import RateLimit
    from verdictflow.plans.pipeline import Counters
    from verdictflow.sources import Versions

    df = events(spark, [("t", "A", "x", i, {}) for i in range(20)])
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_files(df, src, [(1, 8), (9, 20)])
    c = config().with_evaluators(Threshold(2, 60_000)).with_targets(ParquetFiles(out))
    c.rate_limit = RateLimit(10, refill="none")
    p = Pipeline(c, F.lit(T0)).start()
    p.stream(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(src), str(tmp_path / "ck"))
    p.drain(120)
    assert spark.read.parquet(out).count() == 10
    counters = Counters(c, Versions(spark, str(tmp_path / "v")), None)
    for batch, lo in ((0, 1), (1, 9), (1, 9)):  # the last one runs again
        now = counters.before(batch)
        counters.leave(now, batch, df.filter(F.col("event_id").between(lo, lo + 7)))
    assert [r["aggregate"] for r in counters.before(2).evaluation.evaluators[0].prior.collect()] == [16.0]


def test_percentiles(spark):
    df = spark.range(1000).select(F.lit("t").alias("t"), F.col("id").alias("v"))
    assert metrics.ranked_percentiles(df, F.col("v"), (50, 99), "t").first().asDict() == {"t": "t", "p50": 500, "p99": 990}


def test_life_cycle(spark):
    p = Pipeline(config().with_evaluators(AllowDeny(deny=["bad"])), F.lit(T0))
    one = {"event_id": 1, "tenant_id": "t", "entity_id": "bad", "event_type": "x", "timestamp": T0, "tags": []}

    def code(f):
        with pytest.raises((PipelineError, SyncSubmitError)) as e:
            f()
        return e.value.code

    assert code(lambda: p.run(None)) == "NotStarted" and code(lambda: p.evaluate_one(spark, one)) == "NotStarted" and code(p.drain) == "NotStarted"
    p.start()
    assert code(p.start) == "AlreadyRunning"
    assert p.evaluate_one(spark, one)["final_verdict"] == BLOCK
    assert code(lambda: p.evaluate_one(spark, one | {"entity_id": ""})) == "ValidationFailed"
    stop = threading.Event()
    stop.set()
    assert code(lambda: p.evaluate_one(spark, one, cancelled=stop)) == "Cancelled" and code(lambda: p.evaluate_one(spark, one, timeout_s=0.0)) == "Timeout"
    assert p.status()["state"] == "running"
    p.drain()
    assert p.state == "stopped" and code(lambda: p.run(None)) == "PipelineUnavailable"
    assert p.start().state == "running"


def test_http_events(spark):
    df = http_events(spark.createDataFrame([('{"tenant_id":"t","entity_id":"e"}',), ("nonsense",)], "value string"))
    ds = decide(config(), df)
    assert [d["final_verdict"] for d in ds] == [FLAG, PASS] and ds[1]["degraded_reason"] == INGEST_VALIDATION_FAILED


def write_files(df, path, parts):
    for lo, hi in parts:
        df.filter(F.col("event_id").between(lo, hi)).coalesce(1).write.mode("append").parquet(path)


def test_streams(spark, tmp_path):
    """Micro-batches, a restart between them, and the same counts as in batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    df = events(spark, [("t", f"u{i % 2}", "x", i, {}) for i in range(60)])
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    for lo, hi in ((1, 40), (41, 60)):
        write_files(df, src, [(lo, hi)])
        stream = spark.readStream.schema(EVENT).parquet(src)
        running_counts(stream, 60_000).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    got = {r["event_id"]: r["window_count"] for r in spark.read.parquet(out).collect()}
    assert got == {i + 1: i // 2 + 1 for i in range(60)}
    admitted = []
    q = token_buckets(spark.readStream.schema(EVENT).parquet(src), 10).writeStream.foreachBatch(lambda b, _: admitted.extend(b.collect())).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["event_id"] for r in admitted if r["admitted"]) == list(range(1, 11)) and len(admitted) == 60
    p = Pipeline(config().with_evaluators(AllowDeny(deny=["u1"])).with_targets(ParquetFiles(str(tmp_path / "d"))), F.lit(T0)).start()
    p.stream(spark.readStream.schema(EVENT).parquet(src), str(tmp_path / "ck3"))
    p.drain(120)
    back = spark.read.parquet(str(tmp_path / "d"))
    assert back.count() == 60 and back.filter(F.col("final_verdict") == BLOCK).count() == 30 and stage_of(back, "eval") is not None
    counted = session_counts(spark.readStream.schema(EVENT).parquet(src), "10 seconds", "entity_id", watermark="1 minute").writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / "ck4")).trigger(availableNow=True).start()
    counted.awaitTermination(120)
    assert counted.exception() is None
