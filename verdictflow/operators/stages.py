"""Stages as struct Columns: (stage_id, verdict, evaluator_results, degraded_reason, elapsed_us)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import result
from ..plans.config import Evaluation, FailureMode, Inference, Ingest, Policy
from ..plans.registry import DecisionTypes
from ..plans.rules import Scope
from ..schema import BLOCK, EVALUATOR_ERROR, EVALUATOR_TIMEOUT, FLAG, INGEST_VALIDATION_FAILED, PASS, RESULT
from .compose import compose, inference_verdict, max_verdict

#: Verdict and reason of a failed evaluator by failure mode.
FAILED = {FailureMode.FAIL_OPEN: (PASS, "fail_open"), FailureMode.FAIL_CLOSED: (BLOCK, "fail_closed"), FailureMode.EMIT_DEGRADED: (PASS, "degraded")}
_FIELDS = [f.name for f in RESULT.fields]


def stage(stage_id: str, verdict: Column, results: Column, degraded: Column | int = 0) -> Column:
    return F.struct(F.lit(stage_id).alias("stage_id"), verdict.cast("int").alias("verdict"), results.cast(_array()).alias("evaluator_results"), (degraded if isinstance(degraded, Column) else F.lit(degraded)).cast("int").alias("degraded_reason"), F.lit(None).cast("long").alias("elapsed_us"))


def _array():
    from pyspark.sql.types import ArrayType

    return ArrayType(RESULT)


def _plain(r: Column) -> Column:
    return F.struct(*[r[f].alias(f) for f in _FIELDS])


def ingest_stage(c: Ingest, as_of: Column) -> Column:
    """Invalid events pass with a degraded bit; late ones are flagged, not dropped."""
    empty = lambda x: F.length(F.coalesce(F.col(x), F.lit(""))) == 0
    bad = empty("tenant_id") | empty("entity_id")
    if c.max_payload_bytes is not None:
        bad = bad | F.coalesce(F.length("payload") > c.max_payload_bytes, F.lit(False))
    # whole milliseconds, rounded toward zero; null timestamps are not late
    late = F.coalesce((F.unix_micros(as_of) - F.unix_micros("timestamp")) >= (c.skew_ms + 1) * 1000, F.lit(False))
    said = F.when(bad, _plain(result("ingest_validator", PASS, "invalid_event_fields"))).when(late, _plain(result("ingest_skew_check", FLAG, "late_arrival"))).otherwise(_plain(result("ingest_validator", PASS)))
    return stage("ingest", F.when(~bad & late, FLAG).otherwise(PASS), F.array(said), F.when(bad, INGEST_VALIDATION_FAILED).otherwise(0))


def evaluate(df: DataFrame, evaluators: list, prefix: str, failed_id: str, mode: FailureMode) -> tuple[DataFrame, list[Column], Column]:
    """df with each evaluator's result in a hidden column; the resolved results and the degraded bits."""
    raw = []
    for i, e in enumerate(evaluators):
        tag = f"{prefix}{i}"
        df = e.prepare(df, tag).withColumn(f"{tag}_result", e.result(tag))
        raw.append(F.col(f"{tag}_result"))
    verdict, reason = FAILED[mode]
    resolved = [F.when(r["error"].isNull(), _plain(r)).otherwise(_plain(result(f"{failed_id}_{i}", verdict, reason, skipped=True))) for i, r in enumerate(raw)]
    bits = [F.when(r["error"].isNull(), 0).when(r["error"] == "timeout", EVALUATOR_TIMEOUT).otherwise(EVALUATOR_ERROR) for r in raw]
    return df, resolved, reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0))


def eval_stage(df: DataFrame, c: Evaluation) -> tuple[DataFrame, Column]:
    df, results, _ = evaluate(df, c.evaluators, "_eval", "evaluator", c.failure_mode)
    names = [f"_eval{i}_plain" for i in range(len(results))]
    errors = [F.when(F.col(f"_eval{i}_result")["error"].isNull(), 0).otherwise(EVALUATOR_ERROR) for i in range(len(results))]
    df = df.withColumns(dict(zip(names, results)))
    cols = [F.col(n) for n in names]
    return df, stage("eval", compose(c.composition, [r["verdict"] for r in cols]), F.array(*cols), reduce(lambda a, b: a.bitwiseOR(b), errors, F.lit(0)))


def inference_stage(df: DataFrame, c: Inference) -> tuple[DataFrame, Column]:
    df, results, bits = evaluate(df, c.evaluators, "_inf", "inference_evaluator", c.failure_mode)
    names = [f"_inf{i}_plain" for i in range(len(results))]
    df = df.withColumns(dict(zip(names, results)))
    cols = [F.col(n) for n in names]
    verdict = inference_verdict(c.composition, [r["verdict"] for r in cols], [r["score"] for r in cols], [r["skipped"] for r in cols], c.score_threshold)
    return df, stage("inference", verdict, F.array(*cols), bits)


def policy_stage(df: DataFrame, c: Policy, types: DecisionTypes | None, scope: Scope) -> tuple[DataFrame, Column, Column]:
    """df with a hidden boolean for each rule, the stage and the active decisions (priority order).

    Without registered typed rules only the first match counts. With them all matches count: untyped
    ones for the verdict; of typed ones the first of each type, less the losers of exclusive pairs that
    both fired (losers are found before any is removed)."""
    fired = {f"_rule{i}": r.rule.test(scope) for i, r in enumerate(c.rules)}
    df = df.withColumns(fired) if fired else df
    hit = [F.col(f"_rule{i}") for i in range(len(c.rules))]
    said = [_plain(result(r.rule_id or "policy_rule", r.verdict, r.rule_id, decision_type=r.decision_type)) for r in c.rules]
    none = F.array().cast(_active())
    if not (types and any(r.decision_type is not None for r in c.rules)):
        # a chain of `when` is the first match
        first = F.lit(None).cast(RESULT)
        for h, s in reversed(list(zip(hit, said))):
            first = F.when(h, s).otherwise(first)
        df = df.withColumn("_first", first)
        results = F.when(F.col("_first").isNull(), F.array().cast(_array())).otherwise(F.array("_first"))
        return df, stage("policy", F.coalesce(F.col("_first")["verdict"], F.lit(PASS)), results), none
    typed: dict[str, list[int]] = {}
    for i, r in enumerate(c.rules):
        if r.decision_type is not None:
            typed.setdefault(r.decision_type, []).append(i)
    any_of = lambda ids: reduce(lambda a, b: a | b, [hit[i] for i in ids])
    occurs = {t: any_of(ids) for t, ids in typed.items()}
    survives = dict(occurs)
    for loser, winner in types.losers():
        if loser in occurs and winner in occurs:
            survives[loser] = survives[loser] & ~occurs[winner]
    null = F.lit(None).cast(RESULT)
    parts = [F.when(hit[i], said[i]).otherwise(null) for i, r in enumerate(c.rules) if r.decision_type is None]
    # a type's survivor is its first rule that fired; results keep the rules' order
    for i, r in enumerate(c.rules):
        if r.decision_type is not None:
            earlier = [j for j in typed[r.decision_type] if j < i]
            own = hit[i] & survives[r.decision_type]
            parts.append(F.when(own & ~any_of(earlier) if earlier else own, said[i]).otherwise(null))
    df = df.withColumn("_policy", F.filter(F.array(*parts), lambda r: r.isNotNull()))
    verdict = F.coalesce(F.array_max(F.transform("_policy", lambda r: r["verdict"])), F.lit(PASS))
    order = [t.id for t in types.types]
    ranks = {t.id: t.priority for t in types.types}
    by_type = lambda t: F.get(F.filter("_policy", lambda r: r["decision_type_id"] == t), F.lit(0))
    # stable: priority, then the first rule of the type
    sequence = sorted(typed, key=lambda t: (ranks[t], typed[t][0])) if order else []
    active = F.array(*[F.when(by_type(t).isNotNull(), F.struct(F.lit(t).alias("decision_type_id"), by_type(t)["evaluator_id"].alias("rule_id"), F.lit(ranks[t]).alias("priority"))) for t in sequence])
    return df, stage("policy", verdict, F.col("_policy")), F.filter(active, lambda a: a.isNotNull()).cast(_active())


def _active():
    from pyspark.sql.types import ArrayType

    from ..schema import ACTIVE

    return ArrayType(ACTIVE)


def final_verdict(stages: list[Column]) -> Column:
    return max_verdict([s["verdict"] for s in stages])


def merged_degraded(stages: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), [s["degraded_reason"] for s in stages])
