"""Decisions as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import verdict_name
from ..schema import DECISION


def audit_lines(decisions: DataFrame) -> DataFrame:
    """One JSON line a decision: event_id, tenant_id, entity_id, final_verdict, degraded, elapsed_us."""
    return decisions.select(F.to_json(F.struct("event_id", "tenant_id", "entity_id", verdict_name(F.col("final_verdict")).alias("final_verdict"), (F.col("degraded_reason") != 0).alias("degraded"), F.coalesce("elapsed_us", F.lit(0)).alias("elapsed_us"))).alias("value"))


def stdout_lines(decisions: DataFrame) -> DataFrame:
    return decisions.select(F.format_string("[decision] event=%s tenant=%s entity=%s verdict=%s elapsed_us=%s degraded=%s", F.col("event_id").cast("string"), "tenant_id", "entity_id", verdict_name(F.col("final_verdict")), F.coalesce("elapsed_us", F.lit(0)).cast("string"), F.when(F.col("degraded_reason") != 0, "1").otherwise("0")).alias("value"))


def decision_json(decisions: DataFrame) -> DataFrame:
    """The whole decision as JSON, verdicts by name; decided_at in microseconds; active_decisions only
    where there are some. decisions_from_json reads it back without loss."""
    result = lambda r: F.struct(r["evaluator_id"].alias("evaluator_id"), verdict_name(r["verdict"]).alias("verdict"), r["reason_code"].alias("reason_code"), r["skipped"].alias("skipped"), r["score"].alias("score"), r["metadata"].alias("metadata"), r["decision_type_id"].alias("decision_type_id"))
    stage = lambda s: F.struct(s["stage_id"].alias("stage_id"), verdict_name(s["verdict"]).alias("verdict"), s["elapsed_us"].alias("elapsed_us"), s["degraded_reason"].alias("degraded"), F.transform(s["evaluator_results"], result).alias("evaluator_results"))
    return decisions.select(
        F.to_json(F.struct(
            "pipeline_id", "pipeline_version", "event_id", "tenant_id", "entity_id", verdict_name(F.col("final_verdict")).alias("final_verdict"), "elapsed_us", "degraded_reason", F.unix_micros("decided_at").alias("decided_at_us"),
            F.transform("stage_outputs", stage).alias("stage_outputs"), F.when(F.size("active_decisions") > 0, F.col("active_decisions")).alias("active_decisions"),
        )).alias("value")
    )


_WIRE = """pipeline_id string, pipeline_version string, event_id long, tenant_id string, entity_id string, final_verdict string, elapsed_us long, degraded_reason int, decided_at_us long,
stage_outputs array<struct<stage_id:string,verdict:string,elapsed_us:bigint,degraded:int,evaluator_results:array<struct<evaluator_id:string,verdict:string,reason_code:string,skipped:boolean,score:float,metadata:string,decision_type_id:string>>>>,
active_decisions array<struct<decision_type_id:string,rule_id:string,priority:int>>"""


def _ordinal(name: Column) -> Column:
    return F.when(name == "flag", 1).when(name == "block", 2).otherwise(0)


def decisions_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    d = lines.select(F.from_json(column, _WIRE.replace("\n", " ")).alias("d")).select("d.*")
    result = lambda r: F.struct(r["evaluator_id"].alias("evaluator_id"), _ordinal(r["verdict"]).alias("verdict"), r["reason_code"].alias("reason_code"), r["score"].alias("score"), r["skipped"].alias("skipped"), r["metadata"].alias("metadata"), r["decision_type_id"].alias("decision_type_id"))
    stage = lambda s: F.struct(s["stage_id"].alias("stage_id"), _ordinal(s["verdict"]).alias("verdict"), F.transform(s["evaluator_results"], result).alias("evaluator_results"), s["degraded"].alias("degraded_reason"), s["elapsed_us"].alias("elapsed_us"))
    out = {"decided_at": F.timestamp_micros("decided_at_us"), "stage_outputs": F.transform("stage_outputs", stage), "final_verdict": _ordinal(F.col("final_verdict")), "active_decisions": F.coalesce("active_decisions", F.array().cast("array<struct<decision_type_id:string,rule_id:string,priority:int>>"))}
    return d.select(*[(out[f.name] if f.name in out else F.col(f.name)).cast(f.dataType).alias(f.name) for f in DECISION.fields])
