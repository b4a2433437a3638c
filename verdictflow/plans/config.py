"""Pipeline declarations: a fluent builder, a JSON form and validation."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from ..errors import ConfigError
from ..schema import BLOCK, VERDICTS
from .registry import DecisionTypes
from .rules import Rule, StageVerdictIs, from_dict


class FailureMode(Enum):
    """What a failed evaluator counts as: (verdict, reason)."""

    FAIL_OPEN = "fail_open"
    FAIL_CLOSED = "fail_closed"
    EMIT_DEGRADED = "emit_degraded"


COMPOSITIONS = ("any_block", "any_flag", "unanimous", "majority", "weighted_score")


@dataclass
class Ingest:
    skew_ms: int = 30_000
    timeout_ms: int = 5
    max_payload_bytes: int | None = None


@dataclass
class Evaluation:
    evaluators: list = field(default_factory=list)
    composition: str = "any_block"
    failure_mode: FailureMode = FailureMode.FAIL_OPEN
    timeout_ms: int = 10


@dataclass
class Inference:
    evaluators: list = field(default_factory=list)
    composition: str = "weighted_score"
    score_threshold: float = 0.5
    failure_mode: FailureMode = FailureMode.FAIL_OPEN
    timeout_ms: int = 200


@dataclass(frozen=True)
class PolicyRule:
    rule: Rule
    priority: int = 0
    verdict: int = BLOCK
    rule_id: str = ""
    decision_type: str | None = None


@dataclass
class Policy:
    rules: list[PolicyRule] = field(default_factory=list)
    failure_mode: FailureMode = FailureMode.FAIL_CLOSED
    timeout_ms: int = 20

    def add(self, rule: Rule, priority: int = 0, verdict: int = BLOCK, rule_id: str = "", decision_type: str | None = None) -> Policy:
        """Rules are kept by ascending priority, equal ones in the order they were added."""
        self.rules.append(PolicyRule(rule, priority, verdict, rule_id, decision_type))
        self.rules.sort(key=lambda r: r.priority)
        return self


@dataclass
class Emit:
    targets: list = field(default_factory=list)
    failure_mode: FailureMode = FailureMode.EMIT_DEGRADED
    retry_limit: int = 3
    base_ms: int = 10
    timeout_ms: int = 10


@dataclass(frozen=True)
class Sharding:
    num_cells: int = 16
    cells_per_tenant: int = 4


@dataclass(frozen=True)
class RateLimit:
    """A tenant's bucket. refill: "none" admits capacity events in all, "continuous" refills."""

    capacity: int = 1000
    per_second: int = 500
    max_concurrent: int = 100
    refill: str = "continuous"


@dataclass
class PipelineConfig:
    pipeline_id: str
    version: str = "1.0.0"
    latency_budget_ms: int = 300
    ingest: Ingest = field(default_factory=Ingest)
    evaluation: Evaluation | None = None
    inference: Inference | None = None
    policy: Policy | None = None
    emit: Emit = field(default_factory=Emit)
    sharding: Sharding = field(default_factory=Sharding)
    rate_limit: RateLimit | None = None
    decision_types: DecisionTypes | None = None

    # fluent form -------------------------------------------------------------------------------
    def with_ingest(self, **kw) -> PipelineConfig:
        self.ingest = Ingest(**kw)
        return self

    def with_evaluators(self, *evaluators, **kw) -> PipelineConfig:
        self.evaluation = Evaluation(list(evaluators), **kw)
        return self

    def with_inference(self, *scorers, **kw) -> PipelineConfig:
        self.inference = Inference(list(scorers), **kw)
        return self

    def with_policy(self, policy: Policy) -> PipelineConfig:
        self.policy = policy
        return self

    def with_decision_types(self, types: DecisionTypes) -> PipelineConfig:
        self.decision_types = types
        return self

    def with_targets(self, *targets, **kw) -> PipelineConfig:
        self.emit = Emit(list(targets), **kw)
        return self

    def build(self) -> PipelineConfig:
        """self if it is valid; the first fault is raised."""
        if not self.emit.targets:
            raise ConfigError("RequiredStageMissing", "emit needs at least one target")
        total = sum(s.timeout_ms for s in (self.ingest, self.evaluation, self.inference, self.policy, self.emit) if s)
        if total > self.latency_budget_ms:
            raise ConfigError("LatencyBudgetExceeded", f"stage timeouts are {total} ms of {self.latency_budget_ms}")
        if self.sharding.cells_per_tenant >= self.sharding.num_cells:
            raise ConfigError("InvalidShardingConfig", f"{self.sharding.cells_per_tenant} cells a tenant of {self.sharding.num_cells}")
        there = {"ingest", "emit"} | {n for n, s in (("eval", self.evaluation), ("inference", self.inference)) if s}
        for r in self.policy.rules if self.policy else ():
            for node in r.rule.walk():
                if isinstance(node, StageVerdictIs) and node.stage not in there:
                    raise ConfigError("UndefinedStageDependency", f"rule {r.rule_id or '(unnamed)'} looks at stage {node.stage}")
            if r.decision_type is not None and (not self.decision_types or not self.decision_types.find(r.decision_type)):
                raise ConfigError("InvalidPolicyRule", f"rule {r.rule_id or '(unnamed)'} has unregistered decision type {r.decision_type}")
        if not self.pipeline_id:
            raise ConfigError("InvalidConfig", "empty pipeline_id")
        if not 1 <= self.latency_budget_ms <= 10_000:
            raise ConfigError("InvalidConfig", f"latency budget of {self.latency_budget_ms} ms")
        return self

    # JSON form ---------------------------------------------------------------------------------
    @classmethod
    def from_json(cls, text: str, evaluators: dict[str, Callable[[dict], object]] | None = None, targets: dict[str, Callable[[dict], object]] | None = None) -> PipelineConfig:
        """A validated config. evaluators and targets add to the types that configs may name."""
        from ..operators.evaluators import JSON_EVALUATORS
        from ..sinks.targets import JSON_TARGETS

        try:
            d = json.loads(text)
        except ValueError as e:
            raise ConfigError("InvalidConfig", str(e)) from e
        known, sinks = JSON_EVALUATORS | (evaluators or {}), JSON_TARGETS | (targets or {})

        def make(table: dict, x: dict):
            if x.get("type") not in table:
                raise ConfigError("InvalidConfig", f"unknown type {x.get('type')}")
            return table[x["type"]](x.get("config", {}))

        stages = {_STAGE_NAMES.get(k, k): v for k, v in d.get("stages", {}).items()}
        for k in ("emit",):
            if k not in stages:
                raise ConfigError("RequiredStageMissing", "emit needs at least one target")
        pick = lambda s, names: {names[k]: v for k, v in s.items() if k in names}
        mode = lambda s, default: FailureMode(s.get("failure_mode", default.value))
        out = cls(d.get("pipeline_id", ""), str(d.get("pipeline_version", "1.0.0")), d.get("latency_budget_ms", 300))
        out.sharding = Sharding(**d.get("sharding", {}))
        if "rate_limit" in d:
            out.rate_limit = RateLimit(**d["rate_limit"])
        if s := stages.get("ingest"):
            out.ingest = Ingest(**pick(s, {"skew_tolerance_ms": "skew_ms", "timeout_ms": "timeout_ms", "max_payload_bytes": "max_payload_bytes"}))
        if s := stages.get("eval"):
            out.evaluation = Evaluation([make(known, x) for x in s["evaluators"]], s.get("composition", "any_block"), mode(s, FailureMode.FAIL_OPEN), s.get("timeout_ms", 10))
        if s := stages.get("inference"):
            out.inference = Inference([make(known, x) for x in s["evaluators"]], s.get("composition", "weighted_score"), s.get("score_threshold", 0.5), mode(s, FailureMode.FAIL_OPEN), s.get("timeout_ms", 200))
        for s in (out.evaluation, out.inference):
            if s and s.composition not in COMPOSITIONS:
                raise ConfigError("InvalidConfig", f"unknown composition {s.composition}")
        if types := d.get("decision_types"):
            out.decision_types = DecisionTypes()
            for t in types.get("types", []):
                out.decision_types.add(t["id"], t.get("display_name", ""), t.get("priority", 100))
            for a, b in types.get("incompatible", []):
                out.decision_types.exclude(a, b)
        if s := stages.get("policy"):
            out.policy = Policy(failure_mode=mode(s, FailureMode.FAIL_CLOSED), timeout_ms=s.get("timeout_ms", 20))
            for r in s["rules"]:
                out.policy.add(from_dict(_renamed(r["expression"])), r.get("priority", 0), VERDICTS.index(r.get("action", "block")), r.get("rule_id", ""), r.get("decision_type"))
        s = stages["emit"]
        out.emit = Emit([make(sinks, x) for x in s.get("targets", [])], mode(s, FailureMode.EMIT_DEGRADED), s.get("retry_limit", 3), s.get("retry_backoff", {}).get("base_ms", 10), s.get("timeout_ms", 10))
        return out.build()


#: Stages' long names in JSON.
_STAGE_NAMES = {"lightweight_eval": "eval", "ml_inference": "inference", "policy_eval": "policy"}


def _renamed(d):
    if isinstance(d, dict):
        return {k: (_STAGE_NAMES.get(v, v) if k == "stage" else _renamed(v)) for k, v in d.items()}
    return [_renamed(x) for x in d] if isinstance(d, list) else d
