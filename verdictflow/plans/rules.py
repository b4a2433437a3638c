"""Policy rules: a boolean expression tree that compiles to one Column.

Every leaf is true or false, never unknown, so `not` is safe. Nodes combine with & | ~.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import any_tag, first_tag, number_of, true_or_false
from ..schema import VERDICTS


@dataclass
class Scope:
    """What a rule may look at: event columns, the time of judgement, results and stages so far."""

    as_of: Column
    tags: Column = field(default_factory=lambda: F.col("tags"))
    event_type: Column = field(default_factory=lambda: F.col("event_type"))
    tenant: Column = field(default_factory=lambda: F.col("tenant_id"))
    timestamp: Column = field(default_factory=lambda: F.col("timestamp"))
    results: Column | None = None  # array of results of all stages that ran, in order
    verdicts: dict[str, Column] = field(default_factory=dict)
    degraded: dict[str, Column] = field(default_factory=dict)
    tag_columns: dict[str, Column] = field(default_factory=dict)  # first values, projected once

    def first(self, key: str) -> Column:
        return self.tag_columns.get(key, first_tag(self.tags, key))

    def result(self, evaluator: str, scored: bool = False) -> Column:
        """The first result with this id (that has a score); null if none."""
        if self.results is None:
            return F.lit(None).cast("struct<score:float,skipped:boolean,reason_code:string>")
        return F.get(F.filter(self.results, lambda r: (r["evaluator_id"] == evaluator) & r["score"].isNotNull() if scored else r["evaluator_id"] == evaluator), F.lit(0))

    def age_us(self) -> Column:
        return F.unix_micros(self.as_of) - F.unix_micros(self.timestamp)


class Rule:
    def __and__(self, other: Rule) -> Rule:
        return And(self, other)

    def __or__(self, other: Rule) -> Rule:
        return Or(self, other)

    def __invert__(self) -> Rule:
        return Not(self)

    def test(self, s: Scope) -> Column:
        raise NotImplementedError

    def children(self) -> list[Rule]:
        return [x for x in (getattr(self, f.name) for f in fields(self)) if isinstance(x, Rule)]

    def walk(self):
        yield self
        for c in self.children():
            yield from c.walk()


def _leaf(cls):
    """Make a test two-valued."""
    own = cls.test
    cls.test = lambda self, s: true_or_false(own(self, s))
    return dataclass(frozen=True)(cls)


@dataclass(frozen=True)
class And(Rule):
    left: Rule | None
    right: Rule | None

    def test(self, s: Scope) -> Column:
        return self.left.test(s) & self.right.test(s) if self.left and self.right else F.lit(False)


@dataclass(frozen=True)
class Or(Rule):
    left: Rule | None
    right: Rule | None

    def test(self, s: Scope) -> Column:
        return self.left.test(s) | self.right.test(s) if self.left and self.right else F.lit(False)


@dataclass(frozen=True)
class Not(Rule):
    expr: Rule | None

    def test(self, s: Scope) -> Column:
        return ~self.expr.test(s) if self.expr else F.lit(True)


@_leaf
class StageVerdictIs(Rule):
    stage: str
    verdict: int

    def test(self, s: Scope) -> Column:
        return s.verdicts[self.stage] == self.verdict if self.stage in s.verdicts else F.lit(False)


@_leaf
class StageIsDegraded(Rule):
    stage: str

    def test(self, s: Scope) -> Column:
        return s.degraded[self.stage] != 0 if self.stage in s.degraded else F.lit(False)


@_leaf
class EvaluatorScoreAbove(Rule):
    """Any result with this id and a score of at least threshold."""

    evaluator: str
    threshold: float

    def test(self, s: Scope) -> Column:
        return F.lit(False) if s.results is None else F.exists(s.results, lambda r: true_or_false((r["evaluator_id"] == self.evaluator) & (r["score"] >= F.lit(self.threshold).cast("float"))))


@_leaf
class EvaluatorScoreBetween(Rule):
    """The first scored result's score lies in [low, high)."""

    evaluator: str
    low: float
    high: float

    def test(self, s: Scope) -> Column:
        score = s.result(self.evaluator, scored=True)["score"]
        return F.lit(False) if self.low >= self.high else (score >= F.lit(self.low).cast("float")) & (score < F.lit(self.high).cast("float"))


@_leaf
class EvaluatorWasSkipped(Rule):
    evaluator: str

    def test(self, s: Scope) -> Column:
        return s.result(self.evaluator)["skipped"]


@_leaf
class EvaluatorReasonIs(Rule):
    evaluator: str
    reason: str

    def test(self, s: Scope) -> Column:
        return s.result(self.evaluator)["reason_code"] == self.reason


@_leaf
class TagEquals(Rule):
    """Any tag with this key has this value; all other tag rules look at the first one."""

    key: str
    value: str

    def test(self, s: Scope) -> Column:
        return any_tag(s.tags, self.key, self.value)


@_leaf
class TagExists(Rule):
    key: str

    def test(self, s: Scope) -> Column:
        return any_tag(s.tags, self.key)


@_leaf
class TagContains(Rule):
    key: str
    part: str

    def test(self, s: Scope) -> Column:
        return F.contains(s.first(self.key), F.lit(self.part))


@_leaf
class TagStartsWith(Rule):
    key: str
    prefix: str

    def test(self, s: Scope) -> Column:
        return F.startswith(s.first(self.key), F.lit(self.prefix))


@_leaf
class TagIn(Rule):
    key: str
    values: tuple[str, ...]

    def test(self, s: Scope) -> Column:
        return s.first(self.key).isin(*self.values) if self.values else F.lit(False)


@_leaf
class TagValueLessThan(Rule):
    key: str
    bound: float

    def test(self, s: Scope) -> Column:
        return number_of(s.first(self.key)) < F.lit(float(self.bound))


@_leaf
class TagValueGreaterThan(Rule):
    key: str
    bound: float

    def test(self, s: Scope) -> Column:
        return number_of(s.first(self.key)) > F.lit(float(self.bound))


@_leaf
class TagValueBetween(Rule):
    key: str
    low: float
    high: float

    def test(self, s: Scope) -> Column:
        n = number_of(s.first(self.key))
        return F.lit(False) if self.low >= self.high else (n >= F.lit(float(self.low))) & (n < F.lit(float(self.high)))


@_leaf
class EventTypeIs(Rule):
    type: str

    def test(self, s: Scope) -> Column:
        return s.event_type == self.type


@_leaf
class EventTypeIn(Rule):
    types: tuple[str, ...]

    def test(self, s: Scope) -> Column:
        return s.event_type.isin(*self.types) if self.types else F.lit(False)


@_leaf
class TenantIs(Rule):
    tenant: str

    def test(self, s: Scope) -> Column:
        return s.tenant == self.tenant


@_leaf
class EventOlderThan(Rule):
    """Of a positive age above so many milliseconds."""

    ms: int

    def test(self, s: Scope) -> Column:
        age = s.age_us()
        return (age > 0) & (age > self.ms * 1000)


@_leaf
class EventNewerThan(Rule):
    ms: int

    def test(self, s: Scope) -> Column:
        age = s.age_us()
        return (age >= 0) & (age < self.ms * 1000)


LEAVES: dict[str, Callable[..., Rule]] = {
    "stage_verdict_is": lambda stage, verdict: StageVerdictIs(stage, VERDICTS.index(verdict) if isinstance(verdict, str) else verdict),
    "stage_is_degraded": lambda stage: StageIsDegraded(stage),
    "score_above": lambda evaluator, threshold: EvaluatorScoreAbove(evaluator, threshold),
    "score_between": lambda evaluator, low, high: EvaluatorScoreBetween(evaluator, low, high),
    "evaluator_was_skipped": lambda evaluator: EvaluatorWasSkipped(evaluator),
    "evaluator_reason_is": lambda evaluator, reason: EvaluatorReasonIs(evaluator, reason),
    "tag_equals": lambda key, value: TagEquals(key, value),
    "tag_exists": lambda key: TagExists(key),
    "tag_contains": lambda key, part: TagContains(key, part),
    "tag_starts_with": lambda key, prefix: TagStartsWith(key, prefix),
    "tag_in": lambda key, values: TagIn(key, tuple(values)),
    "tag_less_than": lambda key, bound: TagValueLessThan(key, bound),
    "tag_greater_than": lambda key, bound: TagValueGreaterThan(key, bound),
    "tag_between": lambda key, low, high: TagValueBetween(key, low, high),
    "event_type_is": lambda type: EventTypeIs(type),
    "event_type_in": lambda types: EventTypeIn(tuple(types)),
    "tenant_is": lambda tenant: TenantIs(tenant),
    "event_older_than": lambda ms: EventOlderThan(ms),
    "event_newer_than": lambda ms: EventNewerThan(ms),
}


def from_dict(d: dict) -> Rule:
    """A rule from its JSON form: {"and": [..]}, {"or": [..]}, {"not": {..}} or {leaf: {arguments}}."""
    from ..errors import ConfigError

    if len(d) != 1:
        raise ConfigError("InvalidPolicyRule", f"a rule has one key, not {sorted(d)}")
    (name, arg), *_ = d.items()
    if name in ("and", "or"):
        parts = [from_dict(x) for x in arg]
        if not parts:
            raise ConfigError("InvalidPolicyRule", f"{name} needs operands")
        out = parts[0]
        for p in parts[1:]:
            out = And(out, p) if name == "and" else Or(out, p)
        return out
    if name == "not":
        return Not(from_dict(arg))
    try:
        return LEAVES[name](**arg)
    except (KeyError, TypeError, ValueError) as e:
        raise ConfigError("InvalidPolicyRule", f"{name}: {e}") from e
