"""Composition of verdicts: 0 pass, 1 flag, 2 block; Columns in, one Column out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BLOCK, FLAG, PASS


def _n(x: int) -> Column:
    return F.lit(x).cast("int")


def max_verdict(verdicts: list[Column]) -> Column:
    return _n(PASS) if not verdicts else verdicts[0] if len(verdicts) == 1 else F.greatest(*verdicts)


def any_block(verdicts: list[Column]) -> Column:
    """The highest verdict; the same as any_flag."""
    return max_verdict(verdicts)


any_flag = any_block


def unanimous(verdicts: list[Column]) -> Column:
    """Block if all block, else pass; flags vanish."""
    if not verdicts:
        return _n(PASS)
    least = verdicts[0] if len(verdicts) == 1 else F.least(*verdicts)
    return F.when(least == BLOCK, BLOCK).otherwise(PASS)


def majority(verdicts: list[Column]) -> Column:
    """Block if more than half block, else pass."""
    if not verdicts:
        return _n(PASS)
    blocks = reduce(lambda a, b: a + b, [(v == BLOCK).cast("int") for v in verdicts])
    return F.when(2 * blocks > len(verdicts), BLOCK).otherwise(PASS)


RULES = {"any_block": any_block, "any_flag": any_flag, "unanimous": unanimous, "majority": majority, "weighted_score": lambda verdicts: _n(PASS)}


def compose(rule: str, verdicts: list[Column]) -> Column:
    """The evaluation stage's verdict; weighted_score has no meaning there and passes."""
    return RULES[rule](verdicts)


def mean_score(scores: list[Column], skipped: list[Column]) -> Column:
    """The mean of the scores that are set and not skipped, 0 without any; floats throughout."""
    zero = F.lit(0).cast("float")
    use = [s.isNotNull() & ~k for s, k in zip(scores, skipped)]
    if not use:
        return zero
    total = reduce(lambda a, b: (a + b).cast("float"), [F.when(u, s).otherwise(zero) for u, s in zip(use, scores)])
    n = reduce(lambda a, b: a + b, [u.cast("int") for u in use])
    return F.when(n > 0, (total / n.cast("float")).cast("float")).otherwise(zero)


def inference_verdict(rule: str, verdicts: list[Column], scores: list[Column], skipped: list[Column], threshold: float) -> Column:
    """weighted_score: flag above the threshold, evaluators' verdicts ignored; any other rule: the
    highest verdict."""
    if rule != "weighted_score":
        return max_verdict(verdicts)
    return F.when(mean_score(scores, skipped) > F.lit(threshold).cast("float"), FLAG).otherwise(PASS)
