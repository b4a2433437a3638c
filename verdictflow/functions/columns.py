"""Column builders that operators and plans share. All of them are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import VERDICTS

#: A number of plain decimal form in at most 63 characters, blanks before it allowed.
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\z"
NUMBER_CHARS = 63


def true_or_false(c: Column) -> Column:
    """Two-valued logic: unknown is false."""
    return F.coalesce(c, F.lit(False))


def verdict_name(c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), c + 1)


def first_tag(tags: Column, key: str) -> Column:
    """The value of the first tag with this key; null where there is none."""
    return F.get(F.filter(tags, lambda t: t["key"] == key), F.lit(0))["value"]


def event_tag(tags: Column, key: str) -> Column:
    """first_tag with the empty string where there is none."""
    return F.coalesce(first_tag(tags, key), F.lit(""))


def any_tag(tags: Column, key: str, value: str | None = None) -> Column:
    test = (lambda t: t["key"] == key) if value is None else (lambda t: (t["key"] == key) & (t["value"] == value))
    return true_or_false(F.exists(tags, test))


def number_of(text: Column) -> Column:
    """The finite number that the whole text spells, else null."""
    value = F.when((F.length(text) <= NUMBER_CHARS) & text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def epoch_of(ts: Column, window_ms: int) -> Column:
    """The number of the tumbling window of event time; 0 for windows without length."""
    return F.lit(0).cast("long") if window_ms <= 0 else F.floor(F.unix_millis(ts) / F.lit(window_ms)).cast("long")


def hash60(text: Column) -> Column:
    """The first 60 bits of md5 as a long: the same number in any SQL dialect."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def all_of(parts: list[Column], empty: bool = True) -> Column:
    out = F.lit(empty) if not parts else parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def result(evaluator_id: str | Column, verdict: Column | int, reason: Column | str | None = None, score: Column | None = None, skipped: Column | bool = False, metadata: Column | None = None, decision_type: str | None = None, error: Column | None = None) -> Column:
    """An evaluator's result struct; error (timeout or internal) makes the stage apply its failure mode."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        lit(evaluator_id).cast("string").alias("evaluator_id"), lit(verdict).cast("int").alias("verdict"), lit(reason).cast("string").alias("reason_code"), lit(score).cast("float").alias("score"),
        lit(skipped).cast("boolean").alias("skipped"), lit(metadata).cast("string").alias("metadata"), lit(decision_type).cast("string").alias("decision_type_id"), lit(error).cast("string").alias("error"),
    )
