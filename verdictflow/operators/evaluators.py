"""Evaluators: each prepares hidden columns of the events and gives a Column of its result.

prepare(df, tag) may add columns whose names begin with tag; result(tag) uses them. Built-in ones are
DataFrame expressions; Python scorers run as Arrow-batched UDFs that turn a fault into the result's
error, so one bad row never fails a job.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import EvaluatorError
from ..functions import epoch_of, event_tag, number_of, result
from ..schema import BLOCK, FLAG, PASS, VERDICTS

#: Lists of at most so many entries become literals; longer ones are joined.
LITERAL_LIST = 1000


class Evaluator:
    id = "evaluator"

    def prepare(self, df: DataFrame, tag: str) -> DataFrame:
        return df

    def result(self, tag: str) -> Column:
        raise NotImplementedError


def group_key(group_by: str, key: str = "") -> Column:
    """entity, tenant or the first tag with a key ('' where there is none)."""
    return {"entity": lambda: F.col("entity_id"), "tenant": lambda: F.col("tenant_id"), "tag": lambda: event_tag(F.col("tags"), key)}[group_by]()


class AllowDeny(Evaluator):
    """Allowed: pass, allow_list_match; else denied: block, deny_list_match; else the default verdict.

    Lists are iterables or DataFrames with a column `value`. A DataFrame is joined as an existence join
    whose strategy the optimizer picks from its size."""

    id = "allow_deny"

    def __init__(self, allow=(), deny=(), match: str = "entity", default: int = PASS):
        self.allow, self.deny = (x if isinstance(x, DataFrame) else tuple(dict.fromkeys(x)) for x in (allow, deny))
        self.match, self.default = match, default

    def _value(self) -> Column:
        return F.col("tenant_id" if self.match == "tenant" else "entity_id")

    def prepare(self, df: DataFrame, tag: str) -> DataFrame:
        for name, own in (("allow", self.allow), ("deny", self.deny)):
            flag = f"{tag}_{name}"
            if not isinstance(own, DataFrame) and len(own) <= LITERAL_LIST:
                df = df.withColumn(flag, F.coalesce(self._value().isin(*own), F.lit(False)) if own else F.lit(False))
                continue
            if not isinstance(own, DataFrame):
                own = df.sparkSession.createDataFrame([(x,) for x in own], "value string")
            side = own.select(F.col("value").alias(f"{tag}_value")).filter(F.col(f"{tag}_value").isNotNull()).distinct().withColumn(flag, F.lit(True))
            df = df.join(side, self._value() == F.col(f"{tag}_value"), "left").drop(f"{tag}_value").withColumn(flag, F.coalesce(flag, F.lit(False)))
        return df

    def result(self, tag: str) -> Column:
        allow, deny = F.col(f"{tag}_allow"), F.col(f"{tag}_deny")
        return result(self.id, F.when(allow, PASS).when(deny, BLOCK).otherwise(self.default), F.when(allow, "allow_list_match").when(deny, "deny_list_match").otherwise("default"))


@dataclass
class Threshold(Evaluator):
    """Flags an event once its tumbling window's running aggregate is above the threshold.

    aggregation: count, sum (of the number in tag `value_tag` or of the column `value_column`), distinct
    (of the same); stub counts whatever the aggregation. The window is of event time, per tenant and
    group key; events of one window are taken in the order of (timestamp, event_id). prior is a
    snapshot of window state whose aggregates the counters go on from; for distinct, seen has the values
    (tenant_id, entity_id, window_name, epoch, value) that those aggregates have counted."""

    threshold: float = 100.0
    window_ms: int = 60_000
    aggregation: str = "count"
    group_by: str = "entity"
    tag: str = ""
    value_tag: str | None = None
    value_column: str | None = None
    window_name: str = "default"
    prior: DataFrame | None = None
    stub: bool = False
    seen: DataFrame | None = None
    id = "threshold_evaluator"

    def _value(self) -> Column:
        if self.value_column:
            return F.col(self.value_column)
        return number_of(event_tag(F.col("tags"), self.value_tag or ""))

    def running(self, key: Column, epoch: Column) -> Column:
        """The aggregate up to and with each event, as a window expression."""
        own = W.partitionBy("tenant_id", key, epoch)
        upto = own.orderBy("timestamp", "event_id").rowsBetween(W.unboundedPreceding, 0)
        if self.aggregation == "count" or self.stub:
            return F.count(F.lit(1)).over(upto).cast("double")
        if self.aggregation == "sum":
            return F.coalesce(F.sum(self._value().cast("double")).over(upto), F.lit(0.0))
        if self.aggregation != "distinct":
            raise EvaluatorError("InternalError", f"unknown aggregation {self.aggregation}")
        raise AssertionError("distinct takes two steps")

    def prepare(self, df: DataFrame, tag: str) -> DataFrame:
        key, epoch = f"{tag}_key", f"{tag}_epoch"
        df = df.withColumn(key, group_key(self.group_by, self.tag)).withColumn(epoch, epoch_of(F.col("timestamp"), self.window_ms))
        if self.aggregation == "distinct" and not self.stub:
            # a value counts where it occurs first in its window; null values don't count
            value = f"{tag}_value"
            df = df.withColumn(value, (F.col(self.value_column) if self.value_column else event_tag(F.col("tags"), self.value_tag or "")).cast("string"))
            first = F.row_number().over(W.partitionBy("tenant_id", key, epoch, value).orderBy("timestamp", "event_id")) == 1
            df = df.withColumn(f"{tag}_new", (first & F.col(value).isNotNull()).cast("int"))
            if self.seen is not None:
                old = self.seen.filter(F.col("window_name") == self.window_name).select(F.col("tenant_id").alias(f"{tag}_t"), F.col("entity_id").alias(f"{tag}_e"), F.col("epoch").alias(f"{tag}_p"), F.col("value").alias(f"{tag}_v"))
                on = (F.col("tenant_id") == F.col(f"{tag}_t")) & (F.col(key) == F.col(f"{tag}_e")) & (F.col(epoch) == F.col(f"{tag}_p")) & (F.col(value) == F.col(f"{tag}_v"))
                df = df.join(old, on, "left").withColumn(f"{tag}_new", F.when(F.col(f"{tag}_v").isNull(), F.col(f"{tag}_new")).otherwise(0)).drop(f"{tag}_t", f"{tag}_e", f"{tag}_p", f"{tag}_v")
            upto = W.partitionBy("tenant_id", key, epoch).orderBy("timestamp", "event_id").rowsBetween(W.unboundedPreceding, 0)
            df = df.withColumn(f"{tag}_n", F.sum(f"{tag}_new").over(upto).cast("double"))
        else:
            df = df.withColumn(f"{tag}_n", self.running(F.col(key), F.col(epoch)))
        if self.prior is not None:
            before = self.prior.filter(F.col("window_name") == self.window_name).select(F.col("tenant_id").alias(f"{tag}_t"), F.col("entity_id").alias(f"{tag}_e"), F.col("epoch").alias(f"{tag}_p"), F.col("aggregate").alias(f"{tag}_before"))
            on = (F.col("tenant_id") == F.col(f"{tag}_t")) & (F.col(key) == F.col(f"{tag}_e")) & (F.col(epoch) == F.col(f"{tag}_p"))
            df = df.join(before, on, "left").withColumn(f"{tag}_n", F.col(f"{tag}_n") + F.coalesce(f"{tag}_before", F.lit(0.0))).drop(f"{tag}_t", f"{tag}_e", f"{tag}_p", f"{tag}_before")
        return df

    def result(self, tag: str) -> Column:
        n, over = F.col(f"{tag}_n"), F.col(f"{tag}_n") > F.lit(float(self.threshold))
        said = F.to_json(F.struct(n.cast("long").alias("window_count"), F.lit(float(self.threshold)).alias("threshold"), F.lit(self.window_name).alias("window_name")))
        return result(self.id, F.when(over, FLAG).otherwise(PASS), F.when(over, "threshold_exceeded"), metadata=F.when(over, said))

    def values(self, df: DataFrame) -> DataFrame:
        """For distinct: the values of each window, those seen before too."""
        value = (F.col(self.value_column) if self.value_column else event_tag(F.col("tags"), self.value_tag or "")).cast("string")
        own = df.select("tenant_id", group_key(self.group_by, self.tag).alias("entity_id"), F.lit(self.window_name).alias("window_name"), epoch_of(F.col("timestamp"), self.window_ms).alias("epoch"), value.alias("value")).filter("value is not null")
        return (own if self.seen is None else own.unionByName(self.seen)).distinct()

    def totals(self, df: DataFrame) -> DataFrame:
        """The window state that these events leave: one row a window, aggregate and version."""
        key, epoch = group_key(self.group_by, self.tag), epoch_of(F.col("timestamp"), self.window_ms)
        agg = F.count(F.lit(1)).cast("double")
        if not self.stub and self.aggregation == "sum":
            agg = F.coalesce(F.sum(self._value().cast("double")), F.lit(0.0))
        elif not self.stub and self.aggregation == "distinct":
            agg = F.count_distinct((F.col(self.value_column) if self.value_column else event_tag(F.col("tags"), self.value_tag or "")).cast("string")).cast("double")
        return df.groupBy("tenant_id", key.alias("entity_id"), F.lit(self.window_name).alias("window_name"), epoch.alias("epoch")).agg(agg.alias("aggregate"), F.count(F.lit(1)).alias("version"))


@dataclass
class Historical(Evaluator):
    """Flags an entity whose windows of the last num_windows epochs up to as_of sum to the threshold.

    state is a window-state DataFrame; one sum a key is joined to the events."""

    state: DataFrame
    as_of: Column
    window_name: str = "default"
    window_ms: int = 60_000
    num_windows: int = 10
    threshold: float = 100.0
    id = "WindowedHistoricalEvaluator"

    def prepare(self, df: DataFrame, tag: str) -> DataFrame:
        now = epoch_of(self.as_of, self.window_ms)
        first = F.when(now >= self.num_windows, now - self.num_windows + 1).otherwise(F.lit(0))
        sums = self.state.filter((F.col("window_name") == self.window_name) & (F.col("epoch") >= first) & (F.col("epoch") <= now))
        sums = sums.groupBy(F.col("tenant_id").alias(f"{tag}_t"), F.col("entity_id").alias(f"{tag}_e")).agg(F.sum("aggregate").alias(f"{tag}_sum"))
        return df.join(sums, (F.col("tenant_id") == F.col(f"{tag}_t")) & (F.col("entity_id") == F.col(f"{tag}_e")), "left").drop(f"{tag}_t", f"{tag}_e")

    def result(self, tag: str) -> Column:
        return result(self.id, F.when(F.coalesce(f"{tag}_sum", F.lit(0.0)) >= float(self.threshold), FLAG).otherwise(PASS))


class ColumnEvaluator(Evaluator):
    """A verdict from any Column; the reason is given where it isn't pass."""

    def __init__(self, id: str, verdict: Column, reason: str | Column | None = None, score: Column | None = None, error: Column | None = None, skipped: Column | bool = False):
        self.id, self._verdict, self._reason, self._score, self._error, self._skipped = id, verdict, reason, score, error, skipped

    def result(self, tag: str) -> Column:
        reason = self._reason if not isinstance(self._reason, str) else F.when(self._verdict != PASS, self._reason)
        return result(self.id, F.coalesce(self._verdict, F.lit(PASS)), reason, self._score, self._skipped, error=self._error)


class PythonEvaluator(Evaluator):
    """fn(event as a dict) -> verdict, (verdict, reason) or a dict of result fields; faults become errors.

    Rows come in Arrow batches; only `columns` are sent to Python."""

    def __init__(self, id: str, fn: Callable[[dict], object], columns: tuple[str, ...] = ("event_id", "tenant_id", "entity_id", "event_type", "tags"), timeout_ms: float | None = None):
        self.id, self.fn, self.columns, self.timeout_ms = id, fn, columns, timeout_ms

    def result(self, tag: str) -> Column:
        fn, limit = self.fn, self.timeout_ms

        @F.pandas_udf("verdict int, reason string, score float, metadata string, error string")
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            for row in rows.to_dict("records"):
                began = time.monotonic()
                try:
                    x = fn(row)
                    x = x if isinstance(x, dict) else {"verdict": x[0], "reason": x[1]} if isinstance(x, tuple) else {"verdict": x}
                    error = None
                except Exception as e:  # an evaluator's fault is a result, see the stage's failure mode
                    x, error = {}, "timeout" if isinstance(e, TimeoutError) else "internal"
                if limit is not None and (time.monotonic() - began) * 1000 > limit:
                    error = "timeout"
                out.append((int(x.get("verdict") or 0), x.get("reason"), x.get("score"), x.get("metadata"), error))
            return pd.DataFrame(out, columns=["verdict", "reason", "score", "metadata", "error"])

        r = run(F.struct(*self.columns))
        return result(self.id, r["verdict"], r["reason"], r["score"], metadata=r["metadata"], error=r["error"])


class Scorer(Evaluator):
    """A model's score: a Column, or score(batch of columns as a DataFrame) -> Series of numbers.

    load() runs once a worker task and gives the batch function, so a model is loaded once. A batch that
    fails gives the error internal, one that takes over timeout_ms the error timeout."""

    def __init__(self, id: str, score: Column | None = None, load: Callable[[], Callable[[pd.DataFrame], pd.Series]] | None = None, columns: tuple[str, ...] = (), flag_above: float | None = None, timeout_ms: float | None = None):
        self.id, self._score, self._load, self.columns, self.flag_above, self.timeout_ms = id, score, load, columns, flag_above, timeout_ms

    def _scored(self) -> tuple[Column, Column | None]:
        if self._score is not None:
            return self._score.cast("float"), None
        load, limit = self._load, self.timeout_ms
        @F.pandas_udf("score float, error string")
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            try:
                model = load()
            except Exception:
                model = None
            for rows in batches:
                began = time.monotonic()
                try:
                    s = pd.Series(model(rows)).astype("float32").reset_index(drop=True)
                    late = limit is not None and (time.monotonic() - began) * 1000 > limit
                    yield pd.DataFrame({"score": None if late else s, "error": "timeout" if late else None}, index=range(len(rows)))
                except Exception:
                    yield pd.DataFrame({"score": None, "error": "internal"}, index=range(len(rows)))

        r = run(F.struct(*self.columns))
        return r["score"], r["error"]

    def prepare(self, df: DataFrame, tag: str) -> DataFrame:
        score, error = self._scored()
        return df.withColumn(f"{tag}_score", score).withColumn(f"{tag}_error", F.lit(None).cast("string") if error is None else error)

    def result(self, tag: str) -> Column:
        s = F.col(f"{tag}_score")
        verdict = F.lit(PASS) if self.flag_above is None else F.when(s > F.lit(self.flag_above).cast("float"), FLAG).otherwise(PASS)
        return result(self.id, verdict, score=s, error=F.col(f"{tag}_error"))


def onnx(model_path: str, extract: Callable[[pd.DataFrame], object], columns: tuple[str, ...], id: str = "onnx") -> Scorer:
    """A scorer over onnxruntime: extract gives the input array, the first column of the first output
    is the score."""

    def load():
        import onnxruntime

        s = onnxruntime.InferenceSession(model_path)
        name = s.get_inputs()[0].name
        return lambda rows: pd.Series([float(x[0]) for x in s.run(None, {name: extract(rows)})[0]])

    return Scorer(id, load=load, columns=columns)


#: The plugin interface's version; a module's ABI_VERSION must equal it.
ABI_VERSION = 1


def plugin(module: str, config: dict | None = None) -> Evaluator:
    """An evaluator from module.create_evaluator(config); its faults say what is missing."""
    try:
        m = importlib.import_module(module)
    except ImportError as e:
        raise EvaluatorError("EvaluatorLoadFailed", f"{module} cannot be imported: {e}") from e
    if not hasattr(m, "create_evaluator"):
        raise EvaluatorError("EvaluatorLoadFailed", f"{module} has no create_evaluator")
    if getattr(m, "ABI_VERSION", None) != ABI_VERSION:
        raise EvaluatorError("EvaluatorLoadFailed", f"{module} is for version {getattr(m, 'ABI_VERSION', None)}, not {ABI_VERSION}")
    return m.create_evaluator(config or {})


def _allow_deny(c: dict) -> AllowDeny:
    from ..sources.lists import read_list

    side = lambda name: c.get(name) or (read_list(c[f"{name}_source"]) if c.get(f"{name}_source") else ())
    allow = side("allow") or (read_list(c["list_source"]) if c.get("list_source") else ())
    return AllowDeny(allow, side("deny"), c.get("match", "entity_id").removesuffix("_id"), VERDICTS.index(c.get("default", "pass")))


def _threshold(c: dict) -> Threshold:
    group = c.get("group_by", "entity_id")
    by, _, tag = group.partition(":")
    return Threshold(c.get("threshold", 100.0), c.get("window_duration_ms", 60_000), {"distinct_count": "distinct"}.get(c.get("aggregation"), c.get("aggregation", "count")), by.removesuffix("_id"), tag, c.get("value_tag"), window_name=c.get("window_name", "default"))


JSON_EVALUATORS: dict[str, Callable[[dict], Evaluator]] = {
    "allow_deny": _allow_deny,
    "threshold": _threshold,
    "plugin": lambda c: plugin(c["module"], c.get("config")),
    "tag_score": lambda c: Scorer(c.get("id", "tag_score"), (number_of(event_tag(F.col("tags"), c["tag"])) / F.lit(float(c.get("scale", 1.0))))),
}
