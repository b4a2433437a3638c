"""A declared pipeline compiled to one DataFrame transformation, batch or micro-batch."""

from __future__ import annotations

import dataclasses
import threading
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PipelineError, SyncSubmitError
from ..functions import first_tag
from ..operators import ratelimit, stages
from ..operators.evaluators import Threshold
from ..schema import DECISION, EVENT, INGEST_VALIDATION_FAILED, WINDOW_KEY, WINDOW_STATE
from ..session import scratch_dir
from ..sources.state import Versions
from .config import PipelineConfig
from .rules import Scope, TagContains, TagIn, TagStartsWith, TagValueBetween, TagValueGreaterThan, TagValueLessThan

_FIRST_TAG = (TagContains, TagIn, TagStartsWith, TagValueBetween, TagValueGreaterThan, TagValueLessThan)


@dataclass
class Outcome:
    decisions: DataFrame
    rejected: DataFrame  # admitted events have a decision each, rejected ones none


def compile(config: PipelineConfig, as_of: Column | None = None) -> Callable[[DataFrame], DataFrame]:
    """events -> decisions: a chain of projections, plus what the evaluators need (a window exchange for
    a counter, a join for a long list). One row in, one row out."""
    now = F.current_timestamp() if as_of is None else as_of

    def run(events: DataFrame) -> DataFrame:
        df = events.withColumn("_as_of", now)
        now_ = F.col("_as_of")
        names = ["_s_ingest"]
        df = df.withColumn("_s_ingest", stages.ingest_stage(config.ingest, now_))
        if config.evaluation:
            df, out = stages.eval_stage(df, config.evaluation)
            df = df.withColumn("_s_eval", out)
            names.append("_s_eval")
        if config.inference:
            df, out = stages.inference_stage(df, config.inference)
            df = df.withColumn("_s_inference", out)
            names.append("_s_inference")
        active = F.array().cast("array<struct<decision_type_id:string,rule_id:string,priority:int>>")
        if config.policy:
            keys = sorted({n.key for r in config.policy.rules for n in r.rule.walk() if isinstance(n, _FIRST_TAG)})
            # each tag that rules look at is looked up once
            df = df.withColumns({f"_tag{i}": first_tag(F.col("tags"), k) for i, k in enumerate(keys)} | {"_results": F.flatten(F.array(*[F.col(n)["evaluator_results"] for n in names]))})
            own = {n.removeprefix("_s_"): F.col(n) for n in names}
            scope = Scope(as_of=now_, results=F.col("_results"), verdicts={k: s["verdict"] for k, s in own.items()}, degraded={k: s["degraded_reason"] for k, s in own.items()}, tag_columns={k: F.col(f"_tag{i}") for i, k in enumerate(keys)})
            df, out, active = stages.policy_stage(df, config.policy, config.decision_types, scope)
            df = df.withColumn("_s_policy", out)
            names.append("_s_policy")
        outs = [F.col(n) for n in names]
        return df.select(
            F.lit(config.pipeline_id).alias("pipeline_id"), F.lit(config.version).alias("pipeline_version"), "event_id", "tenant_id", "entity_id", now_.alias("decided_at"), F.array(*outs).alias("stage_outputs"),
            stages.final_verdict(outs).alias("final_verdict"), stages.merged_degraded(outs).alias("degraded_reason"), F.lit(None).cast("long").alias("elapsed_us"), active.alias("active_decisions"),
        )

    return run


def stage_of(decisions: DataFrame, stage_id: str) -> Column:
    """A decision's output of one stage; null if it didn't run."""
    return F.get(F.filter("stage_outputs", lambda s: s["stage_id"] == stage_id), F.lit(0))


class Counters:
    """The counters of a configuration's thresholds between micro-batches: a batch goes on from the tables that the
    one before it left, and leaves its own under its number."""

    SEEN = "tenant_id string, entity_id string, window_name string, epoch long, value string"

    def __init__(self, config: PipelineConfig, versions: Versions, retain_windows: int | None):
        self.config, self.versions, self.retain = config, versions, retain_windows

    def _evaluators(self):
        for stage in ("evaluation", "inference"):
            for i, e in enumerate(getattr(self.config, stage).evaluators if getattr(self.config, stage) else ()):
                if isinstance(e, Threshold):
                    yield stage, i, e

    def before(self, batch: int) -> PipelineConfig:
        """The configuration with counters as they were left before this batch."""
        config = self.config
        for stage, i, e in self._evaluators():
            prior = self.versions.read(f"{stage}-{i}", WINDOW_STATE, batch)
            seen = self.versions.read(f"{stage}-{i}-seen", self.SEEN, batch)
            own = dataclasses.replace(e, prior=e.prior if prior is None else prior, seen=e.seen if seen is None else seen)
            part = getattr(config, stage)
            config = dataclasses.replace(config, **{stage: dataclasses.replace(part, evaluators=[*part.evaluators[:i], own, *part.evaluators[i + 1 :]])})
        return config

    def leave(self, config: PipelineConfig, batch: int, events: DataFrame) -> None:
        """Write what the events leave, config being what before() gave. Windows that are more than retain_windows
        older than the newest one are dropped, where it is set."""
        for stage, i, _ in self._evaluators():
            e = getattr(config, stage).evaluators[i]
            if e.aggregation == "distinct" and not e.stub:
                seen = e.values(events)
                self.versions.write(f"{stage}-{i}-seen", self._kept(seen), batch)
                seen = self.versions.read(f"{stage}-{i}-seen", self.SEEN, batch + 1)
                state = seen.groupBy(*WINDOW_KEY).agg(F.count(F.lit(1)).cast("double").alias("aggregate"), F.count(F.lit(1)).alias("version"))
            else:
                state = e.totals(events)
                if e.prior is not None:
                    state = state.unionByName(e.prior.filter(F.col("window_name") == e.window_name)).groupBy(*WINDOW_KEY).agg(F.sum("aggregate").alias("aggregate"), F.sum("version").alias("version"))
                state = self._kept(state)
            self.versions.write(f"{stage}-{i}", state.select(*[f.name for f in WINDOW_STATE.fields]), batch)

    def _kept(self, df: DataFrame) -> DataFrame:
        if self.retain is None:
            return df
        newest = df.agg(F.max("epoch").alias("_newest"))
        return df.join(F.broadcast(newest), F.col("epoch") >= F.col("_newest") - self.retain).drop("_newest")  # one row


class Pipeline:
    """A pipeline with the life cycle stopped -> running -> draining -> stopped, restartable. Buckets are full when it is
    made and last as long as it does, over submitted batches and single events alike."""

    def __init__(self, config: PipelineConfig, as_of: Column | None = None):
        self.config, self.as_of, self.state = config.build(), as_of, "stopped"
        self.dropped = 0
        self._started = False
        self._queries: list = []
        self._lock = threading.RLock()
        self._levels: DataFrame | None = None  # what batches left in the buckets
        self._own: dict[str | None, tuple[int, int | None]] = {}  # what single events left since
        self._busy: Counter = Counter()

    def start(self) -> Pipeline:
        if self.state != "stopped":
            raise PipelineError("AlreadyRunning")
        self.state, self._started = "running", True
        return self

    def _running(self) -> None:
        if self.state != "running":
            raise PipelineError("PipelineUnavailable" if self._started else "NotStarted")

    def _buckets(self, spark: SparkSession) -> DataFrame | None:
        if not self._own:
            return self._levels
        own = spark.createDataFrame([(t, *x) for t, x in self._own.items()], ratelimit.LEVELS)
        if self._levels is None:
            return own
        return self._levels.join(own.select(F.col("tenant_id").alias("_t")), F.col("tenant_id").eqNullSafe(F.col("_t")), "left_anti").unionByName(own)

    def admitted(self, events: DataFrame, levels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        c = self.config.rate_limit
        if c is None:
            return events, events.limit(0)
        marked = ratelimit.admit(events, c.capacity, c.per_second, c.refill, levels)
        return marked.filter("admitted").drop("admitted"), marked.filter("not admitted").drop("admitted")

    def run(self, events: DataFrame) -> Outcome:
        """Lazy: decisions of the events that the buckets admit now, and the rejected ones; no token is taken."""
        self._running()
        yes, no = self.admitted(events, self._buckets(events.sparkSession))
        return Outcome(compile(self.config, self.as_of)(yes), no)

    def submit(self, events: DataFrame) -> Outcome:
        """run, emit the decisions to all targets, and take the tokens."""
        from ..sinks.fanout import emit

        with self._lock:
            out = self.run(events)
            self.dropped += emit(out.decisions, self.config.emit)
            if c := self.config.rate_limit:
                spark = events.sparkSession
                path = scratch_dir(spark, "buckets")
                ratelimit.after(events, c.capacity, c.per_second, c.refill, self._buckets(spark)).write.parquet(path)
                self._levels, self._own = spark.read.schema(ratelimit.LEVELS).parquet(path), {}
        return out

    def _take(self, event: dict) -> bool:
        """A token of the event's tenant."""
        c, tenant = self.config.rate_limit, event.get("tenant_id")
        if c is None:
            return True
        with self._lock:
            level, last = self._own.get(tenant) or (c.capacity * ratelimit.TOKEN, None)
            if tenant not in self._own and self._levels is not None and (row := self._levels.filter(F.col("tenant_id").eqNullSafe(F.lit(tenant))).first()):
                level, last = row["level"], row["last"]
            if c.refill != "none":
                us = round(event["timestamp"].timestamp() * 1_000_000) if event.get("timestamp") else 0
                if last is not None and us > last:
                    level = min(c.capacity * ratelimit.TOKEN, level + (us - last) * int(c.per_second))
                last = us if last is None else max(us, last)
            yes = level >= ratelimit.TOKEN
            self._own[tenant] = (level - ratelimit.TOKEN * yes, last)
            return yes

    def evaluate_one(self, spark: SparkSession, event: dict, timeout_s: float | None = None, cancelled: threading.Event | None = None) -> dict:
        """One event's decision as a dict, within timeout_s (the latency budget is meant for engines that
        answer in milliseconds; a Spark job takes longer, so there is no default). RateLimited: the tenant has
        max_concurrent calls under way, or no token."""
        if self.state != "running":
            raise SyncSubmitError("PipelineUnavailable" if self._started else "NotStarted")
        if cancelled is not None and cancelled.is_set():
            raise SyncSubmitError("Cancelled")
        tenant, c = event.get("tenant_id"), self.config.rate_limit
        with self._lock:
            if c is not None and self._busy[tenant] >= c.max_concurrent:
                raise SyncSubmitError("RateLimited", "ConcurrencyCapReached")
            self._busy[tenant] += 1
        try:
            if not self._take(event):
                raise SyncSubmitError("RateLimited", "Exhausted")
            return self._decide_one(spark, event, timeout_s, cancelled)
        finally:
            with self._lock:
                self._busy[tenant] -= 1
                if not self._busy[tenant]:
                    del self._busy[tenant]

    def _decide_one(self, spark: SparkSession, event: dict, timeout_s: float | None, cancelled: threading.Event | None) -> dict:
        one = spark.createDataFrame([tuple(event.get(f.name) for f in EVENT.fields)], EVENT)
        group = f"verdictflow-{uuid.uuid4().hex}"
        box: dict = {}

        def job() -> None:
            try:
                spark.sparkContext.setJobGroup(group, "one event", interruptOnCancel=True)
                box["rows"] = compile(self.config, self.as_of)(one).collect()
            except Exception as e:  # handed to the caller's thread
                box["error"] = e

        from pyspark import InheritableThread

        t = InheritableThread(target=job)
        t.start()
        waited = 0.0
        while t.is_alive() and (timeout_s is None or waited < timeout_s) and not (cancelled is not None and cancelled.is_set()):
            t.join(0.05)
            waited += 0.05
        if t.is_alive():
            spark.sparkContext.cancelJobGroup(group)
            raise SyncSubmitError("Cancelled" if cancelled is not None and cancelled.is_set() else "Timeout")
        if "error" in box:
            raise box["error"]
        d = box["rows"][0].asDict(recursive=True)
        if d["degraded_reason"] & INGEST_VALIDATION_FAILED:
            raise SyncSubmitError("ValidationFailed")
        return d

    def stream(self, events: DataFrame, checkpoint: str, retain_windows: int | None = None, **trigger):
        """Start a streaming query that decides and emits each micro-batch. Counters and buckets go on from batch to
        batch and over restarts: a batch's state lies beside the checkpoint under its number, so a batch that runs again
        starts from what the one before it left, and targets with for_batch replace what it wrote. retain_windows bounds
        the state: windows so much older than the newest are forgotten."""
        from ..sinks.fanout import emit

        self._running()
        c = self.config.rate_limit

        def each(batch: DataFrame, number: int) -> None:
            versions = Versions(batch.sparkSession, f"{checkpoint}/verdictflow")
            counters = Counters(self.config, versions, retain_windows)
            batch = batch.persist()
            try:
                config, levels = counters.before(number), versions.read("buckets", ratelimit.LEVELS, number)
                yes, _ = self.admitted(batch, levels)
                targets = [t.for_batch(number) if hasattr(t, "for_batch") else t for t in config.emit.targets]
                self.dropped += emit(compile(config, self.as_of)(yes), dataclasses.replace(config.emit, targets=targets))
                counters.leave(config, number, yes)
                if c is not None:
                    versions.write("buckets", ratelimit.after(batch, c.capacity, c.per_second, c.refill, levels), number)
            finally:
                batch.unpersist()

        q = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(**(trigger or {"availableNow": True})).start()
        self._queries.append(q)
        return q

    def drain(self, timeout_s: float = 60.0) -> None:
        """Take no more events, let running queries finish what they have, stop."""
        if self.state != "running":
            raise PipelineError("PipelineUnavailable" if self._started else "NotStarted")
        self.state = "draining"
        late = False
        for q in self._queries:
            if q.isActive:
                if not q.awaitTermination(int(timeout_s)):
                    late = True
                q.stop()
        self._queries.clear()
        self.state = "stopped"
        if late:
            raise PipelineError("DrainTimeout")

    def status(self) -> dict:
        return {"state": self.state, "pipeline_id": self.config.pipeline_id, "degraded": False, "queries": [q.status for q in self._queries], "dropped_decisions": self.dropped}


def empty_decisions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DECISION)
