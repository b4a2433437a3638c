"""The engine's registered queries and, where SQL can express them, their DuckDB equivalents.

All run over the whole `events` table seen as events (see sources.events): ten tenants, a user an
entity, tags k and value. One day is the window, for a user has a handful of events a day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import epoch_of, event_tag, first_tag, number_of, verdict_name
from .operators import metrics, ratelimit, routing
from .operators.evaluators import AllowDeny, ColumnEvaluator, Historical, Scorer, Threshold
from .plans import rules as R
from .plans.config import FailureMode, PipelineConfig, Policy
from .plans.pipeline import Pipeline, compile, stage_of
from .plans.registry import DecisionTypes
from .schema import BLOCK, FLAG, PASS
from .sinks.formats import audit_lines, decision_json, decisions_from_json, stdout_lines
from .sinks.targets import Noop, ParquetFiles
from .session import scratch_dir
from .sources.events import as_events, events_from_table, orders_as_events, with_event_ids
from .sources.state import Snapshot, WriteBack, apply_changes, expire, merge_latest, range_sum
from .streaming.reports import session_counts, sliding_counts, tumbling_counts
from .streaming.stateful import running_counts

DAY = 86_400_000
AS_OF = "2024-01-31 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The events view in DuckDB; its epoch_ms rounds, so milliseconds come from microseconds.
EV = """e AS (SELECT event_id, 'tenant-' || (user_id % 10) AS tenant_id, 'user-' || user_id AS entity_id, event_type, ts, epoch_us(ts) AS us, epoch_us(ts) // 1000 // 86400000 AS day,
  props->>'$.k' AS k, CAST(value AS VARCHAR) AS v, value, user_id, TIMESTAMP '2024-01-31 00:00:00' AS now FROM events)"""


def _as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return events_from_table(spark, sf_dir)


def config(name: str = "q") -> PipelineConfig:
    return PipelineConfig(name).with_targets(Noop()).with_ingest(skew_ms=40 * DAY)


def decide(c: PipelineConfig, df: DataFrame) -> DataFrame:
    return compile(c.build(), _as_of())(df)


def short(d: DataFrame, *more: Column) -> DataFrame:
    return d.select("event_id", verdict_name(F.col("final_verdict")).alias("verdict"), *more)


def reason(d: DataFrame, stage: str) -> Column:
    return F.get(stage_of(d, stage)["evaluator_results"], F.lit(0))["reason_code"].alias("reason")


NAME = "CASE {} WHEN 2 THEN 'block' WHEN 1 THEN 'flag' ELSE 'pass' END"


# ingest ------------------------------------------------------------------------------------------
@register("ingest_validation", f"WITH {EV} SELECT event_id, 'pass' AS verdict, CAST(CASE WHEN event_id % 7 = 0 THEN 32 ELSE 0 END AS INTEGER) AS degraded, CASE WHEN event_id % 7 = 0 THEN 'invalid_event_fields' END AS reason FROM e")
def ingest_validation(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("entity_id", F.when(F.col("event_id") % 14 == 0, "").when(F.col("event_id") % 7 != 0, F.col("entity_id")))
    d = decide(config(), df)
    return short(d, F.col("degraded_reason").alias("degraded"), reason(d, "ingest"))


@register("ingest_lateness", f"WITH {EV} SELECT event_id, CASE WHEN epoch_us(now) - us >= 1728000001000 THEN 'flag' ELSE 'pass' END AS verdict, CASE WHEN epoch_us(now) - us >= 1728000001000 THEN 'late_arrival' END AS reason FROM e")
def ingest_lateness(spark, sf_dir):
    d = decide(PipelineConfig("q").with_targets(Noop()).with_ingest(skew_ms=20 * DAY), events(spark, sf_dir))
    return short(d, reason(d, "ingest"))


@register("tag_lookup", f"WITH {EV} SELECT event_id, k, CAST(v AS DOUBLE) AS value, '' AS absent FROM e")
def tag_lookup(spark, sf_dir):
    t = F.col("tags")
    return events(spark, sf_dir).select("event_id", first_tag(t, "k").alias("k"), number_of(first_tag(t, "value")).alias("value"), event_tag(t, "nothing").alias("absent"))


@register("event_ids", "SELECT row_number() OVER (ORDER BY ts, 'tenant-' || (user_id % 10), 'user-' || user_id) AS event_id, 'user-' || user_id AS entity_id, epoch_us(ts) AS us FROM events")
def event_ids(spark, sf_dir):
    return with_event_ids(events(spark, sf_dir)).select("event_id", "entity_id", F.unix_micros("timestamp").alias("us"))


# lists -------------------------------------------------------------------------------------------
def _users(n: int, at: int) -> list[str]:
    return [f"user-{i}" for i in range(200) if i % n == at]


@register("allow_deny", f"WITH {EV} SELECT event_id, CASE WHEN user_id % 5 = 0 AND user_id < 200 THEN 'pass' WHEN user_id % 3 = 1 AND user_id < 200 THEN 'block' ELSE 'flag' END AS verdict, CASE WHEN user_id % 5 = 0 AND user_id < 200 THEN 'allow_list_match' WHEN user_id % 3 = 1 AND user_id < 200 THEN 'deny_list_match' ELSE 'default' END AS reason FROM e")
def allow_deny(spark, sf_dir):
    d = decide(config().with_evaluators(AllowDeny(_users(5, 0), _users(3, 1), default=FLAG)), events(spark, sf_dir))
    return short(d, reason(d, "eval"))


@register("allow_deny_joined", f"WITH {EV} SELECT event_id, CASE WHEN user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) THEN 'pass' WHEN user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey > 15) THEN 'block' ELSE 'flag' END AS verdict FROM e")
def allow_deny_joined(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("value"), "c_nationkey")
    return short(decide(config().with_evaluators(AllowDeny(names.filter("c_nationkey < 5"), names.filter("c_nationkey > 15"), default=FLAG)), events(spark, sf_dir)))


@register("allow_deny_tenant", f"WITH {EV} SELECT event_id, CASE WHEN tenant_id = 'tenant-1' THEN 'pass' WHEN tenant_id IN ('tenant-2', 'tenant-3') THEN 'block' ELSE 'pass' END AS verdict FROM e")
def allow_deny_tenant(spark, sf_dir):
    return short(decide(config().with_evaluators(AllowDeny(["tenant-1"], ["tenant-2", "tenant-3", "tenant-1"], match="tenant")), events(spark, sf_dir)))


# windows -----------------------------------------------------------------------------------------
def _running(agg: str, key: str, thr: float) -> str:
    return f"WITH {EV}, r AS (SELECT event_id, {agg} OVER (PARTITION BY tenant_id, {key}, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM e) SELECT event_id, CASE WHEN n > {thr} THEN 'flag' ELSE 'pass' END AS verdict, CASE WHEN n > {thr} THEN 'threshold_exceeded' END AS reason FROM r"


def _threshold(t: Threshold) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf_dir):
        d = decide(config().with_evaluators(t), events(spark, sf_dir))
        return short(d, reason(d, "eval"))

    return run


register("threshold_count", _running("count(*)", "entity_id", 3))(_threshold(Threshold(3, DAY)))
register("threshold_by_tenant", _running("count(*)", "1", 30))(_threshold(Threshold(30, DAY, group_by="tenant")))
register("threshold_by_tag", _running("count(*)", "k", 1))(_threshold(Threshold(1, DAY, group_by="tag", tag="k")))
register("threshold_sum", _running("sum(CAST(round(value * 100) AS BIGINT))", "entity_id", 20000.5))(lambda s, d: _cents(s, d))
register("threshold_distinct", _running("count(DISTINCT event_type)", "entity_id", 2))(_threshold(Threshold(2, DAY, "distinct", value_column="event_type")))
register("threshold_stub", _running("count(*)", "entity_id", 3))(_threshold(Threshold(3, DAY, "sum", value_tag="value", stub=True)))


def _cents(spark, sf_dir):
    """Sums of whole cents, so that the order of additions cannot matter."""
    df = events(spark, sf_dir).withColumn("cents", F.round(number_of(first_tag(F.col("tags"), "value")) * 100).cast("long"))
    d = decide(config().with_evaluators(Threshold(20000.5, DAY, "sum", value_column="cents")), df)
    return short(d, reason(d, "eval"))


@register("threshold_metadata", f"WITH {EV}, r AS (SELECT event_id, count(*) OVER (PARTITION BY tenant_id, entity_id, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM e) SELECT event_id, n AS window_count, 'daily' AS window_name FROM r WHERE n > 3")
def threshold_metadata(spark, sf_dir):
    d = decide(config().with_evaluators(Threshold(3, DAY, window_name="daily")), events(spark, sf_dir)).filter(F.col("final_verdict") == FLAG)
    m = F.from_json(F.get(stage_of(d, "eval")["evaluator_results"], F.lit(0))["metadata"], "window_count long, threshold double, window_name string")
    return d.select("event_id", m["window_count"].alias("window_count"), m["window_name"].alias("window_name"))


@register("threshold_carry_over", f"WITH {EV}, r AS (SELECT event_id, day, count(*) OVER (PARTITION BY tenant_id, entity_id, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + CASE WHEN day % 2 = 0 THEN 2 ELSE 0 END AS n FROM e) SELECT event_id, CASE WHEN n > 3 THEN 'flag' ELSE 'pass' END AS verdict FROM r")
def threshold_carry_over(spark, sf_dir):
    df = events(spark, sf_dir)
    prior = Threshold(3, DAY).totals(df).filter("epoch % 2 = 0").withColumn("aggregate", F.lit(2.0))
    return short(decide(config().with_evaluators(Threshold(3, DAY, prior=prior)), df))


WS = "ws AS (SELECT tenant_id, entity_id, day AS epoch, CAST(count(*) AS DOUBLE) AS aggregate, count(*) AS version FROM e GROUP BY ALL)"


@register("window_totals", f"WITH {EV}, {WS} SELECT tenant_id, entity_id, 'default' AS window_name, epoch, aggregate, version FROM ws")
def window_totals(spark, sf_dir):
    return Threshold(3, DAY).totals(events(spark, sf_dir))


@register("window_distinct_totals", f"WITH {EV} SELECT tenant_id, entity_id, day AS epoch, CAST(count(DISTINCT event_type) AS DOUBLE) AS aggregate FROM e GROUP BY ALL")
def window_distinct_totals(spark, sf_dir):
    return Threshold(3, DAY, "distinct", value_column="event_type").totals(events(spark, sf_dir)).select("tenant_id", "entity_id", "epoch", "aggregate")


@register("range_sum", f"WITH {EV}, {WS} SELECT tenant_id, entity_id, sum(aggregate) AS total FROM ws WHERE epoch BETWEEN 19730 AND 19740 GROUP BY ALL")
def range_sums(spark, sf_dir):
    return range_sum(window_totals(spark, sf_dir), 19730, 19740, "tenant_id", "entity_id")


@register("historical_threshold", f"WITH {EV}, {WS}, s AS (SELECT tenant_id, entity_id, sum(aggregate) AS t FROM ws WHERE epoch BETWEEN 19753 - 9 AND 19753 GROUP BY ALL) SELECT event_id, CASE WHEN coalesce(t, 0) >= 25 THEN 'flag' ELSE 'pass' END AS verdict FROM e LEFT JOIN s USING (tenant_id, entity_id)")
def historical_threshold(spark, sf_dir):
    h = Historical(window_totals(spark, sf_dir), _as_of(), window_ms=DAY, num_windows=10, threshold=25)
    return short(decide(config().with_evaluators(h), events(spark, sf_dir)))


@register("trailing_sum", f"WITH {EV}, {WS} SELECT tenant_id, entity_id, epoch, sum(aggregate) OVER (PARTITION BY tenant_id, entity_id ORDER BY epoch RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS week FROM ws")
def trailing_sum(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("tenant_id", "entity_id").orderBy("epoch").rangeBetween(-6, 0)
    return window_totals(spark, sf_dir).select("tenant_id", "entity_id", "epoch", F.sum("aggregate").over(w).alias("week"))


@register("tumbling_counts", f"WITH {EV} SELECT tenant_id, epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS start_us, count(*) AS events FROM e GROUP BY ALL")
def tumbling(spark, sf_dir):
    return tumbling_counts(events(spark, sf_dir), "6 hours", "tenant_id").select("tenant_id", F.unix_micros("start").alias("start_us"), "events")


@register("sliding_counts", f"WITH {EV}, x AS (SELECT tenant_id, us // 21600000000 * 21600000000 - o * 21600000000 AS start_us FROM e, range(4) t(o)) SELECT tenant_id, start_us, count(*) AS events FROM x GROUP BY ALL")
def sliding(spark, sf_dir):
    return sliding_counts(events(spark, sf_dir), "1 day", "6 hours", "tenant_id").select("tenant_id", F.unix_micros("start").alias("start_us"), "events")


@register("session_counts", f"WITH {EV}, g AS (SELECT *, CASE WHEN us - lag(us) OVER w < 14400000000 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY entity_id ORDER BY us, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY entity_id ORDER BY us, event_id) AS n FROM g) SELECT entity_id, min(us) AS start_us, max(us) + 14400000000 AS end_us, count(*) AS events FROM s GROUP BY entity_id, n")
def sessions(spark, sf_dir):
    return session_counts(events(spark, sf_dir), "4 hours", "entity_id").select("entity_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


# composition -------------------------------------------------------------------------------------
VOTES = "v AS (SELECT event_id, CAST(event_id % 3 AS INTEGER) AS a, CAST(event_id // 3 % 3 AS INTEGER) AS b, CAST(event_id // 9 % 3 AS INTEGER) AS c FROM e)"


def _votes() -> list[ColumnEvaluator]:
    i = F.col("event_id")
    return [ColumnEvaluator(n, F.floor(i / 3**p).cast("int") % 3, "voted") for p, n in enumerate("abc")]


for _rule, _sql in (
    ("any_block", "greatest(a, b, c)"),
    ("any_flag", "greatest(a, b, c)"),
    ("unanimous", "CASE WHEN least(a, b, c) = 2 THEN 2 ELSE 0 END"),
    ("majority", "CASE WHEN 2 * ((a = 2)::INT + (b = 2)::INT + (c = 2)::INT) > 3 THEN 2 ELSE 0 END"),
):
    register(f"compose_{_rule}", f"WITH {EV}, {VOTES} SELECT event_id, {NAME.format(_sql)} AS verdict FROM v")(lambda s, d, r=_rule: short(decide(config().with_evaluators(*_votes(), composition=r), events(s, d))))


@register("compose_weighted_score", f"WITH {EV}, {VOTES} SELECT event_id, CASE WHEN CAST(CAST(a AS REAL) / 2 + CAST(b AS REAL) / 2 AS REAL) / 2 > 0.5 THEN 'flag' ELSE 'pass' END AS verdict FROM v")
def compose_weighted_score(spark, sf_dir):
    """The mean of two scores, whatever the scorers' own verdicts; a third has none."""
    i = F.col("event_id")
    votes = [Scorer(n, ((F.floor(i / 3**p).cast("int") % 3) / 2).cast("float") if n < "c" else F.lit(None).cast("float"), flag_above=0.1) for p, n in enumerate("abc")]
    return short(decide(config().with_inference(*votes, composition="weighted_score", score_threshold=0.5), events(spark, sf_dir)))


def _scorers() -> list:
    value = number_of(first_tag(F.col("tags"), "value"))
    return [Scorer("model_a", (value / 500).cast("float")), Scorer("model_b", F.when(F.col("event_id") % 4 != 0, ((F.col("event_id") % 100) / 100).cast("float"))), Scorer("model_c", F.lit(None).cast("float"))]


SCORES = "sc AS (SELECT event_id, CAST(value / 500 AS REAL) AS a, CASE WHEN event_id % 4 <> 0 THEN CAST((event_id % 100) / 100 AS REAL) END AS b FROM e)"


@register("inference_mean_score", f"WITH {EV}, {SCORES} SELECT event_id, CASE WHEN CASE WHEN b IS NULL THEN a ELSE CAST(CAST(a + b AS REAL) / CAST(2 AS REAL) AS REAL) END > CAST(0.3 AS REAL) THEN 'flag' ELSE 'pass' END AS verdict FROM sc")
def inference_mean_score(spark, sf_dir):
    return short(decide(config().with_inference(*_scorers(), score_threshold=0.3), events(spark, sf_dir)))


@register("inference_max", f"WITH {EV}, {SCORES} SELECT event_id, CASE WHEN a > CAST(0.2 AS REAL) OR coalesce(b > CAST(0.9 AS REAL), false) THEN 'flag' ELSE 'pass' END AS verdict FROM sc")
def inference_max(spark, sf_dir):
    value = number_of(first_tag(F.col("tags"), "value"))
    scorers = [Scorer("model_a", (value / 500).cast("float"), flag_above=0.2), Scorer("model_b", F.when(F.col("event_id") % 4 != 0, ((F.col("event_id") % 100) / 100).cast("float")), flag_above=0.9)]
    return short(decide(config().with_inference(*scorers, composition="any_block"), events(spark, sf_dir)))


@register("scorer_batches", f"WITH {EV} SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'flag' ELSE 'pass' END AS verdict FROM e")
def scorer_batches(spark, sf_dir):
    """A model in Python: loaded once a task, scored by Arrow batches."""
    s = Scorer("model", load=lambda: lambda rows: (rows["event_id"] % 11 == 0) * 0.9, columns=("event_id",))
    return short(decide(config().with_inference(s, score_threshold=0.5), events(spark, sf_dir)))


for _mode, _verdict, _reason in ((FailureMode.FAIL_OPEN, "pass", "fail_open"), (FailureMode.FAIL_CLOSED, "block", "fail_closed"), (FailureMode.EMIT_DEGRADED, "pass", "degraded")):

    def _failing(spark, sf_dir, mode=_mode):
        bad = ColumnEvaluator("shaky", F.lit(FLAG), "seen", error=F.when(F.col("event_id") % 5 == 0, "internal"))
        d = decide(config().with_evaluators(ColumnEvaluator("steady", F.lit(PASS)), bad, failure_mode=mode), events(spark, sf_dir))
        r = F.get(stage_of(d, "eval")["evaluator_results"], F.lit(1))
        return short(d, r["evaluator_id"].alias("evaluator_id"), r["reason_code"].alias("reason"), r["skipped"].alias("skipped"), F.col("degraded_reason").alias("degraded"))

    register(f"failure_{_mode.value}", f"WITH {EV} SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '{_verdict}' ELSE 'flag' END AS verdict, CASE WHEN event_id % 5 = 0 THEN 'evaluator_1' ELSE 'shaky' END AS evaluator_id, CASE WHEN event_id % 5 = 0 THEN '{_reason}' ELSE 'seen' END AS reason, event_id % 5 = 0 AS skipped, CAST(CASE WHEN event_id % 5 = 0 THEN 2 ELSE 0 END AS INTEGER) AS degraded FROM e")(_failing)


@register("inference_timeout", f"WITH {EV} SELECT event_id, 'pass' AS verdict, CAST(CASE WHEN event_id % 6 = 0 THEN 1 WHEN event_id % 6 = 1 THEN 2 ELSE 0 END AS INTEGER) AS degraded, CASE WHEN event_id % 6 < 2 THEN 'inference_evaluator_0' ELSE 'slow_model' END AS evaluator_id FROM e")
def inference_timeout(spark, sf_dir):
    slow = ColumnEvaluator("slow_model", F.lit(PASS), score=F.lit(0.1), error=F.when(F.col("event_id") % 6 == 0, "timeout").when(F.col("event_id") % 6 == 1, "internal"))
    d = decide(config().with_inference(slow), events(spark, sf_dir))
    return short(d, F.col("degraded_reason").alias("degraded"), F.get(stage_of(d, "inference")["evaluator_results"], F.lit(0))["evaluator_id"].alias("evaluator_id"))


# rules -------------------------------------------------------------------------------------------
#: What every rule query decides about: one flagging evaluator, one scorer, a failing one.
def _subject() -> PipelineConfig:
    flag = ColumnEvaluator("watch", F.when(F.col("event_type") == "error", FLAG).otherwise(PASS), "error_event")
    odd = ColumnEvaluator("odd", F.lit(PASS), error=F.when(F.col("event_id") % 9 == 0, "internal"))
    score = Scorer("model", (number_of(first_tag(F.col("tags"), "value")) / 500).cast("float"))
    return config().with_evaluators(flag, odd).with_inference(score, score_threshold=0.9)


_N, _SCORE = "CAST(v AS DOUBLE)", "CAST(value / 500 AS REAL)"
_AGE = "(epoch_us(now) - us)"
RULES: dict[str, tuple[R.Rule, str]] = {
    "stage_verdict_is": (R.StageVerdictIs("eval", FLAG), "event_type = 'error'"),
    "evaluator_score_above": (R.EvaluatorScoreAbove("model", 0.2), f"{_SCORE} >= CAST(0.2 AS REAL)"),
    "tag_equals": (R.TagEquals("k", "7"), "k = '7'"),
    "and": (R.TagEquals("k", "7") & R.EventTypeIs("click"), "k = '7' AND event_type = 'click'"),
    "or": (R.TagEquals("k", "7") | R.EventTypeIs("click"), "k = '7' OR event_type = 'click'"),
    "not": (~R.TagEquals("k", "7"), "k IS DISTINCT FROM '7'"),
    "tag_contains": (R.TagContains("value", "9"), "contains(v, '9')"),
    "tag_starts_with": (R.TagStartsWith("value", "3"), "starts_with(v, '3')"),
    "tag_in": (R.TagIn("k", ("1", "2", "30")), "k IN ('1', '2', '30')"),
    "tag_exists": (R.TagExists("k"), "k IS NOT NULL"),
    "tag_value_less_than": (R.TagValueLessThan("value", 20.5), f"{_N} < 20.5"),
    "tag_value_greater_than": (R.TagValueGreaterThan("value", 100), f"{_N} > 100"),
    "tag_value_between": (R.TagValueBetween("value", 20, 30.25), f"{_N} >= 20 AND {_N} < 30.25"),
    "event_type_is": (R.EventTypeIs("purchase"), "event_type = 'purchase'"),
    "event_type_in": (R.EventTypeIn(("view", "signup")), "event_type IN ('view', 'signup')"),
    "tenant_is": (R.TenantIs("tenant-4"), "tenant_id = 'tenant-4'"),
    "event_older_than": (R.EventOlderThan(10 * DAY), f"{_AGE} > 0 AND {_AGE} > {10 * DAY}000"),
    "event_newer_than": (R.EventNewerThan(5 * DAY), f"{_AGE} >= 0 AND {_AGE} < {5 * DAY}000"),
    "evaluator_score_between": (R.EvaluatorScoreBetween("model", 0.05, 0.1), f"{_SCORE} >= CAST(0.05 AS REAL) AND {_SCORE} < CAST(0.1 AS REAL)"),
    "stage_is_degraded": (R.StageIsDegraded("eval"), "event_id % 9 = 0"),
    "evaluator_was_skipped": (R.EvaluatorWasSkipped("evaluator_1"), "event_id % 9 = 0"),
    "evaluator_reason_is": (R.EvaluatorReasonIs("watch", "error_event"), "event_type = 'error'"),
}
for _name, (_rule_, _test) in RULES.items():
    register(f"rule_{_name}", f"WITH {EV} SELECT event_id, coalesce({_test}, false) AS fired FROM e")(
        lambda s, d, r=_rule_: (lambda x: x.select("event_id", (F.size(stage_of(x, "policy")["evaluator_results"]) > 0).alias("fired")))(decide(_subject().with_policy(Policy().add(r, rule_id="r")), events(s, d)))
    )


# policy ------------------------------------------------------------------------------------------
def _ids(d: DataFrame) -> Column:
    return F.array_join(F.transform(stage_of(d, "policy")["evaluator_results"], lambda r: r["evaluator_id"]), ",").alias("rules")


def _active(d: DataFrame) -> Column:
    return F.array_join(F.transform("active_decisions", lambda a: F.concat_ws(":", a["decision_type_id"], a["rule_id"])), ",").alias("active")


@register("policy_first_match", f"WITH {EV} SELECT event_id, CASE WHEN {_N} > 200 THEN 'block' WHEN event_type = 'purchase' THEN 'flag' ELSE 'pass' END AS verdict, CASE WHEN {_N} > 200 THEN 'big' WHEN event_type = 'purchase' THEN 'buy' WHEN k IN ('1', '2') THEN 'kept' ELSE '' END AS rules FROM e")
def policy_first_match(spark, sf_dir):
    p = Policy().add(R.TagIn("k", ("1", "2")), 3, PASS, "kept").add(R.TagValueGreaterThan("value", 200), 1, BLOCK, "big").add(R.EventTypeIs("purchase"), 2, FLAG, "buy")
    d = decide(config().with_policy(p), events(spark, sf_dir))
    return short(d, _ids(d))


def fleet_types() -> DecisionTypes:
    """What may be done about a device; a pulled one is not sampled, and one with a ticket is not muted."""
    t = DecisionTypes().add("pull", "take the device off the network", 3).add("ticket", "open a repair ticket", 12).add("sample", "keep its readings", 15).add("mute", "hide it from dashboards", 30)
    return t.exclude("pull", "sample").exclude("mute", "ticket")


def fleet_config() -> PipelineConfig:
    """Readings of a fleet of devices: hot ones are flagged, those with recalled firmware blocked."""
    hot = ColumnEvaluator("heat", F.when(number_of(first_tag(F.col("tags"), "celsius")) > 150, FLAG).otherwise(PASS), "overheated")
    recalled = ColumnEvaluator("firmware", F.when(number_of(event_tag(F.col("tags"), "build")) >= 90, BLOCK).otherwise(PASS), "recalled_build")
    p = Policy().add(R.StageVerdictIs("eval", BLOCK) & ~R.TagEquals("ring", "lab"), 2, BLOCK, "pull_recalled", "pull")
    p.add(R.TagValueGreaterThan("celsius", 150), 4, FLAG, "repair_hot", "ticket").add(R.TagIn("ring", ("lab", "canary")), 4, FLAG, "watch_early_ring", "sample").add(R.EventTypeIs("view"), 9, PASS, "mute_views", "mute")
    return config("fleet").with_evaluators(hot, recalled).with_policy(p).with_decision_types(fleet_types())


def fleet_events(spark, sf_dir) -> DataFrame:
    """Events as readings: the value a temperature, k a firmware build, every seventh user in the lab ring."""
    df = events(spark, sf_dir)
    tag = lambda name, value: F.struct(F.lit(name).alias("key"), value.cast("string").alias("value"))
    user = F.substring("entity_id", 6, 20).cast("long")
    ring = F.when(user % 7 == 0, "lab").when(user % 7 == 1, "canary").otherwise("field")
    return df.withColumn("tags", F.array(tag("celsius", first_tag(F.col("tags"), "value")), tag("build", first_tag(F.col("tags"), "k")), tag("ring", ring)))


_FLEET = [("recalled AND ring <> 'lab'", "pull", "pull_recalled"), ("hot", "ticket", "repair_hot"), ("ring <> 'field' AND NOT (recalled AND ring <> 'lab')", "sample", "watch_early_ring"), ("event_type = 'view' AND NOT hot", "mute", "mute_views")]
_listed = lambda pairs: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in pairs) + "], lambda x: x IS NOT NULL), ',')"
FLEET = f"""WITH {EV}, f AS (SELECT event_id, event_type, CAST(v AS DOUBLE) > 150 AS hot, CAST(k AS INTEGER) >= 90 AS recalled, CASE user_id % 7 WHEN 0 THEN 'lab' WHEN 1 THEN 'canary' ELSE 'field' END AS ring FROM e)
SELECT event_id, CASE WHEN recalled THEN 'block' WHEN hot OR ring <> 'field' THEN 'flag' ELSE 'pass' END AS verdict, {_listed([(c, r) for c, _, r in _FLEET])} AS rules, {_listed([(c, f"{t}:{r}") for c, t, r in _FLEET])} AS active FROM f"""


@register("flagship_fleet", FLEET)
def flagship_fleet(spark, sf_dir):
    d = decide(fleet_config(), fleet_events(spark, sf_dir))
    return short(d, _ids(d), _active(d))


def _multi(types: DecisionTypes, *rules: tuple) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf_dir):
        p = Policy()
        for r in rules:
            p.add(*r)
        d = decide(config().with_policy(p).with_decision_types(types), events(spark, sf_dir))
        return short(d, _ids(d), _active(d))

    return run


_K = "CAST(k AS INTEGER)"
_list = lambda *pairs: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in pairs) + "], lambda x: x IS NOT NULL), ',')"
register(
    "policy_multi",
    f"WITH {EV} SELECT event_id, CASE WHEN {_N} > 200 THEN 'block' WHEN event_type = 'click' OR {_K} < 30 THEN 'flag' ELSE 'pass' END AS verdict, {_list(('event_type = $$click$$', 'plain'), (f'{_N} > 200', 'big'), (f'{_K} < 30', 'low'))} AS rules, {_list((f'{_N} > 200', 'stop:big'), (f'{_K} < 30', 'look:low'))} AS active FROM e",
)(_multi(DecisionTypes().add("look", priority=5).add("stop", priority=1), (R.EventTypeIs("click"), 1, FLAG, "plain"), (R.TagValueGreaterThan("value", 200), 2, BLOCK, "big", "stop"), (R.TagValueLessThan("k", 30), 3, FLAG, "low", "look")))
register(
    "policy_dedup",
    f"WITH {EV} SELECT event_id, CASE WHEN {_K} < 20 THEN 'flag' WHEN {_K} < 50 THEN 'block' ELSE 'pass' END AS verdict, CASE WHEN {_K} < 20 THEN 'narrow' WHEN {_K} < 50 THEN 'wide' ELSE '' END AS rules, CASE WHEN {_K} < 20 THEN 'stop:narrow' WHEN {_K} < 50 THEN 'stop:wide' ELSE '' END AS active FROM e",
)(_multi(DecisionTypes().add("stop", priority=1), (R.TagValueLessThan("k", 50), 2, BLOCK, "wide", "stop"), (R.TagValueLessThan("k", 20), 1, FLAG, "narrow", "stop")))
# a excludes b and b excludes c at one priority: b, itself a loser, still removes c
register(
    "policy_combinability",
    f"WITH {EV}, f AS (SELECT event_id, {_K} % 2 = 0 AS a, {_K} % 3 = 0 AS b, {_K} % 5 = 0 AS c FROM e) SELECT event_id, CASE WHEN b AND NOT a THEN 'block' WHEN a OR (c AND NOT b) THEN 'flag' ELSE 'pass' END AS verdict, {_list(('a', 'ra'), ('b AND NOT a', 'rb'), ('c AND NOT b', 'rc'))} AS rules, {_list(('a', 'a:ra'), ('b AND NOT a', 'b:rb'), ('c AND NOT b', 'c:rc'))} AS active FROM f",
)(lambda s, d: _combined(s, d))


def _combined(spark, sf_dir):
    types = DecisionTypes().add("a", priority=7).add("b", priority=7).add("c", priority=7).exclude("a", "b").exclude("b", "c")
    p = Policy()
    for n, m, v in (("a", 2, FLAG), ("b", 3, BLOCK), ("c", 5, FLAG)):
        p.add(R.TagIn("k", tuple(str(i) for i in range(0, 100, m))), 1, v, f"r{n}", n)
    d = decide(config().with_policy(p).with_decision_types(types), events(spark, sf_dir))
    return short(d, _ids(d), _active(d))


@register("active_decisions", f"WITH {EV}, f AS (SELECT event_id, {_N} > 100 AS a, event_type = 'view' AS b FROM e) SELECT event_id, CAST(a::INT + b::INT AS INTEGER) AS n, CASE WHEN b THEN 3 WHEN a THEN 9 END AS top FROM f")
def active_decisions(spark, sf_dir):
    types = DecisionTypes().add("big", priority=9).add("seen", priority=3)
    p = Policy().add(R.TagValueGreaterThan("value", 100), 1, FLAG, "r1", "big").add(R.EventTypeIs("view"), 2, PASS, "r2", "seen")
    d = decide(config().with_policy(p).with_decision_types(types), events(spark, sf_dir))
    return d.select("event_id", F.size("active_decisions").alias("n"), F.get("active_decisions", F.lit(0))["priority"].alias("top"))


@register("final_verdict", f"WITH {EV} SELECT event_id, CASE WHEN {_N} > 250 THEN 'block' WHEN event_type = 'error' OR {_SCORE} > CAST(0.4 AS REAL) OR epoch_us(now) - us >= 2160000001000 THEN 'flag' ELSE 'pass' END AS verdict, CAST(4 AS INTEGER) AS stages FROM e")
def final_verdicts(spark, sf_dir):
    c = _subject().with_ingest(skew_ms=25 * DAY).with_policy(Policy().add(R.TagValueGreaterThan("value", 250), 1, BLOCK, "big"))
    c.inference.score_threshold = 0.4
    d = decide(c, events(spark, sf_dir))
    return short(d, F.size("stage_outputs").alias("stages"))


@register("degraded_merge", f"WITH {EV} SELECT event_id, CAST(CASE WHEN event_id % 9 = 0 THEN 2 ELSE 0 END | CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END | CASE WHEN event_id % 7 = 0 THEN 32 ELSE 0 END AS INTEGER) AS degraded FROM e")
def degraded_merge(spark, sf_dir):
    odd = ColumnEvaluator("odd", F.lit(PASS), error=F.when(F.col("event_id") % 9 == 0, "internal"))
    slow = ColumnEvaluator("slow", F.lit(PASS), error=F.when(F.col("event_id") % 4 == 0, "timeout"))
    df = events(spark, sf_dir).withColumn("tenant_id", F.when(F.col("event_id") % 7 != 0, F.col("tenant_id")))
    return decide(config().with_evaluators(odd).with_inference(slow), df).select("event_id", F.col("degraded_reason").alias("degraded"))


@register("minimal_decisions", f"WITH {EV}, r AS (SELECT *, count(*) OVER (PARTITION BY tenant_id, entity_id, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM e), x AS (SELECT event_id, CASE WHEN user_id IN (3, 13) THEN 2 WHEN n > 3 THEN 1 ELSE 0 END AS v, value FROM r) SELECT event_id, CASE WHEN v = 2 OR (v = 1 AND value > 100) THEN 'block' WHEN v = 1 THEN 'flag' ELSE 'pass' END AS verdict FROM x")
def minimal_decisions(spark, sf_dir):
    p = Policy().add(R.StageVerdictIs("eval", FLAG) & R.TagValueGreaterThan("value", 100), 1, BLOCK, "busy_and_big")
    return short(decide(config().with_evaluators(AllowDeny(deny=["user-3", "user-13"]), Threshold(3, DAY)).with_policy(p), events(spark, sf_dir)))


@register("orders_threshold", "WITH o AS (SELECT o_orderkey, o_custkey, c_mktsegment, epoch_us(CAST(o_orderdate AS TIMESTAMP)) // 1000 // 7776000000 AS q, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey), r AS (SELECT o_orderkey, count(*) OVER (PARTITION BY c_mktsegment, o_custkey, q ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS n FROM o) SELECT o_orderkey AS event_id, CASE WHEN n > 1 THEN 'flag' ELSE 'pass' END AS verdict FROM r")
def orders_threshold(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    c = PipelineConfig("orders").with_targets(Noop()).with_ingest(skew_ms=40_000 * DAY).with_evaluators(Threshold(1, 90 * DAY))
    return short(decide(c, orders_as_events(spark, sf_dir)))


# routing and limits --------------------------------------------------------------------------------
def _cells_sql(n: int, k: int, key: str) -> str:
    probes = ", ".join(f"xor(('0x' || substr(md5({key}), 1, 15))::BIGINT, {s}) % {n}" for s in routing.candidate_seeds())
    return f"list_filter([{probes}] || range({n}), lambda x, i: list_position([{probes}] || range({n}), x) = i)[1:{k}]"


@register("shard_cells", f"WITH t AS (SELECT DISTINCT 'user-' || user_id AS tenant FROM events), c AS (SELECT tenant, {_cells_sql(16, 4, 'tenant')} AS cells FROM t) SELECT tenant, array_to_string(cells, ',') AS cells, CAST(cells[1] AS INTEGER) AS home FROM c")
def shard_cells(spark, sf_dir):
    t = events(spark, sf_dir).select(F.col("entity_id").alias("tenant")).distinct()
    own = routing.cells(F.col("tenant"), 16, 4)
    return t.select("tenant", F.array_join(own.cast("array<string>"), ",").alias("cells"), F.get(own, F.lit(0)).alias("home"))


@register("fleet_owners", f"WITH t AS (SELECT DISTINCT 'user-' || user_id AS tenant FROM events), c AS (SELECT tenant, {_cells_sql(8, 2, 'tenant')} AS own FROM t) SELECT tenant, list_contains(own, 3) AS owned FROM c")
def fleet_owners(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("entity_id").alias("tenant")).distinct().select("tenant", routing.owns(F.col("tenant"), 3, 8, 2).alias("owned"))


@register("redirect_hint", f"WITH t AS (SELECT DISTINCT 'user-' || user_id AS tenant FROM events), c AS (SELECT tenant, {_cells_sql(8, 2, 'tenant')} AS own FROM t) SELECT tenant, array_to_string(list_transform(list_filter(own, lambda x: x <> 5), lambda x: 'host-' || x || ':80'), ',') AS hint FROM c")
def redirect_hints(spark, sf_dir):
    topology = spark.range(8).select(F.col("id").cast("int").alias("id"), F.when(F.col("id") == 5, "").otherwise(F.concat(F.lit("host-"), F.col("id").cast("string"), F.lit(":80"))).alias("address"))
    t = events(spark, sf_dir).select(F.col("entity_id").alias("tenant")).distinct()
    return routing.redirect_hint(t, topology, 8, 2, "tenant")


@register("owner_overlap", f"WITH t AS (SELECT DISTINCT 'user-' || user_id AS tenant FROM events), c AS (SELECT array_to_string(list_sort({_cells_sql(8, 2, 'tenant')}), ',') AS owner_set FROM t) SELECT owner_set, count(*) AS tenants, count(*) * (count(*) - 1) // 2 AS pairs FROM c GROUP BY ALL HAVING count(*) > 1")
def owner_overlap(spark, sf_dir):
    return routing.shared_owner_pairs(events(spark, sf_dir), 8, 2, "entity_id")


@register("rate_limit_burst", f"WITH {EV} SELECT event_id, row_number() OVER (PARTITION BY tenant_id ORDER BY ts, event_id) <= 40 AS admitted FROM e")
def rate_limit_burst(spark, sf_dir):
    return ratelimit.admit(events(spark, sf_dir), 40).select("event_id", "admitted")


@register(
    "rate_limit_refill",
    f"""WITH RECURSIVE {EV}, o AS (SELECT event_id, tenant_id, us // 60000000 AS t, row_number() OVER (PARTITION BY tenant_id ORDER BY us // 60000000, event_id) AS n FROM e),
r AS (SELECT tenant_id, n, event_id, t, 2000000 - 1000000 AS level, true AS admitted FROM o WHERE n = 1
  UNION ALL SELECT o.tenant_id, o.n, o.event_id, o.t, l - CASE WHEN l >= 1000000 THEN 1000000 ELSE 0 END, l >= 1000000 FROM (SELECT r.tenant_id AS tid, r.n AS rn, o.event_id AS eid, least(2000000, r.level + (o.t - r.t) * 10000) AS l FROM r JOIN o ON o.tenant_id = r.tenant_id AND o.n = r.n + 1) x JOIN o ON o.tenant_id = x.tid AND o.n = x.rn + 1)
SELECT event_id, admitted FROM r""",
)
def rate_limit_refill(spark, sf_dir):
    """Minutes stand for microseconds, 10 000 microtokens a minute: a token in 100 minutes."""
    df = events(spark, sf_dir).withColumn("timestamp", F.timestamp_micros(F.floor(F.unix_micros("timestamp") / 60_000_000).cast("long")))
    return ratelimit.admit(df, 2, 10_000, "continuous").select("event_id", "admitted")


@register("in_flight", f"WITH {EV}, i AS (SELECT event_id, tenant_id, us AS b, us + 3600000000 AS f FROM e), m AS (SELECT tenant_id, event_id, b AS at_us, 1 AS step FROM i UNION ALL SELECT tenant_id, event_id, f, -1 FROM i), s AS (SELECT *, sum(step) OVER (PARTITION BY tenant_id ORDER BY at_us, step, event_id ROWS UNBOUNDED PRECEDING) AS n FROM m) SELECT event_id, CAST(n AS BIGINT) AS in_flight FROM s WHERE step = 1")
def in_flight(spark, sf_dir):
    us = F.unix_micros("timestamp")
    return ratelimit.concurrency_at(events(spark, sf_dir).select("tenant_id", "event_id", us.alias("begin"), (us + 3_600_000_000).alias("end"))).select("event_id", F.col("in_flight").cast("long").alias("in_flight"))


@register(
    "concurrency_cap",
    f"""WITH RECURSIVE {EV}, o AS (SELECT event_id, tenant_id, us AS b, us + 7200000000 AS f, row_number() OVER (PARTITION BY tenant_id ORDER BY us, event_id) AS n FROM e),
r AS (SELECT tenant_id, n, event_id, true AS admitted, [f] AS ends FROM o WHERE n = 1
  UNION ALL SELECT tenant_id, n, event_id, len(ends) < 3, CASE WHEN len(ends) < 3 THEN list_append(ends, f) ELSE ends END FROM (SELECT o.tenant_id, o.n, o.event_id, o.f, list_filter(r.ends, lambda x: x > o.b) AS ends FROM r JOIN o ON o.tenant_id = r.tenant_id AND o.n = r.n + 1) x)
SELECT event_id, admitted FROM r""",
)
def concurrency_cap(spark, sf_dir):
    """Events as calls of two hours, three of a tenant at a time."""
    us = F.unix_micros("timestamp")
    return ratelimit.cap(events(spark, sf_dir).select("tenant_id", "event_id", us.alias("begin"), (us + 7_200_000_000).alias("end")), 3).select("event_id", "admitted")


# reports, state, sinks -----------------------------------------------------------------------------
@register("verdict_report", f"WITH {EV}, r AS (SELECT tenant_id, user_id, count(*) OVER (PARTITION BY tenant_id, entity_id, day ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM e), x AS (SELECT tenant_id, CASE WHEN user_id % 7 = 0 THEN 2 WHEN n > 2 THEN 1 ELSE 0 END AS v FROM r) SELECT tenant_id, count(*) AS events, count(*) FILTER (v = 0) AS passed, count(*) FILTER (v = 1) AS flagged, count(*) FILTER (v = 2) AS blocked, CAST(0 AS BIGINT) AS degraded FROM x GROUP BY ALL")
def verdict_report(spark, sf_dir):
    """Every seventh user is denied, however many there are."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").filter("user_id % 7 = 0").select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("value"))
    c = config().with_evaluators(AllowDeny(deny=users), Threshold(2, DAY))
    return metrics.verdict_report(decide(c, events(spark, sf_dir)), "tenant_id")


@register("latency_p99", f"WITH {EV}, s AS (SELECT tenant_id, value, row_number() OVER (PARTITION BY tenant_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY tenant_id) AS n FROM e) SELECT tenant_id, max(value) FILTER (i = n * 50 // 100) AS p50, max(value) FILTER (i = n * 99 // 100) AS p99 FROM s GROUP BY ALL")
def latency_p99(spark, sf_dir):
    return metrics.ranked_percentiles(events(spark, sf_dir).withColumn("v", number_of(first_tag(F.col("tags"), "value"))), F.col("v"), (50, 99), "tenant_id")


@register("upsert_merge", f"WITH {EV}, {WS} SELECT tenant_id, entity_id, epoch, CASE WHEN epoch % 3 = 0 THEN aggregate + 100 ELSE aggregate END AS aggregate FROM ws")
def upsert_merge(spark, sf_dir):
    ws = window_totals(spark, sf_dir)
    return merge_latest(ws, ws.filter("epoch % 3 = 0").withColumn("aggregate", F.col("aggregate") + 100)).select("tenant_id", "entity_id", "epoch", "aggregate")


@register("expire_keys", f"WITH {EV}, {WS} SELECT tenant_id, entity_id, epoch, version FROM ws WHERE aggregate > 2")
def expire_keys(spark, sf_dir):
    ws = window_totals(spark, sf_dir)
    return expire(ws, ws.filter("aggregate <= 2")).select("tenant_id", "entity_id", "epoch", "version")


@register("write_back_changes", f"WITH {EV}, {WS} SELECT tenant_id, entity_id, epoch, CASE WHEN epoch % 2 = 0 THEN 7.0 ELSE aggregate END AS aggregate FROM ws WHERE epoch % 5 <> 1 OR epoch % 2 = 0")
def write_back_changes(spark, sf_dir):
    """Expired keys go, keys made anew after that stay with their newest value."""
    ws = window_totals(spark, sf_dir)
    gone = ws.filter("epoch % 5 = 1").withColumn("seq", F.lit(1)).withColumn("deleted", F.lit(True))
    anew = ws.filter("epoch % 2 = 0").withColumn("aggregate", F.lit(7.0)).withColumn("seq", F.lit(2)).withColumn("deleted", F.lit(False))
    return apply_changes(ws, gone.unionByName(anew)).select("tenant_id", "entity_id", "epoch", "aggregate")


@register("warm_cold_union", f"WITH {EV}, {WS} SELECT tenant_id, sum(aggregate) + sum(CASE WHEN epoch = 19740 THEN aggregate ELSE 0 END) AS total FROM ws GROUP BY ALL")
def warm_cold_union(spark, sf_dir):
    ws = window_totals(spark, sf_dir)
    return ws.filter("epoch >= 19740").unionByName(ws.filter("epoch <= 19740")).groupBy("tenant_id").agg(F.sum("aggregate").alias("total"))


@register("distinct_epochs", f"WITH {EV}, {WS} SELECT DISTINCT epoch FROM ws")
def distinct_epochs(spark, sf_dir):
    return window_totals(spark, sf_dir).select("epoch").distinct()


@register("audit_lines", f"""WITH {EV} SELECT '{{"event_id":' || event_id || ',"tenant_id":"' || tenant_id || '","entity_id":"' || entity_id || '","final_verdict":"' || CASE WHEN event_type = 'error' THEN 'flag' ELSE 'pass' END || '","degraded":false,"elapsed_us":0}}' AS value FROM e""")
def audit(spark, sf_dir):
    return audit_lines(decide(config().with_evaluators(ColumnEvaluator("watch", F.when(F.col("event_type") == "error", FLAG).otherwise(PASS))), events(spark, sf_dir)))


@register("stdout_lines", f"WITH {EV} SELECT '[decision] event=' || event_id || ' tenant=' || tenant_id || ' entity=' || entity_id || ' verdict=pass elapsed_us=0 degraded=0' AS value FROM e")
def stdout(spark, sf_dir):
    return stdout_lines(decide(config(), events(spark, sf_dir)))


@register("decision_json", f"WITH {EV} SELECT event_id, CASE WHEN event_type = 'error' THEN 'flag' ELSE 'pass' END AS verdict, CAST(2 AS INTEGER) AS stages FROM e")
def decision_round_trip(spark, sf_dir):
    """Decisions written as JSON and read back."""
    d = decide(config().with_evaluators(ColumnEvaluator("watch", F.when(F.col("event_type") == "error", FLAG).otherwise(PASS))), events(spark, sf_dir))
    return short(decisions_from_json(decision_json(d)), F.size("stage_outputs").alias("stages"))


@register("epoch_of", f"WITH {EV} SELECT event_id, us // 1000 // 60000 AS minute, CAST(0 AS BIGINT) AS none FROM e")
def epochs(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", epoch_of(F.col("timestamp"), 60_000).alias("minute"), epoch_of(F.col("timestamp"), 0).alias("none"))


# streams and stored state ----------------------------------------------------------------------------
@register("stream_threshold", _running("count(*)", "entity_id", 3))
def stream_threshold(spark, sf_dir):
    """The running counter as a stateful stream over the same files, drained into Parquet."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    out = scratch_dir(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    counts = running_counts(as_events(source), DAY)
    query = counts.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    over = F.col("window_count") > 3
    return spark.read.parquet(f"{out}/rows").select("event_id", F.when(over, "flag").otherwise("pass").alias("verdict"), F.when(over, "threshold_exceeded").alias("reason"))


def _days(spark, sf_dir, label: str, parts: int = 3) -> tuple[DataFrame, str]:
    """The events as a stream of several micro-batches, in the order of their days, and a folder for what it leaves."""
    out = scratch_dir(spark, label)
    df = events(spark, sf_dir)
    bounds = [r[0] for r in df.select(F.explode(F.percentile("event_id", F.array(*[F.lit((i + 1) / parts) for i in range(parts - 1)])))).collect()]
    cuts = [-1, *sorted(int(b) for b in bounds), 1 << 62]
    for lo, hi in zip(cuts, cuts[1:]):  # a file a micro-batch, whatever its windows
        df.filter((F.col("event_id") > lo) & (F.col("event_id") <= hi)).coalesce(1).write.mode("append").parquet(f"{out}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in"), out


@register("stream_pipeline", f"WITH {EV}, p AS (SELECT quantile_cont(event_id, 1 / 3.0) AS a, quantile_cont(event_id, 2 / 3.0) AS b FROM e), x AS (SELECT e.*, CASE WHEN event_id <= floor(a) THEN 0 WHEN event_id <= floor(b) THEN 1 ELSE 2 END AS batch FROM e, p), r AS (SELECT event_id, count(*) OVER (PARTITION BY tenant_id, entity_id, day ORDER BY batch, ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM x) SELECT event_id, CASE WHEN n > 3 THEN 'flag' ELSE 'pass' END AS verdict, CASE WHEN n > 3 THEN 'threshold_exceeded' END AS reason FROM r")
def stream_pipeline(spark, sf_dir):
    """A pipeline over a stream of three micro-batches whose counters go on from one to the next."""
    source, out = _days(spark, sf_dir, "stream_pipeline")
    p = Pipeline(PipelineConfig("q").with_ingest(skew_ms=40 * DAY).with_evaluators(Threshold(3, DAY)).with_targets(ParquetFiles(f"{out}/decisions")), _as_of()).start()
    p.stream(source, f"{out}/checkpoint")
    p.drain(3600)
    d = spark.read.parquet(f"{out}/decisions").drop("batch")
    return short(d, reason(d, "eval"))


@register("write_back_flush", f"WITH {EV}, {WS} SELECT tenant_id, entity_id, epoch, CASE WHEN entity_id IN ('user-1', 'user-2') THEN aggregate + 5 ELSE aggregate END AS aggregate, CASE WHEN entity_id IN ('user-1', 'user-2') THEN version + 1 ELSE version END AS version FROM ws")
def write_back_flush(spark, sf_dir):
    """Two entities' windows changed in the process and flushed to the snapshot."""
    s = Snapshot(spark, scratch_dir(spark, "write_back"))
    s.upsert(window_totals(spark, sf_dir))
    store = WriteBack(s)
    for r in s.warm().filter(F.col("entity_id").isin("user-1", "user-2")).collect():  # the windows of two entities
        key = tuple(r[c] for c in ("tenant_id", "entity_id", "window_name", "epoch"))
        total, version = store.get(*key)
        store.compare_and_set(key, version, total + 5)
    store.flush()
    return s.warm().select("tenant_id", "entity_id", "epoch", "aggregate", "version")


@register("cas_update", f"WITH {EV}, {WS} SELECT tenant_id, entity_id, epoch, CASE WHEN version = 2 THEN 77.0 ELSE aggregate END AS aggregate, CASE WHEN version = 2 THEN 3 ELSE version END AS version FROM ws")
def cas_update(spark, sf_dir):
    """A conditional update that expects version 2 everywhere is applied where it is so."""
    s = Snapshot(spark, scratch_dir(spark, "cas"))
    s.upsert(window_totals(spark, sf_dir))
    s.update(s.warm().select("tenant_id", "entity_id", "window_name", "epoch", F.lit(77.0).alias("aggregate"), F.lit(2).cast("long").alias("expected")))
    return s.warm().select("tenant_id", "entity_id", "epoch", "aggregate", "version")


@register("archive_roundtrip", f"WITH {EV}, {WS} SELECT tenant_id, epoch < 19740 AS archived, sum(aggregate) AS total, count(*) AS windows FROM ws GROUP BY ALL")
def archive_roundtrip(spark, sf_dir):
    """Window state written to the warm tier, old epochs moved to the cold one, both read back."""
    s = Snapshot(spark, scratch_dir(spark, "state"))
    s.upsert(window_totals(spark, sf_dir))
    s.archive(19740)
    both = s.warm().withColumn("archived", F.lit(False)).unionByName(s.cold().withColumn("archived", F.lit(True)))
    return both.groupBy("tenant_id", "archived").agg(F.sum("aggregate").alias("total"), F.count(F.lit(1)).alias("windows"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship_fleet(spark, sf_dir)
