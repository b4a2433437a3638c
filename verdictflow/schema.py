"""Record types and their constants."""

from __future__ import annotations

from pyspark.sql import types as T

PASS, FLAG, BLOCK = 0, 1, 2
VERDICTS = ("pass", "flag", "block")
STAGES = ("ingest", "eval", "inference", "policy", "emit")

#: Bits of a decision's degraded_reason.
EVALUATOR_TIMEOUT = 1
EVALUATOR_ERROR = 2
STATE_STORE_UNAVAILABLE = 4
EMISSION_RETRY_EXHAUSTED = 8
RATE_LIMIT_EXHAUSTED = 16
INGEST_VALIDATION_FAILED = 32

# an array, not a map: keys may repeat and the first one counts
TAGS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))
EVENT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("tenant_id", T.StringType()), T.StructField("entity_id", T.StringType()), T.StructField("event_type", T.StringType()),
    T.StructField("timestamp", T.TimestampType()), T.StructField("payload", T.BinaryType()), T.StructField("tags", TAGS),
])
RESULT = T.StructType([
    T.StructField("evaluator_id", T.StringType()), T.StructField("verdict", T.IntegerType()), T.StructField("reason_code", T.StringType()), T.StructField("score", T.FloatType()),
    T.StructField("skipped", T.BooleanType()), T.StructField("metadata", T.StringType()), T.StructField("decision_type_id", T.StringType()),
])
STAGE = T.StructType([
    T.StructField("stage_id", T.StringType()), T.StructField("verdict", T.IntegerType()), T.StructField("evaluator_results", T.ArrayType(RESULT)),
    T.StructField("degraded_reason", T.IntegerType()), T.StructField("elapsed_us", T.LongType()),
])
ACTIVE = T.StructType([T.StructField("decision_type_id", T.StringType()), T.StructField("rule_id", T.StringType()), T.StructField("priority", T.IntegerType())])
DECISION = T.StructType([
    T.StructField("pipeline_id", T.StringType()), T.StructField("pipeline_version", T.StringType()), T.StructField("event_id", T.LongType()), T.StructField("tenant_id", T.StringType()), T.StructField("entity_id", T.StringType()),
    T.StructField("decided_at", T.TimestampType()), T.StructField("stage_outputs", T.ArrayType(STAGE)), T.StructField("final_verdict", T.IntegerType()), T.StructField("degraded_reason", T.IntegerType()),
    T.StructField("elapsed_us", T.LongType()), T.StructField("active_decisions", T.ArrayType(ACTIVE)),
])
WINDOW_STATE = T.StructType([
    T.StructField("tenant_id", T.StringType()), T.StructField("entity_id", T.StringType()), T.StructField("window_name", T.StringType()), T.StructField("epoch", T.LongType()),
    T.StructField("aggregate", T.DoubleType()), T.StructField("version", T.LongType()),
])
WINDOW_KEY = ["tenant_id", "entity_id", "window_name", "epoch"]
