"""Events from tables, JSON and posted bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import EVENT, TAGS
from ..session import scratch_dir


def tags_of(**values: Column) -> Column:
    """An array of tags in the order given; nulls are left out."""
    each = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])
    return F.filter(each, lambda t: t["value"].isNotNull())


def table_events(df: DataFrame, event_id: Column, tenant: Column, entity: Column, event_type: Column, timestamp: Column, tags: Column | None = None, payload: Column | None = None) -> DataFrame:
    """Any table as events."""
    empty = F.array().cast(TAGS)
    return df.select(
        event_id.cast("long").alias("event_id"), tenant.cast("string").alias("tenant_id"), entity.cast("string").alias("entity_id"), event_type.cast("string").alias("event_type"), timestamp.cast("timestamp").alias("timestamp"),
        (F.lit(None) if payload is None else payload).cast("binary").alias("payload"), (empty if tags is None else F.coalesce(tags, empty)).alias("tags"),
    )


def as_events(df: DataFrame) -> DataFrame:
    """Rows of the `events` table, batch or stream: ten tenants, a user an entity, tags k and value."""
    user = F.col("user_id")
    return table_events(df, F.col("event_id"), F.concat(F.lit("tenant-"), (user % 10).cast("string")), F.concat(F.lit("user-"), user.cast("string")), F.col("event_type"), F.col("ts"), tags_of(k=F.get_json_object("props", "$.k"), value=F.col("value")))


def events_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def orders_as_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: a market segment a tenant, a customer an entity, the priority as type."""
    orders, customer = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    df = orders.join(customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return table_events(df, F.col("o_orderkey"), F.col("c_mktsegment"), F.col("o_custkey"), F.col("o_orderpriority"), F.col("o_orderdate"), tags_of(amount=F.col("o_totalprice")))


def with_event_ids(df: DataFrame) -> DataFrame:
    """Ids from 1 in the order of (timestamp, tenant, entity), for sources without ids: a range sort, counts per
    partition, and the partitions' bases - no single task numbers all rows. The numbered rows are written once, to
    spark.checkpoint.dir, so that both uses of them see the same partitions whatever is retried."""
    part = df.drop("event_id").repartitionByRange("timestamp", "tenant_id", "entity_id").withColumn("_p", F.spark_partition_id())
    part = part.withColumn("_n", F.row_number().over(W.partitionBy("_p").orderBy("timestamp", "tenant_id", "entity_id")))
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, "event_ids")
    part.write.parquet(path)
    part = spark.read.schema(part.schema).parquet(path)
    sizes = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    bases = sizes.select("_p", F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return part.join(bases, "_p").withColumn("event_id", (F.col("_n") + F.col("_b")).cast("long")).select(*[f.name for f in EVENT.fields])


def events_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """One JSON object a line with the fields of an event; what cannot be parsed becomes an invalid
    event, which the ingest stage marks."""
    e = lines.select(F.from_json(column, EVENT).alias("e")).select("e.*")
    return e.withColumn("tags", F.coalesce("tags", F.array().cast(TAGS)))


def http_events(bodies: DataFrame, column: str = "value", default_time: Column | None = None) -> DataFrame:
    """Posted bodies: tenant_id, entity_id, event_type ('event' by default). A body has no time of its own:
    the epoch, which counts as late, unless default_time says otherwise. Streaming frames work too."""
    b = bodies.select(F.from_json(column, "tenant_id string, entity_id string, event_type string").alias("b")).select("b.*")
    at = F.timestamp_millis(F.lit(0)) if default_time is None else default_time
    return b.select(F.monotonically_increasing_id().alias("event_id"), "tenant_id", "entity_id", F.coalesce("event_type", F.lit("event")).alias("event_type"), at.alias("timestamp"), F.lit(None).cast("binary").alias("payload"), F.array().cast(TAGS).alias("tags"))
