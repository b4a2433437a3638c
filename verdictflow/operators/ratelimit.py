"""Admission by token bucket and by concurrency: per tenant, in the order of (timestamp, event_id).

What is left in the buckets is a table (tenant_id, level in microtokens, last in microseconds), which `after`
gives and a later `admit` takes, so a bucket lasts from one batch to the next."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Microtokens of a token.
TOKEN = 1_000_000
#: Parts that a tenant's events are dealt to before the first ones of all are looked for.
PARTS = 32
LEVELS = "tenant_id string, level long, last long"


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def admit(df: DataFrame, capacity: int, per_second: float = 0.0, refill: str = "none", levels: DataFrame | None = None) -> DataFrame:
    """df with `admitted`.

    none: the first `capacity` events of a tenant, no refill. The first ones of each part of a tenant are found
    apart, the last admitted one among these, and events are compared with it: no task ranks a tenant. continuous: a
    bucket of `capacity` tokens, refilled by elapsed time; a rejected event takes nothing, so the level is a fold over
    the tenant's events in order. Three columns are sorted by tenant and time and folded as they stream by, in constant
    memory whatever a tenant's size."""
    if refill == "none":
        cut = _last_admitted(df, capacity, levels).select(F.col("tenant_id").alias("_t"), "_cut")
        marked = df.join(cut, _same("tenant_id", "_t"), "left")
        return marked.withColumn("admitted", F.coalesce(F.struct("timestamp", "event_id") <= F.col("_cut"), F.lit(False))).drop("_t", "_cut")
    flags = _folded(df, capacity, per_second, levels).select(F.col("tenant_id").alias("_t"), F.col("event_id").alias("_i"), "admitted")
    return df.join(flags, _same("tenant_id", "_t") & (F.col("event_id") == F.col("_i"))).drop("_t", "_i")


def after(df: DataFrame, capacity: int, per_second: float = 0.0, refill: str = "none", levels: DataFrame | None = None) -> DataFrame:
    """What admitting df leaves in the buckets, those of tenants without events too."""
    if refill == "none":
        taken = admit(df, capacity, levels=levels).filter("admitted").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("_n"))
        now = _with_levels(taken, capacity, levels).select("tenant_id", (F.col("level") - F.col("_n") * TOKEN).alias("level"), "last")
    else:
        now = _folded(df, capacity, per_second, levels).groupBy("tenant_id").agg(F.max_by(F.struct("level", "last"), "nth").alias("x")).select("tenant_id", "x.*")
    if levels is None:
        return now
    gone = now.select(F.col("tenant_id").alias("_t"))
    return levels.join(gone, _same("tenant_id", "_t"), "left_anti").unionByName(now)


def _with_levels(df: DataFrame, capacity: int, levels: DataFrame | None) -> DataFrame:
    full, never = F.lit(capacity * TOKEN).cast("long"), F.lit(None).cast("long")
    if levels is None:
        return df.withColumn("level", full).withColumn("last", never)
    known = levels.select(F.col("tenant_id").alias("_t"), "level", "last")
    return df.join(known, _same("tenant_id", "_t"), "left").drop("_t").withColumn("level", F.coalesce("level", full))


def _last_admitted(df: DataFrame, capacity: int, levels: DataFrame | None) -> DataFrame:
    """tenant_id and _cut: (timestamp, event_id) of the last event that a bucket without refill admits."""
    thin = df.select("tenant_id", "timestamp", "event_id", F.pmod(F.xxhash64("event_id"), F.lit(PARTS)).alias("_part"))
    order = ("timestamp", "event_id")
    first = thin.withColumn("_n", F.row_number().over(W.partitionBy("tenant_id", "_part").orderBy(*order))).filter(F.col("_n") <= capacity)
    ranked = _with_levels(first.withColumn("_n", F.row_number().over(W.partitionBy("tenant_id").orderBy(*order))), capacity, levels)
    return ranked.filter(F.col("_n") * TOKEN <= F.col("level")).groupBy("tenant_id").agg(F.max(F.struct(*order)).alias("_cut"))


def _folded(df: DataFrame, capacity: int, per_second: float, levels: DataFrame | None) -> DataFrame:
    """tenant_id, event_id, admitted, level and last after it, nth: its place among the tenant's events."""
    rate, full = int(per_second), capacity * TOKEN

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant, level, last, n = object(), full, None, 0
        for b in batches:
            out = ([], [], [], [])
            for t, us, level0, last0 in zip(*(b.column(c).to_pylist() for c in ("tenant_id", "us", "level", "last"))):
                if t != tenant:
                    tenant, level, last, n = t, level0, us if last0 is None else last0, 0
                if us > last:
                    level, last = min(full, level + (us - last) * rate), us
                yes = level >= TOKEN
                level, n = level - TOKEN * yes, n + 1
                for o, x in zip(out, (yes, level, last, n)):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([b.column("tenant_id"), b.column("event_id"), pa.array(out[0], pa.bool_()), *(pa.array(o, pa.int64()) for o in out[1:])], names=["tenant_id", "event_id", "admitted", "level", "last", "nth"])

    thin = _with_levels(df.select("tenant_id", "event_id", F.coalesce(F.unix_micros("timestamp"), F.lit(0)).alias("us")), capacity, levels)
    return thin.repartition("tenant_id").sortWithinPartitions("tenant_id", "us", "event_id").mapInArrow(fold, "tenant_id string, event_id long, admitted boolean, level long, last long, nth long")


def concurrency_at(intervals: DataFrame) -> DataFrame:
    """intervals(tenant_id, event_id, begin, end) with `in_flight`: how many of the tenant's intervals
    are open when one begins, itself included; an end at the same time comes first."""
    marks = intervals.select("tenant_id", "event_id", F.explode(F.array(F.struct(F.col("begin").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")))).alias("m")).select("tenant_id", "event_id", "m.*")
    open_now = F.sum("step").over(W.partitionBy("tenant_id").orderBy("at", "step", "event_id").rowsBetween(W.unboundedPreceding, 0))
    begun = marks.withColumn("in_flight", open_now).filter("step = 1").select("tenant_id", "event_id", "in_flight")
    return intervals.join(begun, ["tenant_id", "event_id"])


def cap(intervals: DataFrame, max_concurrent: int) -> DataFrame:
    """intervals(tenant_id, event_id, begin, end: long) with `admitted`: whether fewer than max_concurrent of the
    tenant's admitted intervals are open when one begins (an end at the same time comes first). A rejected one is never
    open, so this is a fold too; it holds max_concurrent ends."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant, ends = object(), []
        for b in batches:
            out = []
            for t, begin, end in zip(*(b.column(c).to_pylist() for c in ("tenant_id", "begin", "end"))):
                if t != tenant:
                    tenant, ends = t, []
                while ends and ends[0] <= begin:
                    heapq.heappop(ends)
                out.append(len(ends) < max_concurrent)
                if out[-1]:
                    heapq.heappush(ends, end)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], names=[*b.schema.names, "admitted"])

    thin = intervals.select("tenant_id", "event_id", "begin", "end")
    return thin.repartition("tenant_id").sortWithinPartitions("tenant_id", "begin", "event_id").mapInArrow(fold, ", ".join(f"`{n}` {t}" for n, t in thin.dtypes) + ", admitted boolean")
