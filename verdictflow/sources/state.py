"""Window state: snapshots on shared storage in two tiers, merged, expired, archived and summed."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import StoreError
from ..schema import STATE_STORE_UNAVAILABLE, WINDOW_KEY, WINDOW_STATE


_JOURNAL = "aside string, epochs array<long>"


def merge_latest(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by key, unconditionally: new rows replace existing ones."""
    return existing.join(new.select(*WINDOW_KEY), WINDOW_KEY, "left_anti").unionByName(new)


def expire(state: DataFrame, keys: DataFrame) -> DataFrame:
    """state without keys."""
    return state.join(keys.select(*WINDOW_KEY).distinct(), WINDOW_KEY, "left_anti")


def apply_changes(existing: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: window state plus `seq` and `deleted`; of each key the last change counts, so a key that
    was expired and made anew stays."""
    last = changes.groupBy(*WINDOW_KEY).agg(F.max(F.struct("seq", "deleted", "aggregate", "version")).alias("c"))
    new = last.filter("not c.deleted").select(*WINDOW_KEY, "c.aggregate", "c.version")
    return existing.join(last.select(*WINDOW_KEY), WINDOW_KEY, "left_anti").unionByName(new)


def lookup(state: DataFrame, tenant: str, entity: str, window_name: str, epoch: int) -> tuple[float, int]:
    """(aggregate, version) of one key; (0.0, 0) where there is none."""
    row = state.filter((F.col("tenant_id") == tenant) & (F.col("entity_id") == entity) & (F.col("window_name") == window_name) & (F.col("epoch") == epoch)).select("aggregate", "version").first()
    return (row["aggregate"], row["version"]) if row else (0.0, 0)


def range_sum(state: DataFrame, start: int, end: int, *by: str) -> DataFrame:
    """Sums of aggregates over epochs start..end by key columns (default: tenant, entity, window)."""
    by = by or ("tenant_id", "entity_id", "window_name")
    return state.filter(F.col("epoch").between(start, end)).groupBy(*by).agg(F.coalesce(F.sum("aggregate"), F.lit(0.0)).alias("total"))


@dataclass
class Snapshot:
    """A warm tier (one directory, partitioned by epoch) and a cold one of archived epochs, for one writer at a time.

    Each write of an epoch replaces that epoch's partition as a whole, so writing again is harmless and
    archiving a late epoch merges with what is there."""

    spark: SparkSession
    path: str

    def _read(self, tier: str) -> DataFrame:
        try:
            return self.spark.read.schema(WINDOW_STATE).parquet(f"{self.path}/{tier}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], WINDOW_STATE)
            raise StoreError("Unavailable", str(e)[:300]) from e

    def warm(self) -> DataFrame:
        return self._read("warm")

    def cold(self) -> DataFrame:
        return self._read("cold")

    def _aside(self, df: DataFrame) -> str:
        """Rows written to a folder of their own: a plan may read the files that it is to replace."""
        path = f"{self.path}/_aside-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _replace(self, aside: str, tier: str) -> None:
        rows = self.spark.read.schema(WINDOW_STATE).parquet(aside)
        rows.repartition("epoch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(f"{self.path}/{tier}")

    def _write(self, df: DataFrame, tier: str) -> None:
        aside = self._aside(df)
        self._replace(aside, tier)
        self._delete(aside)

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def upsert(self, new: DataFrame) -> None:
        """new replaces rows of the same key; only epochs that new touches are rewritten."""
        epochs = new.select("epoch").distinct()
        self._write(merge_latest(self.warm().join(epochs, "epoch", "left_semi"), new.select(*[f.name for f in WINDOW_STATE.fields])), "warm")

    def delete(self, keys: DataFrame) -> None:
        epochs = [r["epoch"] for r in keys.select("epoch").distinct().collect()]  # epochs, not keys: few
        left = expire(self.warm().filter(F.col("epoch").isin(epochs)), keys)
        gone = set(epochs) - {r["epoch"] for r in left.select("epoch").distinct().collect()}
        self._write(left, "warm")
        for e in gone:
            self._drop("warm", e)

    def _drop(self, tier: str, epoch: int) -> None:
        self._delete(f"{self.path}/{tier}/epoch={epoch}")

    def archive(self, before: int) -> list[int]:
        """Move epochs under `before` to the cold tier; an archived epoch that got late rows is merged.
        The merged rows and then a journal that names them are written first. What comes after, replacing the cold
        partitions and dropping the warm ones, gives the same however often it is done, so recover() ends a move that
        was broken off, and one without a journal has changed nothing. Returns the epochs."""
        self.recover()
        old = self.warm().filter(F.col("epoch") < before)
        epochs = sorted(r["epoch"] for r in old.select("epoch").distinct().collect())
        if epochs:
            there = self.cold().filter(F.col("epoch").isin(epochs))
            both = there.unionByName(old).groupBy(*WINDOW_KEY).agg(F.sum("aggregate").alias("aggregate"), F.sum("version").alias("version"))
            aside = self._aside(both)
            self.spark.createDataFrame([(aside, epochs)], _JOURNAL).coalesce(1).write.mode("overwrite").json(f"{self.path}/_journal")
            self.recover()
        return epochs

    def recover(self) -> None:
        """End a move to the cold tier that its journal says was begun."""
        fs, done = self._fs(f"{self.path}/_journal/_SUCCESS")
        if not fs.exists(done):
            return
        for r in self.spark.read.schema(_JOURNAL).json(f"{self.path}/_journal").collect():
            self._replace(r["aside"], "cold")
            for e in r["epochs"]:
                self._drop("warm", e)
            self._delete(f"{self.path}/_journal")
            self._delete(r["aside"])

    def all(self) -> DataFrame:
        """Both tiers; a key in both counts in both."""
        self.recover()
        return self.warm().unionByName(self.cold())

    def update(self, changes: DataFrame) -> DataFrame:
        """Conditional upsert of changes (window state plus `expected`): a key is written, with the version after the
        expected one, where its version is the expected one (0: no such key). Returns the changes with `applied`; of
        several changes of a key with one expected version the one with the least aggregate wins."""
        self.recover()
        first = F.row_number().over(W.partitionBy(*WINDOW_KEY, "expected").orderBy("aggregate")) == 1
        now = self.warm().select(*WINDOW_KEY, F.col("version").alias("_now"))
        marked = changes.withColumn("_first", first).join(now, WINDOW_KEY, "left").withColumn("applied", F.col("_first") & (F.coalesce("_now", F.lit(0)) == F.col("expected")))
        aside = f"{self.path}/_aside-{uuid.uuid4().hex}"
        marked.select(*WINDOW_KEY, "aggregate", "expected", "applied").write.parquet(aside)  # decided once, before anything is replaced
        marked = self.spark.read.parquet(aside)
        self.upsert(marked.filter("applied").select(*WINDOW_KEY, "aggregate", (F.col("expected") + 1).alias("version")))
        return marked

    def query_range(self, tenant: str, entity: str, window_name: str, start: int, end: int) -> float:
        own = self.all().filter((F.col("tenant_id") == tenant) & (F.col("entity_id") == entity) & (F.col("window_name") == window_name) & F.col("epoch").between(start, end))
        return own.agg(F.coalesce(F.sum("aggregate"), F.lit(0.0)).alias("s")).first()["s"]


def read_with_fallback(spark: SparkSession, path: str, fallback: DataFrame) -> tuple[DataFrame, Column]:
    """The state at path, or fallback where it cannot be read; and the degraded bit for decisions."""
    try:
        return spark.read.schema(WINDOW_STATE).parquet(path), F.lit(0)
    except Exception:  # any fault of the store is the same to its readers
        return fallback, F.lit(STATE_STORE_UNAVAILABLE)


class CasStore:
    """Compare-and-set by version in one process, for drivers and tests: a missing key is (0.0, 0)."""

    def __init__(self, on_expire=None):
        self._rows: dict[tuple, tuple[float, int]] = {}
        self._lock, self._on_expire = threading.Lock(), on_expire

    def get(self, *key) -> tuple[float, int]:
        return self._rows.get(key, (0.0, 0))

    def compare_and_set(self, key: tuple, expected_version: int, aggregate: float) -> bool:
        with self._lock:
            if self.get(*key)[1] != expected_version:
                return False
            self._rows[key] = (aggregate, expected_version + 1)
            return True

    def expire(self, *key) -> None:
        with self._lock:
            old = self._rows.pop(key, None)
        if old is not None and self._on_expire:
            self._on_expire(key, old)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(*k, *v) for k, v in self._rows.items()], WINDOW_STATE)


@dataclass
class Versions:
    """Tables that numbered batches leave in a shared folder. A batch reads what an earlier one wrote, so one that runs
    again starts from the same state and replaces its own; versions that nothing needs any more go."""

    spark: SparkSession
    path: str

    def _numbers(self, name: str) -> list[int]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        found = [(x.getPath().getName(), x.getPath()) for x in fs.listStatus(p)]
        return sorted(int(n) for n, at in found if n.isdigit() and fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")))

    def read(self, name: str, schema, batch: int) -> DataFrame | None:
        """The table that the last batch before this one left."""
        earlier = [n for n in self._numbers(name) if n < batch]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{earlier[-1]}") if earlier else None

    def write(self, name: str, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/{batch}")
        for n in [n for n in self._numbers(name) if n < batch][:-1]:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/{n}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@dataclass
class WriteBack:
    """A store in the process whose changes go to a snapshot in batches.

    Reads and compare-and-set answer from the process; a key that it doesn't hold is looked up in the snapshot once.
    flush() writes the last state of every changed key; where that fails the keys stay changed and the next flush takes
    them again. A new one over the same snapshot goes on where the last flush ended. Range queries flush first."""

    snapshot: Snapshot
    _rows: dict = field(default_factory=dict)
    _changed: set = field(default_factory=set)
    _gone: set = field(default_factory=set)
    _lock: threading.RLock = field(default_factory=threading.RLock)

    def get(self, *key) -> tuple[float, int]:
        with self._lock:
            if key not in self._rows:
                self._rows[key] = (0.0, 0) if key in self._gone else lookup(self.snapshot.warm(), *key)
            return self._rows[key]

    def compare_and_set(self, key: tuple, expected_version: int, aggregate: float) -> bool:
        with self._lock:
            if self.get(*key)[1] != expected_version:
                return False
            self._rows[key] = (aggregate, expected_version + 1)
            self._changed.add(key)
            return True

    def expire(self, *key) -> None:
        with self._lock:
            self._rows[key] = (0.0, 0)
            self._changed.discard(key)
            self._gone.add(key)

    def flush(self) -> int:
        """Writes what changed; the number of keys written or deleted."""
        with self._lock:
            gone, changed = set(self._gone), {k: self._rows[k] for k in self._changed}
        frame = lambda rows: self.snapshot.spark.createDataFrame(rows, WINDOW_STATE)
        if gone:
            self.snapshot.delete(frame([(*k, 0.0, 0) for k in gone]))
        if changed:
            self.snapshot.upsert(frame([(*k, *v) for k, v in changed.items()]))
        with self._lock:  # a key that changed meanwhile stays for the next flush
            self._gone -= gone
            self._changed -= {k for k, v in changed.items() if self._rows[k] == v}
        return len(gone) + len(changed)

    def query_range(self, tenant: str, entity: str, window_name: str, start: int, end: int) -> float:
        self.flush()
        return self.snapshot.query_range(tenant, entity, window_name, start, end)
