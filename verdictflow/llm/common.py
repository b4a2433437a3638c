"""What the operators share: durable intermediate tables, Arrow mapping and text helpers."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Repository root, put on the Python path of the workers when the driver was started elsewhere.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Bytes of an Arrow batch, where the session doesn't say: a batch is otherwise 10,000 texts of any length.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

_written: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark so any store works."""
    worker_path(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_path(spark: SparkSession) -> None:
    """Let Python workers import this package even if only the driver's sys.path has it, and get whole texts in
    batches of bounded size."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (have, ROOT) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. In local mode an own one where
    unset; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="verdictflow-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut by files that outlive any
    executor, and values such as row numbers are frozen. Removed when the driver exits."""
    spark = df.sparkSession
    worker_path(spark)
    path = f"{shared_dir(spark)}/verdictflow-{uuid.uuid4().hex}/{label}"
    with _shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    _remember(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, key: str, bytes_each: int = 4 << 20) -> DataFrame:
    """materialize() in buckets of key, which a later join on key needn't shuffle. The number of buckets follows
    the plan's estimate of df's size, but Spark would shuffle fewer than it has shuffle partitions all the same. A task
    that holds one value of key writes one file."""
    spark = df.sparkSession
    worker_path(spark)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if size < 1 << 55:  # more is not known
        n = max(n, min(65_536, -(-size // bytes_each)))
    name = f"verdictflow_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/verdictflow-{uuid.uuid4().hex}/{label}"
    with _shuffles_removed(spark):
        df.write.option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(name)
    _remember(spark, path)
    _tables.append((spark, name))
    return spark.table(name)


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession):
    """Within, a query's shuffle files go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _remember(spark: SparkSession, path: str) -> None:
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))


def _remove_written() -> None:
    for spark, name in _tables:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # the JVM may already be gone; its catalog then too
            break
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path).getParent()
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may already be gone; the files are only leftovers then
            return


def arrow_map(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]]) -> DataFrame:
    """mapInArrow with per-task state: make() runs once a task and gives a function from a batch to
    column dicts. Batches without rows are skipped."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    worker_path(df.sparkSession)
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                for columns in step(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else columns[f.name].cast(f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings, null as the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts of ASCII alone take the cheap built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def partitions_for(df_rows: int, per_partition: int, least: int = 1) -> int:
    return max(least, -(-df_rows // per_partition))


#: Characters that str.split() takes as white space beyond blank and \x09-\x0D.
_ODD_SPACE = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x3001) if chr(c).isspace() and c != 32 and not 9 <= c <= 13) + "]")
_WORD = re.compile("[^\x20\x09-\x0d]+")


def words_of(text: str) -> list[str]:
    """Maximal runs of characters other than blank and \\x09-\\x0D."""
    return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()
