"""Contiguous shards of nearly equal bytes, from per-partition totals and global prefix sums.

Documents are put in the order of their ids by range partitions of thin rows (no text), each
partition takes its running sums, the totals of the partitions - one row each - are summed into
bases, and the global byte line is cut at equal targets: a document belongs to the shard in which
its first byte lies. Shards are contiguous in id order and differ from the target by less than
one document.

Defined results: a null text has no bytes and a size of 1; null ids come first; rows with the same id
are ordered by size and checksum, so repeated rows are interchangeable; an empty table gives an empty
table; extra columns are ignored by `assign` and carried by `shard_documents`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from .common import materialize, table, worker_path

SHARDS = 8
LAW = "bytes"


def _running(rows: DataFrame) -> DataFrame:
    """rows with `before` and `nth`: the sizes and rows that precede one in its partition."""
    schema = StructType([*rows.schema.fields, StructField("before", LongType()), StructField("nth", LongType())])
    target = to_arrow_schema(schema)

    def run(batches):
        size = n = 0
        for b in batches:
            s = b.column("size").to_numpy(zero_copy_only=False)
            ends = np.cumsum(s) + size
            yield pa.RecordBatch.from_arrays([*(b.column(f.name).cast(f.type) for f in list(target)[:-2]), pa.array(ends - s), pa.array(np.arange(n, n + len(s)))], schema=target)
            size, n = (int(ends[-1]) if len(s) else size), n + len(s)

    worker_path(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and row (see `thin_rows`), one row per
    document."""
    rows = thin_rows(docs, id_col, text_col)
    line = _running(rows.repartitionByRange("doc_id", "size", "text_crc32", "row").sortWithinPartitions("doc_id", "size", "text_crc32", "row"))
    line = materialize(line.withColumn("part", F.spark_partition_id()), "line")
    totals = line.groupBy("part").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    # one row per partition: their number is a setting, not the data's size, so one task may hold them
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("size_base"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_base"), F.sum("size").over(W.partitionBy()).alias("total"))
    placed = line.join(F.broadcast(bases), "part").select("doc_id", "size", "text_crc32", "row", (F.col("before") + F.col("size_base")).alias("at"), (F.col("nth") + F.col("n_base")).alias("nth"), "total")
    # exact up to an exabyte of text; beyond it ANSI arithmetic fails rather than wraps
    placed = placed.withColumn("shard", F.expr(f"cast((at * {shards}) div total as int)"))
    firsts = placed.groupBy("shard").agg(F.min("nth").alias("first"))  # a row a shard
    out = placed.join(F.broadcast(firsts), "shard")
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("nth") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row")


def thin_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What sharding needs of a document: id, size in bytes plus one, checksum, and a row number."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))


def shard_documents(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs as shard=0 .. shard=n-1 under path, each in slot order."""
    held = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "documents")
    thin = held.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), "_row")
    places = assign(thin, shards, id_col, text_col).select("row", "shard", "slot")
    # the row numbers of `thin` are those of the frozen table's scan, in which _row grows with them
    numbered = held.withColumn("row", F.monotonically_increasing_id())
    numbered.join(places, "row").drop("row", "_row").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).drop("row")


#: CRC-32 (reflected, polynomial 0xEDB88320) bit by bit: the table comes from its rule.
SQL = f"""
WITH RECURSIVE step AS (
  SELECT i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT r, doc_id, strlen(text) + 1 AS size, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM d),
s AS (SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(xor(list_reduce(bytes, lambda a, x: xor(a >> 8, crc.t[xor(a & 255, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS BIGINT) AS text_crc32 FROM b, crc),
p AS (SELECT *, sum(size) OVER o - size AS pos, sum(size) OVER () AS total FROM s WINDOW o AS (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, CAST((pos * {SHARDS}) // total AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, '{LAW}' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY pos) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM q"""
