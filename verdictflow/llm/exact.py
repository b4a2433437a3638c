"""Exact deduplication of a batch against an immutable snapshot.

A snapshot keeps one row per distinct digest in hash buckets and one binary fuse filter a bucket.
An incoming batch is grouped by digest first, so a text copied a million times is one row after the
map side; its distinct digests meet their bucket's filter, and only positives join the snapshot's
exact buckets, where the bytes are compared. Negatives are new and stay grouped among themselves.

Defined results: texts are equal when they are identical after lower-casing A-Z only; a null text is
the empty text; of equal texts the row with the largest id stays (null ids count as least, and of
rows with the same id one stays); an empty table gives an empty table; extra columns are carried by
`deduplicate` and ignored by `groups`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fuse
from .common import ascii_lower, materialize, partitions_for, table

#: Distinct digests of one bucket: what one task holds of a filter's keys.
BUCKET_KEYS = 200_000


def staged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The batch frozen in the shared folder: doc (all columns), row (unique), id, digest, part.

    part 0 is the snapshot and part 1 the incoming batch when one table plays both roles: they are
    told apart by the id's checksum, so a snapshot's share grows with the input."""
    doc = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    text = F.coalesce(F.col("doc").getField(text_col), F.lit(""))
    own = F.col("doc").getField(id_col)
    return materialize(
        doc.select(
            "doc",
            F.monotonically_increasing_id().alias("row"),
            own.alias("id"),
            F.unhex(F.sha2(ascii_lower(text), 256)).alias("digest"),
            (F.coalesce(F.crc32(own.cast("string")), F.lit(0)) % 2).cast("int").alias("part"),
        ),
        "batch",
    )


def _bucket(n: int):
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int").alias("bucket")


def _grouped(batch: DataFrame, buckets: int) -> DataFrame:
    return batch.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("keep"), F.count(F.lit(1)).alias("n")).withColumn("bucket", _bucket(buckets))


_KEY = np.dtype(">u8")


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x[:8]) for x in digests), _KEY).astype(np.uint64)


def build_filters(snapshot: DataFrame) -> DataFrame:
    """One row (bucket, filter) for each bucket of a snapshot."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": [key[0]], "filter": [fuse.build(_keys(pdf["digest"])).to_bytes()]})

    return snapshot.select("bucket", "digest").groupBy("bucket").applyInPandas(one, "bucket int, filter binary")


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """The digests of incoming (distinct ones) that the filters let through."""

    def one(key: tuple, digests: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(digests):
            return pd.DataFrame({"digest": []}, dtype=object)
        hit = fuse.FuseFilter.from_bytes(bytes(own["filter"].iloc[0])).has(_keys(digests["digest"]))
        return pd.DataFrame({"digest": digests["digest"][hit]})

    return incoming.select("bucket", "digest").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(one, "digest binary")


def _same_bytes(batch: DataFrame, pairs: DataFrame, text_col: str) -> DataFrame:
    """The digests among pairs(digest, a, b: rows) whose two rows' texts are the same bytes."""
    rows = pairs.select("digest", F.explode(F.array("a", "b")).alias("row"))
    text = ascii_lower(F.coalesce(F.col("doc").getField(text_col), F.lit("")))
    # rows is small beside the batch or the join shuffles the texts once; a digest has two rows
    return batch.select("row", text.alias("text")).join(rows, "row").groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).filter("a = b").select("digest")


def groups(batch: DataFrame, text_col: str = "text") -> DataFrame:
    """Of a staged batch: (digest, part, keep: struct of id and row, n) for each group of equal texts
    and part it occurs in. Part 0 is the snapshot, part 1 the incoming batch."""
    rows = batch.count()
    buckets = partitions_for(rows, BUCKET_KEYS, 16)
    snapshot = materialize(_grouped(batch.filter("part = 0"), buckets), "snapshot")
    incoming = materialize(_grouped(batch.filter("part = 1"), buckets), "incoming")
    filters = materialize(build_filters(snapshot), "filters")
    positive = screen(incoming, filters)
    pairs = incoming.join(positive, "digest", "left_semi").select("digest", F.col("keep.row").alias("a")).join(snapshot.select("digest", F.col("keep.row").alias("b")), "digest")
    same = _same_bytes(batch, pairs, text_col).withColumn("same", F.lit(True))
    own = snapshot.withColumn("part", F.lit(0)).unionByName(incoming.withColumn("part", F.lit(1))).drop("bucket")
    own = own.join(same, "digest", "left").withColumn("side", F.when(F.col("same"), 0).otherwise(F.col("part")))
    met = own.groupBy("digest", "side").agg(F.max("keep").alias("keep"), F.sum("n").alias("n"), F.collect_set("part").alias("parts"))
    return materialize(met.select("digest", F.explode("parts").alias("part"), "keep", "n"), "groups")


def dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    batch = staged(docs, id_col, text_col)
    met = groups(batch, text_col)
    # a hot group makes one key hot on the left side alone, which the adaptive skew join splits
    out = batch.select("id", "row", "digest", "part").join(met, ["digest", "part"])
    return out.select(F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("keep.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with the columns of docs."""
    batch = staged(docs, id_col, text_col)
    met = groups(batch, text_col).filter("n > 1")
    gone = batch.select("row", "digest", "part").join(met, ["digest", "part"]).filter("row != keep.row").select("row")
    return batch.join(gone, "row", "left_anti").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_rows(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, r) = 1 AS kept, sha256(t) AS text_sha256
FROM d"""
