"""SimHash near-duplicates by tiled exact comparison.

Distinct 64-bit fingerprints are compared with numpy exclusive-or and bit counts, tile by tile; tile
pairs whose population counts differ beyond the radius are skipped. Which fingerprints share a tile
is decided by pigeonhole: of two fingerprints at most 3 bits apart, one of the four 16-bit blocks is
equal, and of the other 48 bits one of four 12-bit parts is equal too. So comparing within the 16
tables of (block, part) values, 28 bits each, loses no link, and a tile of a table holds few rows
that are not near.

Defined results: a null or empty text, or one without words, has fingerprint zero and is linked like
any other; equal fingerprints are one node, so a text copied any number of times is one row before
comparison; null ids count as larger than any id; rows with the same id are each given; extra columns
are ignored by `near_duplicates` and kept by `deduplicate`; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize, table, texts_of, words_of, worker_path
from .components import components

RADIUS, SEED, SHINGLE = 3, 42, 3
#: Rows of a tile: two tiles' exclusive-or is 8 MB.
TILE = 1024
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes, repeats included."""
    import xxhash

    words = words_of(text.encode("utf-8", "replace").translate(_LOWER).decode())
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    shingles = map(" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [" ".join(words)]
    hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    n, total = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        total += np.unpackbits(hashes[at : at + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp as a signed long) for every row; a narrow map."""

    def make():
        def step(batch):
            found = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64)
            yield {"doc_id": batch.column("doc_id"), "fp": pa.array(found.view(np.int64))}

        return step

    kind = dict(docs.dtypes)[id_col]
    return arrow_map(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), f"doc_id {kind}, fp long", make)


def tables(fps: DataFrame) -> DataFrame:
    """fps(fp) sixteen times: key is the number of the table and its 28 bits."""
    keys = []
    for block in range(4):
        rest = [b for b in range(4) if b != block]
        own = F.shiftrightunsigned("fp", 16 * block).bitwiseAND(F.lit(0xFFFF))
        # the other 48 bits in the order of their blocks, low bits first
        left = F.lit(0).cast("long")
        for i, b in enumerate(rest):
            left = left.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", 16 * b).bitwiseAND(F.lit(0xFFFF)), 16 * i))
        for part in range(4):
            bits = F.shiftrightunsigned(left, 12 * part).bitwiseAND(F.lit(0xFFF))
            keys.append(F.shiftleft(own, 12).bitwiseOR(bits).bitwiseOR(F.lit((4 * block + part) << 28)))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def tile_links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join what is joined by pairs within RADIUS among fp, at most one less than
    its rows: the exact comparison of every tile pair that population counts leave."""
    if len(fp) == 2:
        near = np.bitwise_count(fp[:1] ^ fp[1:]) <= RADIUS
        return fp[:1][near], fp[1:][near]
    fp = fp[np.argsort(np.bitwise_count(fp), kind="stable")]
    ones = np.bitwise_count(fp).astype(np.int64)
    label = np.arange(len(fp))
    out: list[tuple[int, int]] = []
    for i in range(0, len(fp), TILE):
        a = fp[i : i + TILE]
        top = ones[min(i + TILE, len(fp)) - 1]
        for j in range(i, len(fp), TILE):
            if ones[j] - top > RADIUS:
                break  # sorted by population count: so are all further tiles
            near = np.bitwise_count(a[:, None] ^ fp[None, j : j + TILE]) <= RADIUS
            for p in np.flatnonzero(near.any(axis=1)).tolist():
                q = np.flatnonzero(near[p]) + j
                other, first = np.unique(label[q], return_index=True)
                for s, at in zip(other.tolist(), first.tolist()):
                    if s != label[i + p]:
                        out.append((i + p, int(q[at])))
                        label[label == s] = label[i + p]
    if not out:
        return fp[:0], fp[:0]
    found = np.array(out)
    return fp[found[:, 0]], fp[found[:, 1]]


#: Rows of one table value that a task compares at once; more are split into tile pairs.
HOT_ROWS = 4 * TILE


def links(fps: DataFrame) -> DataFrame:
    """Links(a, b: signed fingerprints) among the distinct fps(fp) that join exactly what pairs at most
    RADIUS bits apart join."""
    keyed = materialize(tables(fps), "tables")
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    some = keyed.join(counts, "key")  # most values occur once and end here
    few, hot = some.filter(F.col("n") <= HOT_ROWS), some.filter(F.col("n") > HOT_ROWS)
    # a hot value's rows are dealt to tiles by hash, and every pair of its tiles is a task of its own
    tiles = F.ceil(F.col("n") / HOT_ROWS).cast("int")
    hot = hot.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    hot = hot.select("fp", "key", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"))
    work = few.select("fp", "key", F.lit(0).alias("x"), F.lit(0).alias("y")).unionByName(hot)
    cell = F.struct("key", "x", "y")
    dealt = work.select("fp", F.xxhash64(cell).alias("cell"), "key", "x", "y")
    dealt = dealt.repartition("cell").sortWithinPartitions("cell", "key", "x", "y")
    worker_path(fps.sparkSession)
    return dealt.mapInArrow(_compare, "a long, b long").distinct()


def _compare(batches):
    """Runs of equal (key, x, y) in sorted rows; a run may go on in the next batch."""
    target = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[np.ndarray] = []
    last = None

    def flush():
        fp = np.concatenate(held)
        a, b = tile_links(fp.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=target)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        fp, *keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "key", "x", "y"))
        new = np.zeros(n, bool)
        new[0] = (keys[0][0], keys[1][0], keys[2][0]) != last
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        edges = [*np.flatnonzero(new).tolist(), n]
        if edges[0]:
            held.append(fp[: edges[0]])
        if edges[0] == n:
            continue
        for start, end in zip(edges, edges[1:]):
            if held and sum(map(len, held)) > 1:
                yield flush()
            held = [fp[start:end]]
        last = (keys[0][-1], keys[1][-1], keys[2][-1])
    if held and sum(map(len, held)) > 1:
        yield flush()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the least id reached
    through links, itself included)."""
    fp = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    return _resolved(fp).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _resolved(fp: DataFrame) -> DataFrame:
    """fp (with doc_id, fp) with root and component_id."""
    nodes = materialize(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    joined = components(links(nodes.select("fp")))
    rooted = nodes.join(joined, nodes.fp == joined.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = materialize(rooted.join(least, "root").select("fp", "root", "component_id"), "components")
    # a hot fingerprint makes a key hot on the left side alone, which the adaptive skew join splits
    return fp.join(known, "fp", "left")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, that of the least id; same columns."""
    held = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "documents")
    known = _resolved(materialize(_row_prints(held, id_col, text_col), "fingerprints"))
    # of rows with the same id the first one stays; written, so that the join below may split a large
    # component's rows, which it could not behind the aggregate's own exchange
    best = materialize(known.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")), "first")
    gone = known.join(best, "root").filter("row != first.row").select("row")
    return held.join(gone, "row", "left_anti").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def _row_prints(held: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def make():
        def step(batch):
            found = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64)
            yield {"doc_id": batch.column("doc_id"), "row": batch.column("row"), "fp": pa.array(found.view(np.int64))}

        return step

    src = held.select(F.col("doc").getField(id_col).alias("doc_id"), F.col("doc").getField(text_col).alias("text"), "row")
    return arrow_map(src, f"doc_id {dict(src.dtypes)['doc_id']}, row long, fp long", make)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
