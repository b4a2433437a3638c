"""Packing documents into sequences: dominance reduction, then best fit.

Sizes are whole tokens up to the capacity, so the instance is a table of counts by size, whatever the
corpus: tokens are encoded once on the workers, counts of sizes per partition meet in at most
capacity rows, and the driver solves that. Where a small set of sizes with the largest one provably
dominates every other feasible set (Martello and Toth), its bins are fixed; what is left is packed
best-fit decreasing. Both steps work on counts, a step uses up a size or a kind of bin, so a plan has
at most a few thousand kinds of bins. Pieces then find their bin by their rank among pieces of
their size: rank within the partition plus the partitions before it. The pieces are written in buckets
of their partition, so the join that adds these shuffles a row per partition and no piece.

Defined results: a null or empty text is its end token alone; only longer documents are cut, from the
end backwards, so the first piece takes the rest; repeated rows and ids are packed row by row; extra
columns are ignored; an empty table gives an empty table. Which of several pieces of one size takes
which place follows the partitions' order and does not change the number of sequences.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .byte_bpe import END, encoder
from .common import bucketed, materialize, table, texts_of, worker_path

CAPACITY = 1024


@dataclass
class Bins:
    """count bins that all hold the same sizes: (size, how many), in the order they were put in."""

    count: int
    sizes: list[tuple[int, int]]
    room: int


class Sizes:
    """Counts by size with the smallest and largest sizes at hand."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: int(c) for s, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, s: int, c: int) -> None:
        self.n[s] -= c
        if not self.n[s]:
            del self.n[s]
            self.order.remove(s)

    def largest(self, room: int) -> int | None:
        i = bisect.bisect_right(self.order, room)
        return self.order[i - 1] if i else None

    def smallest_sum(self, k: int) -> int | None:
        """The sum of the k smallest items, None if there are fewer."""
        total = 0
        for s in self.order:
            c = min(k, self.n[s])
            total, k = total + c * s, k - c
            if not k:
                return total
        return None

    def largest_pair(self, room: int) -> tuple[int, int] | None:
        """Of the pairs that fit in room: the one whose larger item is largest, then its smaller."""
        for a in reversed(self.order[: bisect.bisect_right(self.order, room)]):
            i = bisect.bisect_right(self.order, min(a, room - a))
            for b in reversed(self.order[:i]):
                if b != a or self.n[a] > 1:
                    return a, b
        return None

    def largest_lower(self, room: int) -> int:
        """The largest size that can be the smaller item of a pair within room; 0 if no pair fits."""
        for b in reversed(self.order[: bisect.bisect_right(self.order, room // 2)]):
            if self.n[b] > 1 or (a := self.largest(room - b)) and a > b:
                return b
        return 0


def reduce_sizes(sizes: Sizes, capacity: int = CAPACITY) -> list[Bins]:
    """Fix the bins that dominance proves to be in some optimal packing, largest sizes first.

    For the largest size j with room r = capacity - j, and k the largest size that fits in r:
    nothing fits - {j} dominates; k fills r - {j, k}; no two items fit - {j, k}; no three items fit
    and k is at least the larger sum of any pair - {j, k}; no three fit and the pair (a, b) with the
    largest a is such that no pair within r has a smaller item above b - {j, a, b}. Each set
    dominates every feasible set with j, as its members can be swapped in for those of the other."""
    fixed: list[Bins] = []
    for j in sorted(sizes.n, reverse=True):
        while j in sizes.n:
            sizes.take(j, 1)  # one j is looked at; its likes follow in the same step
            left, r = sizes.n.get(j, 0), capacity - j
            k = sizes.largest(r)
            two, three = sizes.smallest_sum(2), sizes.smallest_sum(3)
            if k is None:
                chosen = ()
            elif k == r or two is None or two > r:
                chosen = (k,)
            elif three is None or three > r:
                a, b = sizes.largest_pair(r)
                if k >= 2 * sizes.largest_lower(r) and k >= _best_pair(sizes, r):
                    chosen = (k,)
                elif sizes.largest_lower(r) <= b:
                    chosen = (a, b)
                else:
                    chosen = None
            else:
                chosen = None
            if chosen is None:
                sizes.n[j] = left + 1
                if not left:
                    bisect.insort(sizes.order, j)
                break
            need: dict[int, int] = {}
            for s in (j, *chosen):
                need[s] = need.get(s, 0) + 1
            # as often as the same choice stays valid: while all its sizes last; the sums above only grow
            have = {s: sizes.n.get(s, 0) + (s == j) for s in need}
            times = max(1, min(have[s] // need[s] for s in need))
            for s, c in need.items():
                sizes_taken = c * times - (s == j)
                if sizes_taken:
                    sizes.take(s, sizes_taken)
            fixed.append(Bins(times, [(s, need[s]) for s in need], capacity - sum(s * c for s, c in need.items())))
    return fixed


def _best_pair(sizes: Sizes, room: int) -> int:
    """The largest sum of two items within room."""
    best = 0
    for a in sizes.order[: bisect.bisect_right(sizes.order, room)]:
        i = bisect.bisect_right(sizes.order, min(a, room - a))
        for b in reversed(sizes.order[:i]):
            if b != a or sizes.n[a] > 1:
                best = max(best, a + b)
                break
    return best


def best_fit(sizes: Sizes, open_bins: list[Bins], capacity: int = CAPACITY) -> list[Bins]:
    """Best-fit decreasing over counts, into open_bins and new ones."""
    by_room: dict[int, list[Bins]] = {}
    rooms: list[int] = []

    def put(b: Bins) -> None:
        if b.room not in by_room:
            by_room[b.room] = []
            bisect.insort(rooms, b.room)
        by_room[b.room].append(b)

    for b in open_bins:
        put(b)
    for s in sorted(sizes.n, reverse=True):
        left = sizes.n[s]
        while left:
            i = bisect.bisect_left(rooms, s)
            if i == len(rooms):
                # full bins of this size at once, and one for what remains
                each = capacity // s
                if left >= each:
                    put(Bins(left // each, [(s, each)], capacity - each * s))
                if left % each:
                    put(Bins(1, [(s, left % each)], capacity - left % each * s))
                break
            room = rooms[i]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(i)
            each = min(room // s, left)
            times = min(b.count, left // each)
            if times < b.count:
                put(Bins(b.count - times, b.sizes, b.room))
            put(Bins(times, [*b.sizes, (s, each)], room - each * s))
            left -= times * each
    return [b for x in by_room.values() for b in x]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    """Bins for so many items of each size."""
    sizes = Sizes(counts)
    fixed = reduce_sizes(sizes, capacity)
    return best_fit(sizes, fixed, capacity)


@dataclass
class Places:
    """The plan turned round: for each size, runs of ranks and the places they take."""

    first: dict[int, np.ndarray]  # size -> first rank of each run, ascending
    runs: dict[int, np.ndarray]  # size -> rows of (first rank, per bin, first sequence, offset)

    @classmethod
    def of(cls, bins: list[Bins]) -> Places:
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        sequence = 0
        for b in bins:
            offset = 0
            for s, each in b.sizes:
                runs.setdefault(s, []).append((used.get(s, 0), each, sequence, offset))
                used[s] = used.get(s, 0) + each * b.count
                offset += s * each
            sequence += b.count
        table = {s: np.array(x, np.int64) for s, x in runs.items()}
        return cls({s: x[:, 0].copy() for s, x in table.items()}, table)

    def at(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence_id and offset of the rank-th piece of each size."""
        sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        for s in np.unique(size).tolist():
            own = np.flatnonzero(size == s)
            r = rank[own]
            run = self.runs[s][np.searchsorted(self.first[s], r, "right") - 1]
            nth = r - run[:, 0]
            sequence[own], offset[own] = run[:, 2] + nth // run[:, 1], run[:, 3] + nth % run[:, 1] * s
        return sequence, offset


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids, if asked for), part and
    nth: the partition and how many pieces of this length came before it there."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * keep_ids

    def run(batches):
        from pyspark import TaskContext

        encode, part, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64).tolist()
        for batch in batches:
            ids, number, start, length, crc, nth, held = [], [], [], [], [], [], []
            owners = batch.column("doc_id")
            for i, text in enumerate(texts_of(batch)):
                data = encode(text) + END
                n = len(data) // 4
                at, k = 0, 0
                while at < n:
                    size = (n % capacity or capacity) if not at else capacity
                    own = data[4 * at : 4 * (at + size)]
                    ids.append(i), number.append(k), start.append(at), length.append(size), crc.append(zlib.crc32(own)), nth.append(seen[size])
                    if keep_ids:
                        held.append(own)
                    seen[size] += 1
                    at, k = at + size, k + 1
            if ids:
                yield pa.RecordBatch.from_arrays([owners.take(pa.array(ids)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array(nth, pa.int64()), *([pa.array(held, pa.binary())] * keep_ids)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * keep_ids])

    worker_path(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset; the ids as little-endian binary if asked for."""
    spark = docs.sparkSession
    # in buckets of the partition: the ids stay where they are written, and only the bases below are shuffled
    held = bucketed(pieces(docs, path, capacity, id_col, text_col, keep_ids), "pieces", "part")
    # a row for each partition and size, whatever the number of documents
    by_part = materialize(held.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    places = spark.sparkContext.broadcast(Places.of(plan(counts, capacity)))  # bounded by the capacity squared, see the module's docstring
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # one row a partition, its bases by size: joined on the partition alone
    bases = bases.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "base"))).alias("base"))
    bases = bases.select("part", F.transform(F.sequence(F.lit(0), F.lit(capacity)), lambda s: F.col("base")[s.cast("long")]).alias("base"))
    ranked = held.join(bases.hint("shuffle_hash"), "part").withColumn("rank", F.col("nth") + F.get("base", F.col("length").cast("int"))).drop("part", "nth", "base")
    schema = ", ".join(f"{n} {t}" for n, t in ranked.dtypes if n != "rank") + ", sequence_id long, offset long"
    order = [n for n, _ in ranked.dtypes if n != "rank"]

    def run(batches):
        for b in batches:
            if b.num_rows:
                sequence, offset = places.value.at(b.column("length").to_numpy(zero_copy_only=False), b.column("rank").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in order), pa.array(sequence), pa.array(offset)], names=[*order, "sequence_id", "offset"])

    out = ranked.mapInArrow(run, schema)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
