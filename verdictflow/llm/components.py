"""Connected components of a link table by alternating star contraction, with every round's links
written to the shared folder. Nothing is gathered on the driver but two counts a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One contraction over directed links (a, b), a > b.

    large: every node sends its larger neighbours to the least of its neighbours and itself.
    small: every node sends its smaller neighbours and itself to the least of them.
    The least is an aggregate with a map side; nodes and neighbours are joined, not gathered, so a hub
    of any degree is a skewed join key at most."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    sent = both.join(least, "a")
    out = sent.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else sent.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root: the least node reachable) for every node of links(a, b) that is not its own root.

    Self links and repeated links don't matter; no links give no rows. The rounds grow with the
    logarithm of the longest chain."""
    now = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    last = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if not mark["n"] or mark == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = mark
        now = materialize(_stars(_stars(now, large=True), large=False), "links")
