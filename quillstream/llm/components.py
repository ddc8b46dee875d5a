"""Connected components over links of any number, without a driver-side collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import dropped, written


def _with_least(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links with m, the least b of their a, and the table of these.

    The least ones are a table of their own, so that the join has exchanges of its own, of which adaptive execution
    splits those that the centre of a large star fills.
    """
    least = written(links.groupBy("a").agg(F.min("b").alias("m")), "least")
    return links.join(least, "a"), least


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    moved, least = _with_least(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    out = written(moved.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct(), "links")
    dropped(least)
    return out


def _small_star(links: DataFrame) -> DataFrame:
    """A node (column a) and its smaller neighbours are linked to the least of them."""
    moved, least = _with_least(links)
    pairs = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
    out = written(moved.select(F.inline(pairs)).where("a <> b").distinct(), "links")
    dropped(least)
    return out


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node but the roots themselves.

    links: columns a and b of one ordered type.  Alternating stars: the rounds follow the logarithm of a
    component's size; each round's links are written in the shared folder, and those of the round before removed.
    """
    tidy = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, seen = written(tidy, "links"), None
    while True:
        large = _large_star(now)
        dropped(now)
        now = _small_star(large)
        dropped(large)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
