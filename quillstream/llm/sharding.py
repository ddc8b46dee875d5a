"""Uniform shuffle into shards of exact sizes by a communication matrix (operator 2).

The rows stand in blocks.  How many rows each block sends to each shard is drawn
first, exactly as a uniform shuffle would have it: row by row of the matrix, a
multivariate hypergeometric draw from the room that the shards have left.  Each
block is permuted by itself and dealt out by its row of the matrix; the rows are
exchanged; each shard is permuted by itself.  The law is ``rows``: shards' counts differ
by one at most.

Permutations follow seeded hashes of the row, so a task that is run again gives the
same rows the same places.  A block's permutation is worked out on the hashes alone;
where it is cut for a shard is a hash, too, so that the rows themselves, texts and
all, go through one exchange, to their shards.  Only if some rows are equal in all
columns, so that no hash tells them apart, the rows meet in their blocks as well.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import written

SHARDS = 24
SEED = 20_240_229
#: Rows in a section of a shard, about, and in a block where their number allows; the least numbers of both, and the most
#: blocks, which bounds what is broadcast to MOST_BLOCKS * shards cuts.
BLOCK_ROWS, SECTION_ROWS, LEAST_BLOCKS, MOST_BLOCKS, LEAST_SECTIONS = 200_000, 50_000, 256, 4096, 16
#: A draw looks at values up to so many deviations, and LEAST_REACH, from the likeliest one: what lies beyond has less chance than
#: the last bit of a random number.
REACH, LEAST_REACH = 12, 60


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good, for any sizes: the chances follow from the likeliest value's by their ratios."""
    low, high, total = max(0, n - bad), min(good, n), good + bad
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    reach = LEAST_REACH + int(REACH * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))))
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(last - first, dtype=np.float64) + first
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    log_chance = np.concatenate([[0.0], np.cumsum(steps)])
    chance = np.cumsum(np.exp(log_chance - log_chance[mode - first]))
    return first + min(int(np.searchsorted(chance, rng.random() * chance[-1], side="right")), last - first)


def communication_matrix(blocks: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """matrix[block, shard] rows, with the blocks' sizes as row sums and shard sizes that differ by one at most."""
    rng = np.random.default_rng(seed)
    total = sum(blocks)
    room = [total // shards + (k < total % shards) for k in range(shards)]
    out = np.zeros((len(blocks), shards), dtype=np.int64)
    for b, n in enumerate(blocks):
        left, others = n, sum(room)
        for s in range(shards):
            others -= room[s]
            out[b, s] = hypergeometric(rng, room[s], others, left)
            left -= int(out[b, s])
        room = [r - int(x) for r, x in zip(room, out[b])]
    return out


def _ranked(rows: DataFrame, matrix: DataFrame) -> DataFrame:
    """Adds the shard: a row's rank in its block's permutation falls in one shard's part of it."""
    rank = F.row_number().over(Window.partitionBy("_block").orderBy("_first", "_tie"))
    placed = rows.withColumn("_rank", rank).join(F.broadcast(matrix), "_block")
    return placed.withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank")))).drop("_ends")


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs with shard (0 on) and slot (gapless from 0 in each shard), every row once, in a uniformly random order.

    Shards' counts differ by one at most.  Rows are told apart by all their columns, any of which may be null; equal
    rows get places of their own.  An empty table gives no rows.  Columns of docs named shard or slot are replaced; others
    may have any name.
    """
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]).alias("_row")
    # Every column: rows of one draw are equal altogether, so it doesn't matter which of them a task that runs again puts first.
    every = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if any(k in f.dataType.simpleString() for k in ("map<", "variant")) else F.col(f"`{f.name}`") for f in docs.schema.fields if f.name.lower() not in ("shard", "slot")]
    total = docs.count()
    blocks = min(MOST_BLOCKS, max(LEAST_BLOCKS, -(-total // BLOCK_ROWS)))
    sections = max(LEAST_SECTIONS, -(-total // (SECTION_ROWS * shards)))

    def keyed(*columns: Column) -> DataFrame:
        draw = lambda k: F.xxhash64(F.lit(seed + k), *every)
        return docs.select(*columns, F.pmod(draw(0), F.lit(blocks)).cast("int").alias("_block"), draw(1).alias("_first"), draw(4).alias("_tie"), F.pmod(draw(2), F.lit(sections)).cast("int").alias("_section"), draw(3).alias("_second"))

    keys = written(keyed().drop("_second"), "shard-keys")
    sizes = {r["_block"]: r["count"] for r in keys.groupBy("_block").count().collect()}
    matrix = communication_matrix([sizes.get(b, 0) for b in range(blocks)], shards, seed)
    ends = [(b, row.tolist()) for b, row in enumerate(np.cumsum(matrix, axis=1))]
    matrix_rows = spark.createDataFrame(ends, "_block int, _ends array<long>")

    dealt = written(_ranked(keys, matrix_rows), "shard-ranks")
    before = Window.partitionBy("shard").orderBy("_section").rowsBetween(Window.unboundedPreceding, -1)
    begin_rows = dealt.groupBy("shard", "_section").count().select("shard", "_section", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_begin"))

    if dealt.groupBy("_block", "_first", "_tie").count().where("count > 1").isEmpty():
        # A shard's part of a block ends with a hash; a row goes to the first part whose end is not before it.
        cuts = dealt.groupBy("_block", "shard").agg(F.max(F.struct("_first", "_tie")).alias("end"))
        cuts = cuts.groupBy("_block").agg(F.array_sort(F.collect_list(F.struct("shard", "end"))).alias("_cuts"))
        rows = keyed(row).join(F.broadcast(cuts), "_block")  # MOST_BLOCKS * shards cuts at most
        sent = rows.withColumn("shard", F.element_at(F.filter("_cuts", lambda c: c["end"] >= F.struct("_first", "_tie")), 1)["shard"]).drop("_cuts")
    else:
        sent = _ranked(keyed(row), matrix_rows)
    order = F.row_number().over(Window.partitionBy("shard", "_section").orderBy("_second", "_tie"))
    return sent.withColumn("_order", order).join(begin_rows, ["shard", "_section"]).select("_row.*", "shard", (F.col("_begin") + F.col("_order") - 1).alias("slot"))
