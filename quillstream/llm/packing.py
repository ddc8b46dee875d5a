"""Best-fit packing of token pieces into sequences (operator 5).

Best-fit decreasing needs of a document only its pieces' lengths, and there are no
more lengths than the capacity.  So the corpus is reduced to a histogram, one
count for each length; the plan packs whole runs of equal pieces, finding the
tightest open bin in a segment tree over remaining capacities; and each piece finds
its place from its rank among the pieces of its length.  Plan and histogram have a
size bound by the capacity, whatever the corpus; no piece's ids move between tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import byte_slices, once_a_process, tidy, written
from quillstream.llm.tokens import ByteEncoder

CAPACITY = 1024
END_ID = 2

PIECES = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, part int, rank_in_part long"


class CapacityTree:
    """A segment tree over remaining capacities 0 to ``most``: which have open bins, and the tightest that fits."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.open = [False] * (2 * self.leaves)

    def set(self, room: int, is_open: bool) -> None:
        k = room + self.leaves
        self.open[k] = is_open
        while k > 1:
            k //= 2
            self.open[k] = self.open[2 * k] or self.open[2 * k + 1]

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of at least ``need`` that an open bin has."""
        if need >= self.leaves:
            return None
        k = need + self.leaves
        if self.open[k]:
            return need
        while k > 1:
            if k % 2 == 0 and self.open[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k + (not self.open[2 * k])
                return k - self.leaves
            k //= 2
        return None


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing for ``counts[length]`` pieces of each length.

    Returns runs (length, first_rank, n_pieces, first_bin, pieces_per_bin, offset): the piece of
    rank r goes to bin first_bin + (r - first_rank) // pieces_per_bin, at offset + its place there * length.
    The work follows the number of lengths, not the number of pieces.
    """
    tree = CapacityTree(capacity)
    rooms: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> runs of bins (first, count)
    bins, runs = 0, []

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            rooms.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:  # as many new bins as the rest of this length needs
                room, n = capacity, -(-left // (capacity // length))
                first, bins = bins, bins + n
            else:
                first, n = rooms[room].pop()
                if not rooms[room]:
                    tree.set(room, False)
            each, at = room // length, capacity - room
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, at))
                put(room - full_room(each, length), first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # one bin takes what is left
                runs.append((length, rank, left, first + full, left, at))
                put(room - left * length, first + full, 1)
                put(room, first + full + 1, n - full - 1)
                left = 0
            else:
                put(room, first + full, n - full)
    return runs


def full_room(each: int, length: int) -> int:
    """The capacity that ``each`` pieces of one length take."""
    return each * length


def _cut(batches, path: str, capacity: int, end_id: int):
    import zlib

    import pyarrow as pa
    from pyspark import TaskContext

    encode, part, seen = once_a_process(("byte", path), lambda: ByteEncoder(path)), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
    end = np.array([end_id], dtype=np.uint32)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank_in_part", pa.int64())])
    for whole in batches:
        for batch in byte_slices(whole):
            out: list[list] = [[] for _ in schema]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.concatenate([encode(text or ""), end]).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                for piece, b in enumerate(range(first, len(ids) + 1, capacity)):
                    a = max(0, b - capacity) if piece else 0
                    data = ids[a:b].tobytes()
                    for column, value in zip(out, (doc_id, piece, a, b - a, data, zlib.crc32(data), part, int(seen[b - a]))):
                        column.append(value)
                    seen[b - a] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema)], schema=schema)


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The token pieces of every document, written once in the shared folder.

    A document's ids end with ``end_id``; only longer ones are cut, into pieces of ``capacity``, the first
    of which may be shorter.  A null text counts as empty and gives the end id alone.  Rows with the same
    or no doc_id are documents of their own; other columns are left behind.  ``rank_in_part`` counts the
    pieces of a length in their task.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(narrow.mapInArrow(tidy(lambda it: _cut(it, tokenizer_path, capacity, end_id)), PIECES), "pieces")


def pack_best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces as cut_pieces gives them, by best-fit decreasing over all of them.

    No piece, no row.  Which of two pieces of one length comes first is settled by task and place in
    it, so the result is the same whenever it is worked out from the written pieces.
    """
    spark = pieces.sparkSession
    by_part = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = sorted(plan_best_fit(counts, capacity))
    # A run is found by (length, rank) as one number: a length has fewer than 2**48 pieces.
    plan = spark.sparkContext.broadcast(np.array(runs, dtype=np.int64).reshape(-1, 6))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("before") + F.col("rank_in_part")).drop("part", "before", "rank_in_part")

    def place(batches):
        import pyarrow as pa

        runs = plan.value
        keys = (runs[:, 0] << 48) + runs[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            run = runs[np.searchsorted(keys, (length << 48) + rank, side="right") - 1] if len(rank) else runs[:0]
            nth = rank - run[:, 1]
            kept = [n for n in batch.schema.names if n != "rank"]
            columns = [batch.column(n) for n in kept] + [pa.array(run[:, 3] + nth // run[:, 4]), pa.array(run[:, 5] + nth % run[:, 4] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in ranked.dtypes if n != "rank")
    return ranked.mapInArrow(tidy(place), f"{schema}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece of every document, with its place; ``with_ids`` also gives the ids themselves."""
    pieces = cut_pieces(docs, tokenizer_path, capacity, end_id)
    return pack_best_fit(pieces if with_ids else pieces.drop("ids"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, n_pieces, length and ids, its pieces' ids in the order of offset."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return (
        packed.groupBy("sequence_id").agg(ordered.alias("p"))
        .select("sequence_id", F.size("p").alias("n_pieces"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"),
                F.aggregate("p", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    )
