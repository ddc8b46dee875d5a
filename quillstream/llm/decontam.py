"""Benchmark decontamination (operator 4).

Three-word seeds of the test items that are rare by the words' corpus frequencies
join documents to items; around each seed a Smith-Waterman alignment over words
scores the passage against the item, so that edited and paraphrased copies count as
well.  Rarity is judged by how often a seed's words would meet by chance, not by how
often the seed occurs: a passage copied into a third of all documents stays findable.

The test items are a query set: they go out in blocks of BLOCK_BYTES, and each
block meets all documents.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import byte_slices, received, sent, tidy, written

#: Words in a seed; seeds that chance would put in more words than one in 1 / RARE are left out, but each item keeps LEAST_SEEDS.
SEED_WORDS, RARE, LEAST_SEEDS = 3, 1e-8, 8
#: Smith-Waterman scores of a word: equal, different, left out.
MATCH, MISMATCH, GAP = 2, -1, -1
#: A passage counts if its alignment has this share of the item's own score, or the score of so many equal words.  An item of
#: fewer than LEAST_WORDS words counts only whole.
THRESHOLD, ENOUGH_WORDS, LEAST_WORDS = 0.5, 30, 5
BLOCK_BYTES = 8_000_000

WORD = r"\w+"


def words(text: str | None) -> list[str]:
    return re.findall(WORD, (text or "").lower())


def best_ends(item: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each end (exclusive) in the passage the score of the best local alignment of two word-id arrays that ends there, and
    its start; ids under 0 match nothing.  Takes the room of a few rows of the table, whatever the item's length."""
    n = len(passage)
    steps = np.arange(n + 1) * -GAP
    place = np.arange(n + 1)
    above, begun = np.zeros(n + 1, dtype=np.int64), place.copy()
    best, start = np.zeros(n + 1, dtype=np.int64), place.copy()
    for w in item.tolist():
        equal = (passage == w) & (w >= 0)
        diagonal, down = above[:-1] + np.where(equal, MATCH, MISMATCH), above[1:] + GAP
        row, since = np.zeros(n + 1, dtype=np.int64), place.copy()
        row[1:] = np.maximum(np.maximum(diagonal, down), 0)
        since[1:] = np.where(row[1:] == 0, place[1:], np.where(diagonal >= down, begun[:-1], begun[1:]))
        lifted = row + steps  # gaps in the item
        most = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == most, place, 0))
        above, begun = most - steps, since[source]
        better = above > best
        best[better], start[better] = above[better], begun[better]
    return best, start


def align_all(item: np.ndarray, passage: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Score, start and end of passages that don't overlap, the best ones first taken, until no other reaches ``least``."""
    out, todo = [], [(0, len(passage))]
    while todo:
        a, b = todo.pop()
        if (b - a) * MATCH < least:
            continue
        score, start = best_ends(item, passage[a:b])
        free, found = np.ones(b - a, dtype=bool), []
        ends = np.flatnonzero(score >= least)
        for j in ends[np.argsort(-score[ends], kind="stable")].tolist():
            if free[start[j]:j].all():
                free[start[j]:j] = False
                found.append((int(score[j]), a + int(start[j]), a + j))
        if found:  # what is left on either side is aligned again, by itself
            edges = [a, *sorted(x for _, s, e in found for x in (s, e)), b]
            todo += zip(edges[::2], edges[1::2])
            out += found
    return sorted(out, key=lambda x: x[1:])


class Index:
    """The rare seeds of a block of items, as word ids."""

    def __init__(self, items: list[tuple[int | None, str]], counts: dict[str, int], total: int):
        self.items = [(k, w) for k, text in items if (w := words(text))]
        self.vocabulary = {w: k for k, w in enumerate(sorted({x for _, ws in self.items for x in ws}))}
        self.size = len(self.vocabulary) + 1
        share = {w: (counts.get(w, 0) + 1) / (total + 1) for w in self.vocabulary}
        self.ids = [np.array([self.vocabulary[x] for x in ws]) for _, ws in self.items]
        self.least = [MATCH * len(ws) if len(ws) < LEAST_WORDS else min(THRESHOLD * MATCH * len(ws), MATCH * ENOUGH_WORDS) for _, ws in self.items]
        seeds: dict[int, list[tuple[int, int, int]]] = {}  # by width: key, item, place in the item
        for k, ((_, ws), ids) in enumerate(zip(self.items, self.ids)):
            width = min(SEED_WORDS, len(ws))  # a shorter item is its own seed
            chance = np.prod([[share[w] for w in ws[j:len(ws) - width + 1 + j]] for j in range(width)], axis=0)
            kept = max(RARE, np.sort(chance)[:LEAST_SEEDS][-1])
            seeds.setdefault(width, []).extend((self.key(ids[at:at + width].tolist()), k, at) for at in np.flatnonzero(chance <= kept).tolist())
        self.seeds = {width: np.array(sorted(rows), dtype=np.int64).T for width, rows in seeds.items()}

    def key(self, ids):
        out = 0
        for x in ids:
            out = out * self.size + x
        return out

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where seeds stand among word ids (-1: a word of no item): position, item and place in the item of each hit."""
        out = [np.zeros((3, 0), dtype=np.int64)]
        for width, (keys, item_of, place) in self.seeds.items():
            parts = [ids[j:len(ids) - width + 1 + j] for j in range(width)]
            at = np.flatnonzero(np.logical_and.reduce([p >= 0 for p in parts]))
            key = self.key([p[at] for p in parts])
            first = np.searchsorted(keys, key)
            some = np.flatnonzero(keys[np.minimum(first, len(keys) - 1)] == key)
            first, at = first[some], at[some]
            n = np.searchsorted(keys, key[some], side="right") - first
            hit = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append(np.stack([np.repeat(at, n), item_of[hit], place[hit]]))
        at, item, place = np.concatenate(out, axis=1)
        order = np.argsort(at, kind="stable")
        return at[order], item[order], place[order]

    def passages(self, ids: np.ndarray, hits) -> list[tuple[int, float, int, int]]:
        """Item, score, first word and end of each passage that reaches its item's least score; overlapping windows of an item are one."""
        out = []
        spans: dict[int, list[list[int]]] = {}
        for at, item, place in sorted(zip(*(x.tolist() for x in hits)), key=lambda h: (h[1], h[0] - h[2])):
            n = len(self.ids[item])
            a, b = max(0, at - place - n // 4 - 4), min(len(ids), at - place + n + n // 4 + 4)
            row = spans.setdefault(item, [])
            if row and a <= row[-1][1]:
                row[-1][1] = max(b, row[-1][1])
            else:
                row.append([a, b])
        for item, row in spans.items():
            full = MATCH * len(self.ids[item])
            for a, b in row:
                out += [(item, score / full, a + s, a + e) for score, s, e in align_all(self.ids[item], ids[a:b], self.least[item])]
        return out


def corpus_counts(docs: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """How often each word of the vocabulary stands in all documents, and the number of all words."""
    known = docs.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(sorted(vocabulary))})

    def count(batches):
        import pyarrow as pa

        ids, total = known.value, 0
        found = np.zeros(len(ids) + 1, dtype=np.int64)
        get = ids.get
        for whole in batches:
            for batch in byte_slices(whole):
                ws = words("\n".join(t for t in batch.column("text").to_pylist() if t))
                total += len(ws)
                found += np.bincount(np.fromiter((get(w, -1) for w in ws), dtype=np.int64, count=len(ws)) + 1, minlength=len(found))
        found[0] = total
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some - 1), pa.array(found[some])], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(count), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    names = sorted(vocabulary)
    counts = {r["word"]: r["n"] for r in rows}  # one row per word of the block's items
    total = counts.pop(-1, 0)
    return {names[k]: n for k, n in counts.items()}, total


LEAKS = "doc_id long, text_hash long, item_id long, score double, first_word int, end_word int, start int, end int"


def _scan(batches, index):
    import pyarrow as pa

    index = received(index)
    get = index.vocabulary.get
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    for whole in batches:
        for batch in byte_slices(whole):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            split = [words(t) for t in texts]
            # All texts of the slice are looked up at once; words of no item part them.
            ends = np.cumsum([len(ws) + 2 for ws in split])
            flat = [k for ws in split for k in (*map(get, ws), None, None)]
            ids = np.array([-1 if k is None else k for k in flat], dtype=np.int64)
            at, item, place = index.find(ids)
            owner = np.searchsorted(ends, at, side="right")
            out: list[list] = [[] for _ in kinds]
            names, hashes = batch.column("doc_id"), batch.column("text_hash")
            for d in np.unique(owner).tolist():
                own = slice(bisect_left(owner, d), bisect_left(owner, d + 1))
                begin = int(ends[d]) - len(split[d]) - 2
                found = index.passages(ids[begin:int(ends[d]) - 2], (at[own] - begin, item[own], place[own]))
                if found:
                    places = [m.span() for m in re.finditer(WORD, low)] if len(low := texts[d].lower()) == len(texts[d]) else [(0, len(texts[d]))] * len(split[d])
                    for k, score, a, b in found:
                        for column, value in zip(out, (names[d].as_py(), hashes[d].as_py(), index.items[k][0], score, a, b, places[a][0], places[b - 1][1])):
                            column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[x.split()[0] for x in LEAKS.split(", ")])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per passage of a document that copies a test item, with edits or without.

    doc_id and text_hash (xxhash64 of the text, null as empty) name the document; score is the alignment's share of the
    item's own score, 0.5 to 1, or less in a passage that has the score of ENOUGH_WORDS equal words; first_word and end_word,
    start and end (code points) say where, ends exclusive.  An item's passages don't overlap, and between them is none.  A null
    or empty text has no passage; an item of fewer than five words counts only whole; items with one text are all
    reported; rows with one doc_id are searched each; an empty table on either side gives no row; other columns are
    left behind.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks, found = max(1, -(-size // BLOCK_BYTES)), None
    for k in range(blocks):
        block = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()]  # about BLOCK_BYTES
        vocabulary = Counter(w for _, text in block for w in words(text))
        index = sent(docs.sparkSession, Index(block, *corpus_counts(narrow, set(vocabulary))))
        rows = narrow.mapInArrow(tidy(lambda it, index=index: _scan(it, index)), LEAKS)
        if blocks > 1:
            rows = written(rows, "leaks")
        found = rows if found is None else found.unionByName(rows)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, least_words: int = 3) -> DataFrame:
    """The documents in which no passage of a test item was found, with all their columns.

    Passages of fewer than ``least_words`` words don't count: an item of a word or two stands in any text.
    """
    found = leaks(docs, benchmark).where(F.col("end_word") - F.col("first_word") >= least_words)
    bad = found.select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash")).distinct()
    own = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(bad, (own == bad["_text_hash"]) & docs["doc_id"].cast("long").eqNullSafe(bad["_doc_id"]), "left_anti")
