"""Language identification by cross-parsing entropy (operator 6).

For each language a suffix automaton holds the letters of its training text, as UTF-8 bytes, so that all scripts
have one alphabet.  A text is parsed greedily into the longest phrases that occur there; the language that needs
the fewest phrases, each weighed by the bits that name a place in its training text, wins.

An automaton's transitions are packed into one table: a state has a base, and its transition by a byte stands at
base XOR byte, with the base as the owner's mark, so that thousands of places of texts step at once.  Long
texts are parsed in segments side by side, each as if a phrase began with it; then a segment into which a phrase
goes over is parsed again from there until both parses are in one state, so the result is that of one parse.

Training takes whole texts of a bounded sample of each language (TRAIN_BYTES, and ALL_BYTES for all languages
together); parsing covers every byte of every text.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import byte_slices, in_sample, received, sent, tidy

#: Bytes of training text of a language, and of all languages together, which bounds the model to about 40 bytes for each.
TRAIN_BYTES, ALL_BYTES = 32_000, 3_200_000
#: Documents of a language that the sample is drawn from, about.
SAMPLE_DOCS = 400
#: Bytes of a segment.
SEGMENT = 512
UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")


def suffix_automaton(codes) -> list[dict[int, int]]:
    """The transitions of the least automaton that accepts every substring of codes; state 0 starts."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] != length[p] + 1:
                twin = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = twin
                q = twin
            link[new] = q
        last = new
    return go


class Table:
    """An automaton's transitions; states are known by their bases, that of the first one is ``start``."""

    def __init__(self, go: list[dict[int, int]]):
        size = 1 << max(10, (2 * max(len(go), sum(map(len, go)))).bit_length())
        owner, target = [-1] * size, [0] * size
        base, used, draw = [0] * len(go), [False] * size, 0
        for state in sorted(range(len(go)), key=lambda s: -len(go[s])):  # those of most transitions first, while there is room
            while True:  # the table is at most half full, so a few draws of a full-period generator find a base
                draw = (draw * 0x5851F42D4C957F2D + 0x14057B7EF767814F) & 0xFFFFFFFFFFFFFFFF
                own = (draw >> 33) % size
                if not used[own] and all(owner[own ^ c] < 0 for c in go[state]):
                    break
            used[own], base[state] = True, own
            for c in go[state]:
                owner[own ^ c] = own
        for state, step in enumerate(go):
            for c, to in step.items():
                target[base[state] ^ c] = base[to]
        self.owner, self.target, self.start = np.array(owner, dtype=np.int32), np.array(target, dtype=np.int32), base[0]
        # Where a failed transition leads: the next phrase begins with that byte; a byte that the text lacks is a phrase of its own.
        self.first = np.array([base[go[0][c]] if c in go[0] else base[0] for c in range(256)], dtype=np.int32)
        self.lacks = np.array([c not in go[0] for c in range(256)], dtype=np.uint8)

    def step(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and how many phrases end."""
        place = state ^ codes
        after, ends = np.take(self.target, place), np.zeros(len(state), dtype=np.uint8)
        missed = np.flatnonzero(np.take(self.owner, place) != state)
        new = codes[missed]
        after[missed] = self.first[new]
        ends[missed] = (state[missed] != self.start) + self.lacks[new]
        return after, ends


class Model:
    """The languages' tables."""

    def __init__(self, texts: dict[str, bytes]):
        self.languages = sorted(texts)
        self.tables = [Table(suffix_automaton(texts[lang])) for lang in self.languages]
        self.bits = [float(np.log2(max(2, len(texts[lang])))) for lang in self.languages]

    def phrases(self, texts: list[str], segment: int = SEGMENT) -> np.ndarray:
        """For each text and language, the bits of its parse."""
        data = [normalised(t).encode("utf-8", "replace") for t in texts]
        flat = np.frombuffer(b"".join(data), dtype=np.uint8)
        size = np.array([len(d) for d in data], dtype=np.int64)
        pieces = np.maximum(1, -(-size // segment))
        owner = np.repeat(np.arange(len(data)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(np.cumsum(size) - size, pieces) + nth * segment
        length = np.minimum(segment, size[owner] - nth * segment)
        # Long segments first: those that have a byte at a place are then the first so many.
        order = np.argsort(-length, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        begin, length, owner, nth = begin[order], length[order], owner[order], nth[order]
        follower = np.full(len(order), -1)  # the next segment of the text
        follower[rank[np.flatnonzero(nth[rank] + 1 < pieces[owner[rank]])]] = rank[np.flatnonzero(nth[rank] + 1 < pieces[owner[rank]]) + 1]
        columns = []
        for j in range(int(length.max(initial=0))):
            n = int(np.searchsorted(-length, -j, side="left"))
            columns.append(flat[begin[:n] + j].astype(np.int32))
        return np.stack([self._parse(t, columns, length, owner, nth, follower, len(texts)) * b for t, b in zip(self.tables, self.bits)], axis=1) if self.tables else np.zeros((len(texts), 0))

    def _parse(self, table: Table, columns, length, owner, nth, follower, n_texts: int) -> np.ndarray:
        state, count = np.full(len(length), table.start, dtype=np.int32), np.zeros(len(length), dtype=np.int64)
        states, ended = [], []
        for codes in columns:
            n = len(codes)
            after, ends = table.step(state[:n], codes)
            state[:n] = after
            count[:n] += ends
            states.append(after)
            ended.append(ends)
        entered = np.full(len(length), table.start, dtype=np.int32)
        rows = np.flatnonzero(follower >= 0)
        while len(rows):  # segments that a phrase goes over into
            into = follower[rows]
            some = state[rows] != entered[into]
            rows, into = rows[some], into[some]
            entered[into] = state[rows]
            live, now, changed = into, state[rows], []
            for j in range(len(columns)):
                over = length[live] <= j
                if over.any():
                    state[live[over]] = now[over]
                    changed.append(live[over])
                    live, now = live[~over], now[~over]
                if not len(live):
                    break
                after, ends = table.step(now, columns[j][live])
                count[live] += ends.astype(np.int64) - ended[j][live]
                same = after == states[j][live]
                states[j][live], ended[j][live] = after, ends
                live, now = live[~same], after[~same]
            if len(live):
                state[live] = now
                changed.append(live)
            rows = np.concatenate(changed) if changed else rows[:0]
            rows = rows[follower[rows] >= 0]
        last = follower < 0
        out = np.bincount(owner, weights=count, minlength=n_texts)
        return out + np.bincount(owner[last], weights=(state != table.start)[last], minlength=n_texts)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [k for k, t in enumerate(texts) if t and self.languages and has_letter(t)]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known:
            bits = self.phrases([texts[k] for k in known])
            order = np.argsort(bits, axis=1, kind="stable")  # a tie goes to the first language by name
            rows = np.arange(len(known))
            best = bits[rows, order[:, 0]]
            second = bits[rows, order[:, 1]] if len(self.languages) > 1 else np.full(len(known), np.inf)
            for k, lang, b, s in zip(known, order[:, 0].tolist(), best.tolist(), second.tolist()):
                langs[k], scores[k] = self.languages[lang], 1 - b / s if s else 0.0
        return langs, scores


def has_letter(text: str) -> bool:
    """Whether a character of the category of letters stands in the text."""
    return any(map(str.isalpha, text))


def normalised(text: str) -> str:
    """What is parsed: letters in lower case, and one blank for whatever stands between them."""
    return NOT_LETTERS.sub(" ", text.lower())


def train(docs: DataFrame) -> Model:
    """Learns from text and lang of documents whose crc32(doc_id) mod 3 is not 1, a bounded sample of each lang.

    Of about SAMPLE_DOCS documents whole texts are taken by their hashes, those of up to an eighth of the bytes first, until
    the bytes are used up; a text longer than that is never taken, and a language of such texts alone isn't learned.
    """
    open_rows = docs.where((F.crc32(F.col("doc_id").cast("string")) % 3 != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    narrow = open_rows.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id").alias("h"), F.octet_length(F.col("text").cast("string")).cast("long").alias("size"), F.col("text").cast("string").alias("text"))
    fits = narrow.where(F.col("size") <= TRAIN_BYTES)
    have = {r["lang"]: r["n"] for r in fits.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    most = min(TRAIN_BYTES, ALL_BYTES // max(1, len(have)))
    drawn = F.lit(False)
    for lang, n in sorted(have.items()):
        drawn = F.when(F.col("lang") == lang, in_sample(F.col("h"), SAMPLE_DOCS, n)).otherwise(drawn)
    lettered = fits.where(drawn).where("text rlike '\\\\p{L}'")
    order = Window.partitionBy("lang").orderBy(F.col("size") * 8 > most, "h", "doc_id", "text")
    taken = lettered.withColumn("sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("r", F.row_number().over(order)).where(F.col("sum") <= most)
    texts: dict[str, bytes] = {}
    for r in taken.orderBy("lang", "r").collect():  # TRAIN_BYTES of each language, ALL_BYTES at most
        texts[r["lang"]] = texts.get(r["lang"], b"") + b" " + normalised(r["text"]).encode("utf-8", "replace")
    return Model(texts)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    lang_pred is a learned language, or ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned.  The score is the share of bits that the winner saves against the next language.  A row without a
    doc_id is neither held out nor learned from; rows with one doc_id are judged each; other columns are left behind.
    """
    model = sent(docs.sparkSession, train(docs))

    def run(batches):
        import pyarrow as pa

        own = received(model)
        for whole in batches:
            for batch in byte_slices(whole):
                langs, scores = own.predict(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = narrow.mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
