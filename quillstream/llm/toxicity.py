"""Toxicity by compression distance (operator 3).

Two zstandard dictionaries are trained by the library's own trainer, one on ordinary and one on toxic
text.  Both begin with what was trained on windows of ordinary text, and differ in their tail: trained on
words of toxic documents that ordinary ones lack, or on the ordinary windows again.  A window of a few
words that compresses shorter with the toxic dictionary speaks for toxicity; how many windows do
so, by how much, is calibrated on labelled documents.

Windows are so short that a frame's fixed parts would hide a single word.  Each
character is therefore written as a pair of bytes, itself and the one before, and
matches are of 7 bytes or more, that is of about five characters.

The dictionaries and the calibration are fitted on whole texts of a bounded sample of the labelled
rows (SAMPLE_TOXIC, SAMPLE_ORDINARY, of at most SAMPLE_CHARS characters each); every document is scored
over its whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import byte_slices, in_sample, received, sent, tidy

#: The sample: documents of each class, about, and the characters that one of them may have; longer ones teach nothing.
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_CHARS = 800, 1600, 200_000
#: Words in a window; bytes of the dictionaries' common part and of their tails; the trainer's segments in both, and its matches.
WINDOW, BODY_BYTES, TAIL_BYTES, BODY_SEGMENT, TAIL_SEGMENT, MATCHED = 4, 28_000, 3_000, 32, 20, 8
#: The least log ratio of the document shares of a word that the toxic tail is trained on, and the least toxic documents that have it.
LEAST_RATIO, LEAST_DOCS = 4.0, 6
#: Differences of compressed length at which windows are counted.
STEPS = (2, 4, 6, 8, 10)

WORD = r"[^\W\d_]+"


def _pairs(text: str) -> bytes:
    """Each character but the first with the one before, one byte each; other alphabets share bytes by their code point."""
    code = np.frombuffer(text.encode("utf-16-le", "replace"), dtype="<u2").astype(np.int64)
    code = np.where(code < 256, code, (code * 40503 >> 3) % 255 + 1).astype(np.uint8)
    return np.stack([code[1:], code[:-1]], axis=1).tobytes()


def windows(text: str | None) -> list[bytes]:
    """The text's words in windows, the last one shorter; none without a letter."""
    found = re.findall(WORD, (text or "").lower())
    if not found:
        return []
    data = _pairs(" " + " ".join(found) + " ")
    parts = [" ".join(found[k:k + WINDOW]) for k in range(0, len(found), WINDOW)]
    ends = np.cumsum([2 * (len(p.encode("utf-16-le", "replace")) // 2 + 1) for p in parts]).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


class Model:
    """Both dictionaries and the calibration; small enough to be sent with the task."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.dictionaries = ordinary, toxic
        self.centre = self.scale = self.weights = None
        self.compressors = None

    def __getstate__(self):
        return self.__dict__ | {"compressors": None}

    def _open(self):
        import zstandard as zs

        self.compressors = []
        for data in self.dictionaries:
            params = zs.ZstdCompressionParameters.from_level(3, min_match=7, strategy=2, dict_size=max(len(data), 1), source_size=128, write_checksum=False, write_content_size=False, write_dict_id=False, format=zs.FORMAT_ZSTD1_MAGICLESS)
            self.compressors.append(zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(data, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=params).compress)

    def features(self, text: str | None) -> list[float]:
        if self.compressors is None:
            self._open()
        ordinary, toxic = self.compressors
        gain = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)] or [0])
        n = len(gain)
        over = [int((gain >= k).sum()) for k in STEPS]
        return [*np.log1p(over), *(k / (n + 10) for k in over), float(gain.max()), gain.sum() / (n + 10), math.log1p(n)]

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        x = (np.array([self.features(t) for t in texts]).reshape(len(texts), -1) - self.centre) / self.scale
        z = self.weights[0] + x @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def calibrate(self, texts: list[str], toxic: np.ndarray) -> None:
        """Logistic regression by Newton steps, with a small ridge."""
        x = np.array([self.features(t) for t in texts])
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        x = np.concatenate([np.ones((len(x), 1)), (x - self.centre) / self.scale], axis=1)
        ridge = 1e-3 * len(x) * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-6 * np.eye(len(w)), x.T @ (p - toxic) + ridge @ w)
        self.weights = w


def telling_words(toxic: list[str], ordinary: list[str]) -> list[str]:
    """The words of toxic texts, as often as they stand there, that tell them from ordinary ones."""
    of = lambda t: [f" {w} " for w in re.findall(WORD, t.lower())]
    toxic_words = [of(t) for t in toxic]
    count = Counter(w for ws in toxic_words for w in set(ws))
    often = {w for w, n in count.items() if n >= LEAST_DOCS}
    against = Counter(w for t in ordinary for w in often.intersection(of(t)))
    tells = {w for w in often if math.log((count[w] + 0.5) / (len(toxic) + 1)) - math.log((against[w] + 0.5) / (len(ordinary) + 1)) >= LEAST_RATIO}
    return [w for ws in toxic_words for w in ws if w in tells]


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary's content by zstandard's trainer; the samples themselves where they are too few for it."""
    import zstandard as zs

    try:
        return zs.train_dictionary(size, samples, k=segment, d=MATCHED).as_bytes()
    except (zs.ZstdError, ValueError, MemoryError):
        return b"".join(samples)[:size]


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """Both dictionaries and the calibration; without texts of both classes a model that scores 0."""
    if not toxic or not ordinary:
        return Model(b"", b"")
    usual = [w for t in ordinary for w in windows(t)]
    body, plain = trained(usual, BODY_BYTES, BODY_SEGMENT), trained(usual, TAIL_BYTES, TAIL_SEGMENT)
    telling = trained([_pairs(w) for w in telling_words(toxic, ordinary)], TAIL_BYTES, TAIL_SEGMENT)
    model = Model(body + plain, body + telling)
    model.calibrate([*toxic, *ordinary], np.array([1.0] * len(toxic) + [0.0] * len(ordinary)))
    return model


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[str]]:
    """Texts of toxic and of ordinary labelled documents outside the held-out fifth: all, or about SAMPLE_ of each, by their hashes."""
    known = labels.where("toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    ids = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    have = {r["toxic"]: r["n"] for r in ids.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    few = [ids.where(F.col("toxic") == k).where(in_sample(F.xxhash64("doc_id"), n, have.get(k, 0))) for k, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY))]
    wanted = few[0].union(few[1])  # about SAMPLE_TOXIC + SAMPLE_ORDINARY rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    rows = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return [r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0]


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    The score depends on the text alone.  A null, empty or wordless text gets the score of a text in which no
    window speaks for toxicity; rows with one doc_id are scored each; a doc_id of null is not held out; with no
    labelled text of one class all scores are 0; other columns are left behind.
    """
    model = sent(docs.sparkSession, fit(*sample(docs, labels)))

    def run(batches):
        import pyarrow as pa

        own = received(model)
        for whole in batches:
            for batch in byte_slices(whole):
                score = own.score(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = narrow.mapInArrow(tidy(run), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
