"""Copies by shingles against all pairs."""

import random

from pyspark.sql import functions as F

from quillstream.llm import minhash, simhash
from tests.llm import cases
from tests.llm.test_search import jaccard


def edited(rng, text, similarity):
    """The text with words changed one by one, as long as it stays that similar."""
    words = text.split()
    while True:
        after = words.copy()
        after[rng.randrange(len(words))] = f"other{rng.randrange(10**6)}"
        if jaccard(text, " ".join(after)) < similarity:
            return " ".join(words)
        words = after


def test_copies_meet_from_a_similarity_of_0_8(spark):
    rng, words = random.Random(3), cases.vocabulary(11, 3000)
    rows, bands = [], {}
    for k in range(160):
        text = cases.prose(rng, words, 300)
        copy = edited(rng, text, (0.8, 0.85, 0.9, 0.95)[k % 4])
        bands.setdefault(k % 4, []).append((k, 1000 + k))
        rows += [(k, text, "en", "s", 0), (1000 + k, copy, "en", "s", 0)]
        rows.append((2000 + k, edited(rng, text, 0.6), "en", "s", 0))  # not as similar
    ids = {r["doc_id"] for r in simhash.keep_one(cases.frame(spark, rows)).collect()}
    texts = {r[0]: r[1] for r in rows}
    assert all(0.8 <= jaccard(texts[a], texts[b]) for pairs in bands.values() for a, b in pairs)
    for pairs in bands.values():
        assert sum(b not in ids for _, b in pairs) >= 0.97 * len(pairs)
    assert all(2000 + k in ids for k in range(160)) and set(range(160)) <= ids


def test_components_are_those_of_all_pairs(spark):
    rng, words = random.Random(4), cases.vocabulary(12, 2000)
    texts = []
    for _ in range(6):  # chains of edits, whose ends are no copies of each other
        text = cases.prose(rng, words, 200)
        for _ in range(12):
            texts.append(text)
            text = edited(rng, text, rng.choice([0.75, 0.82, 0.9]))
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    near = minhash.copies(cases.frame(spark, rows).withColumn("text_hash", F.xxhash64("text"))).collect()
    label = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if label[i] != label[j] and jaccard(a, texts[j]) >= 0.8:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert {r["doc_id"]: r["component_id"] for r in near} == dict(enumerate(label))


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    rng, words = random.Random(5), cases.vocabulary(13, 2000)
    base = cases.prose(rng, words, 150)
    texts = [edited(rng, base, rng.uniform(0.7, 0.9)) for _ in range(240)]  # of one origin, many under 0.8 to one another
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)]
    label = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if label[i] != label[j] and jaccard(a, texts[j]) >= 0.8:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert 1 < len(set(label)) < len(texts)
    docs = cases.frame(spark, rows).withColumn("text_hash", F.xxhash64("text"))
    for size in (2048, 16):
        monkeypatch.setattr(minhash, "BLOCK_TEXTS", size)
        assert {r["doc_id"]: r["component_id"] for r in minhash.copies(docs).collect()} == dict(enumerate(label))


def test_shared_shingles_are_counted_whole(monkeypatch):
    import numpy as np

    draw = np.random.default_rng(6)
    sides = [[np.unique(draw.integers(0, 300, draw.integers(0, 200), dtype=np.int64)) for _ in range(n)] for n in (7, 12)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sides[1]] for a in sides[0]]
    for cells in (1, 100, 10**6):
        monkeypatch.setattr(minhash, "CELLS", cells)
        assert minhash.shared_shingles(*sides).tolist() == want
