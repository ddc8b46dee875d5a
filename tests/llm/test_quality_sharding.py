import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import quality, sharding
from tests.llm import cases


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


ODD = ["a b c a b c", "a a a a", "x\n\nx\nx \n y", "# % <b>\x0b|", "é😀 é😀 é😀 é😀", "a b c d a b c", " ".join(map(str, range(49))), " ".join(map(str, range(50))), "w " * 30_000]


def test_base_rules_and_scores(spark):
    rows = cases.documents() + [(100 + k, t, None, None, None) for k, t in enumerate(ODD)]
    docs = cases.frame(spark, rows)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)] + [(None, 1, None), (3, None, 1)], cases.LABELS)
    got = quality.assess(cases.clashing(docs), labels).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted([(r["doc_id"], r["text"], *[r[n] for n in names]) for r in got], key=key) == sorted([(r[0], r[1], *base(r[1])) for r in rows], key=key)

    # The score again, with the engine's hash and plain sums.
    grams = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    split = [(r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in grams]
    seen = sorted({w for _, ws in split for w in ws})
    pairs = sorted({p for _, ws in split for p in zip(ws, ws[1:])})
    one = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in seen], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    two = {(r["x"], r["y"]): r["h"] for r in spark.createDataFrame([(*p, *map(one.get, p)) for p in pairs], "x string, y string, a long, b long").select("x", "y", F.xxhash64("a", "b").alias("h")).collect()}
    buckets = [(d, [h % quality.BUCKETS for h in [one[w] for w in ws] + [two[p] for p in zip(ws, ws[1:])]]) for d, ws in split]
    trusted = {r["text"] for (d, _), r in zip(buckets, grams) if d is not None and d < 30 and d % 2 == 1}
    raw, target = Counter(), Counter()
    for (_, bs), r in zip(buckets, grams):
        for b in bs:
            raw[b] += 1
            target[b] += r["text"] in trusted
    share = lambda c, b: (c[b] + quality.SMOOTHING) / (c.total() + quality.SMOOTHING * quality.BUCKETS)
    wanted = sorted(sum(round(math.log(share(target, b) / share(raw, b)), quality.DIGITS) for b in bs) / len(bs) for _, bs in buckets if bs)
    assert np.allclose(sorted(r["score"] for r in got if r["score"] is not None), wanted, atol=1e-9)
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD) for r in got if r["score"] is not None)
    assert {r["score"] for r in got if r["n_words"] == 0} == {None} and all(r["_w"] == "own" for r in got)


def test_junk_goes_and_prose_stays(spark):
    rows = cases.documents(3, 80)
    junk = [(1000 + k, " ".join(w + "%%%" for w in (r[1] or "x").split()), "en", "s", 0) for k, r in enumerate(rows[20:60])]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(20, 70)], cases.LABELS)
    got = {r["doc_id"]: r for r in quality.assess(cases.frame(spark, rows[:-2] + junk), labels).collect()}
    assert not any(got[r[0]]["kept"] for r in junk) and all(got[k]["kept"] for k in range(20, 70) if not got[k]["base_failed"])
    assert min(got[k]["score"] for k in range(21, 80)) > max(got[r[0]]["score"] for r in junk)  # those that nobody labelled as well


def test_no_rows_and_no_labels(spark):
    none = spark.createDataFrame([], cases.LABELS)
    assert quality.assess(cases.frame(spark, []), none).count() == 0
    assert all(r["kept"] == (not r["base_failed"]) for r in quality.assess(cases.frame(spark), none).collect())


def test_built_in_functions_only(spark):
    from quillstream.llm import licenses

    for frame in (quality.assess(cases.frame(spark), spark.createDataFrame([(1, 1, 0)], cases.LABELS)), licenses.scan(cases.frame(spark))):
        assert not re.search("Python|Arrow|Pandas", frame._jdf.queryExecution().executedPlan().toString())


def test_hypergeometric_law():
    from math import comb

    rng = np.random.default_rng(1)
    drawn = Counter(sharding.hypergeometric(rng, 30, 50, 20) for _ in range(20_000))
    for k in range(21):
        chance = comb(30, k) * comb(50, 20 - k) / comb(80, 20)
        assert abs(drawn[k] / 20_000 - chance) < 5 * math.sqrt(chance * (1 - chance) / 20_000) + 1e-4
    assert sharding.hypergeometric(rng, 0, 5, 3) == 0 and sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 2, 3, 5) == 2


class Fixed:
    """A generator that gives one number."""

    def __init__(self, u):
        self.u = u

    def random(self):
        return self.u


def test_hypergeometric_of_large_tables():
    import time

    good, bad, n = 4 * 10**9, 96 * 10**9, 24_000_000
    mean, deviation = n * good / (good + bad), math.sqrt(n * 0.04 * 0.96)
    rng, began = np.random.default_rng(2), time.perf_counter()
    drawn = [sharding.hypergeometric(rng, good, bad, n) for _ in range(400)]
    assert abs(np.mean(drawn) - mean) < 5 * deviation / 20 and 0.85 < np.std(drawn) / deviation < 1.15
    tails = [sharding.hypergeometric(Fixed(u), good, bad, n) for u in (0.0, 1e-5, 0.5, 0.9999, 0.99999, 1 - 2**-53)]
    assert tails == sorted(tails) and abs(tails[2] - mean) < 2 and tails[-1] < mean + 13 * deviation and tails[0] > mean - 13 * deviation
    assert abs((tails[3] - mean) / deviation - 3.719) < 0.05 and time.perf_counter() - began < 10


def check_shards(rows, found, shards):
    by = {}
    for r in found:
        by.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted([(r["doc_id"], r["text"]) for r in found], key=key) == sorted([(r[0], r[1]) for r in rows], key=key)


def test_shards_are_exact_with_and_without_repeated_rows(spark):
    rows = cases.documents(2, 300)
    for part in (rows, rows[:-2], []):
        docs = cases.clashing(cases.frame(spark, part))
        found = sharding.shuffle_into_shards(docs, 7)
        check_shards(part, found.collect(), 7)
        assert found.columns.count("shard") == 1 and set(found.columns) == set(docs.columns)
    same = sharding.shuffle_into_shards(cases.frame(spark, rows), 7).select("doc_id", "shard", "slot")
    again = sharding.shuffle_into_shards(cases.frame(spark, rows[::-1]).repartition(5), 7).select("doc_id", "shard", "slot")
    assert same.where("doc_id is not null").exceptAll(again).where("doc_id <> 4").count() == 0


def test_shuffle_is_uniform(spark):
    rows = [(k, f"t{k}", None, None, None) for k in range(2400)]
    found = sorted(sharding.shuffle_into_shards(cases.frame(spark, rows), 24).select("shard", "slot", "doc_id").collect())
    place = [r["doc_id"] for r in found]
    assert abs(np.corrcoef(place, range(2400))[0, 1]) < 0.08
    assert abs(np.mean(np.abs(np.diff(place))) - 800) < 40  # neighbours are strangers
