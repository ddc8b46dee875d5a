"""The cut of the quality rules comes from the table's labels."""

import random

from quillstream.llm import quality
from tests.llm import cases


def test_cut_lies_above_the_junk():
    clean = [(k, 10, 0) for k in range(-30, 50)]
    assert quality.derived_cut([*clean, *[(k, 0, 3) for k in range(-300, -190)]]) == -0.19
    assert quality.derived_cut([*clean, *[(k, 0, 3) for k in range(-900, -400)], (20, 0, 1)]) == -0.4  # a wrong label
    assert quality.derived_cut([*clean, (-250, 0, 3)]) == quality.THRESHOLD == quality.derived_cut([])


def test_junk_goes_however_loose_the_constant(spark, monkeypatch):
    monkeypatch.setattr(quality, "THRESHOLD", -9.0)
    rng, words = random.Random(6), cases.vocabulary(6, 300)
    plain = lambda: [rng.choice(words) for _ in range(120)]
    some = lambda ws: [w + "%%%" if rng.random() < 0.15 else w for w in ws]
    rows = [(k, " ".join(plain()), "en", "s", 0) for k in range(300)] + [(1000 + k, " ".join(some(plain())), "en", "s", 0) for k in range(120)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(200)] + [(1000 + k, 0, 0) for k in range(60)], cases.LABELS)
    got = {r["doc_id"]: r for r in quality.assess(cases.frame(spark, rows), labels).collect()}
    junk = [got[1000 + k] for k in range(120)]
    assert not any(r["kept"] for r in junk[:60]) and sum(r["kept"] for r in junk[60:]) <= 6
    assert all(got[k]["kept"] for k in range(300))
