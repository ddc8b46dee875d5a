"""Classifiers on held-out rows, and the whole pipeline."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from quillstream.llm import langid, pii, toxicity
from tests.llm import cases


def languages(n=60):
    """Documents in three invented languages with alphabets that overlap."""
    sounds = {"aa": ("bdg", "aou"), "bb": ("kst", "aei"), "cc": ("dst", "éou")}
    rng = random.Random(3)
    words = {k: ["".join(rng.choice(c) + rng.choice(v) for _ in range(rng.randint(1, 4))) for _ in range(300)] for k, (c, v) in sounds.items()}
    rows = []
    for k in range(3 * n):
        lang = "aa bb cc".split()[k % 3]
        rows.append((k, cases.prose(rng, words[lang], rng.randint(5, 200)), lang, "s", 0))
    return rows, words


def slow_phrases(data: bytes, known: bytes) -> int:
    """Longest matches in the training text, one after the other."""
    total = at = 0
    while at < len(data):
        n = 0
        while at + n < len(data) and data[at:at + n + 1] in known:
            n += 1
        total, at = total + 1, at + max(n, 1)
    return total


@pytest.mark.parametrize("segment", [1, 5, 64, 512])
def test_phrases_are_longest_matches(segment):
    rng = random.Random(1)
    texts = {"x": "abracadabra abra cad".encode(), "y": "the cat sat on the mat é".encode(), "z": "中文字漢字 кот и кит".encode()}
    model = langid.Model(texts)
    made = ["".join(rng.choice("abrcdt éx?\n中кит") for _ in range(rng.randint(0, 600))) for _ in range(40)]
    made += ["abracadabra" * 60, "the cat sat on the mat " * 40, "", "é"]
    for t, got in zip(made, model.phrases(made, segment)):
        for k, lang in enumerate(model.languages):
            assert got[k] == pytest.approx(slow_phrases(langid.normalised(t).encode(), texts[lang]) * model.bits[k])


def test_scripts_without_a_common_letter():
    """Alphabets of 800 letters each: short texts of them are told apart."""
    rng = random.Random(5)
    scripts = {"a": [chr(0x4E00 + k) for k in range(800)], "b": [chr(0xAC00 + k) for k in range(800)]}
    of = lambda s, n: "".join(rng.choice(scripts[s]) for _ in range(n))
    model = langid.Model({s: of(s, 4000).encode() for s in scripts})
    for s in scripts:
        assert set(model.predict([of(s, 12) for _ in range(50)])[0]) == {s}


def test_no_letter_no_language():
    model = langid.Model({"a": b"abc"})
    assert model.predict(["²½①", "Ⅷ 12", "_-", "", None])[0] == ["und"] * 5 and model.predict(["a", "ª", "中"])[0] == ["a"] * 3


def test_automaton_accepts_substrings_alone():
    rng = random.Random(2)
    for _ in range(20):
        s = [rng.randint(1, 3) for _ in range(30)]
        go = langid.suffix_automaton(s)
        known = {tuple(s[a:b]) for a in range(30) for b in range(a, 31)}
        for _ in range(200):
            t, state = tuple(rng.randint(1, 3) for _ in range(rng.randint(0, 7))), 0
            for c in t:
                state = go[state].get(c) if state is not None else None
            assert (state is not None) == (t in known)


def test_identify(spark):
    rows, _ = languages()
    odd = [(900, None, "aa", "s", 0), (901, "", "aa", "s", 0), (902, "12 + 3", "bb", "s", 0), (None, rows[0][1], "aa", None, 0), (903, rows[1][1] * 300, None, "s", 0), rows[2]]
    got = langid.identify(cases.clashing(cases.frame(spark, rows + odd), "lang_pred")).collect()
    truth = {r[0]: r[2] for r in rows}
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) + len(odd)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert held and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert {(by[k]["lang_pred"], by[k]["score"]) for k in (900, 901, 902)} == {("und", 0.0)} and by[903]["lang_pred"] == "bb" and by[None]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(cases.frame(spark, [])).count() == 0
    unknown = langid.identify(cases.frame(spark, [(1, "abc", None, None, None)])).first()
    assert (unknown["lang_pred"], unknown["score"]) == ("und", 0.0)
    other = langid.identify(cases.frame(spark, [(r[0], r[1], "zz" if r[0] % 3 != 0 and zlib.crc32(str(r[0]).encode()) % 3 == 1 else r[2], "other", 0) for r in rows])).collect()
    assert {(r["doc_id"], r["lang_pred"]) for r in other} == {(r["doc_id"], r["lang_pred"]) for r in got if r["doc_id"] in truth}  # labels of held-out rows don't count


def insulted(n=400):
    rng, words = random.Random(4), cases.vocabulary(5, 3000)
    bad = ["zwackel", "quorrig", "vuxnos"]
    rows, labels = [], []
    for k in range(n):
        text = cases.prose(rng, words, rng.randint(40, 300)).split()
        toxic = int(k % 5 == 0)
        for _ in range(toxic * rng.randint(3, 9)):
            text.insert(rng.randrange(len(text)), rng.choice(bad) + rng.choice(["", "er", "en"]))
        rows.append((k, " ".join(text), "en", "s", 0))
        labels.append((k, 1, toxic))
    return rows, labels


def test_toxicity(spark):
    rows, labels = insulted()
    odd = [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "12", "en", "s", 0), (None, rows[0][1], None, None, 0), (903, rows[1][1] * 200, "en", "s", 0), rows[3]]
    known = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None), (7777, 1, 1)], cases.LABELS)
    got = toxicity.score_toxicity(cases.clashing(cases.frame(spark, rows + odd), "predicted"), known).collect()
    truth = {k: t for k, _, t in labels}
    assert len(got) == len(rows) + len(odd)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert held and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[900]["score"] == by[901]["score"] == by[902]["score"] < 0.5 and by[None]["predicted"] == 1 and not by[None]["held_out"] and by[903]["predicted"] == 0
    assert {r["score"] for r in toxicity.score_toxicity(cases.frame(spark, rows[:5]), spark.createDataFrame([], cases.LABELS)).collect()} == {0.0}
    assert toxicity.score_toxicity(cases.frame(spark, []), known).count() == 0


def test_windows_hold_the_whole_text():
    text = "One two, three. " * 50 + "é😀 x"
    found = toxicity.windows(text)
    assert b"".join(found) == toxicity._pairs(" " + " ".join(["one", "two", "three"] * 50 + ["é", "x"]) + " ") and toxicity.windows(None) == []


def test_pipeline_stages(spark, tmp_path):
    """Each stage against what it says of each document, on documents with something for every stage."""
    rng, words = random.Random(6), cases.vocabulary(7, 1500)
    rows = [(k, cases.prose(rng, words, 120), "en", "s", 0) for k in range(60)]
    rows += [(100 + k, " ".join(w + "%%%" for w in rows[k][1].split()), "en", "s", 0) for k in range(8)] + [(120, "too short", "en", "s", 0), (121, None, None, None, None)]
    rows += [(130 + k, rows[k][1], "en", "s", 0) for k in range(5)]
    items = [(k, " ".join(rng.choice(cases.vocabulary(70 + k)) for _ in range(25))) for k in range(4)]
    rows += [(150 + k, cases.prose(rng, words, 120) + " " + items[k][1], "en", "s", 0) for k in range(4)]
    rows += [(160, cases.prose(rng, words, 120) + " write to jo@example.com ", "en", "s", 0), (170, rows[33][1] + " and more", "en", "s", 0)]
    rows = [(a, b, c, d, len(b or "")) for a, b, c, d, _ in rows]
    cases.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in (*range(60), *range(150, 154), 160, 170)], cases.LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [x.split()[0] for x in cases.SCHEMA.split(", ")]
        docs.write.parquet(str(tmp_path / f"stage{number}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{number}"))
        kept.append({r["doc_id"]: r for r in docs.collect()})
    good = {r[0] for r in rows} - {*range(100, 108), 120, 121}
    assert set(kept[0]) == good
    assert set(kept[1]) == good - {*range(130, 135), 170}
    assert set(kept[2]) == set(kept[1]) - {*range(150, 154)}
    assert set(kept[3]) == set(kept[2])
    for k, r in kept[3].items():
        assert r["n_chars"] == len(r["text"]) and not pii.base_spans(r["text"])
        assert (r["text"] == kept[2][k]["text"]) == (not pii.base_spans(kept[2][k]["text"])) or k != 160
    assert "<EMAIL>" in kept[3][160]["text"]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(kept[3]) and all(4 * r["length"] == len(r["ids"]) for r in packed)
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "quality_rules"


def test_registered_queries():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
