"""Near-duplicates, test items, licences and personal data against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillstream.llm import components, decontam, licenses, pii, simhash
from tests.llm import cases


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, " \n", "one", "one two", "A b\tc\x0bd", "É x É", "a b a b a b", "x" * 999, "nul\x00 \x1c z"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def slow_components(prints):
    """Labels of fingerprints linked at 3 bits or fewer, by comparing all."""
    prints = sorted(set(prints))
    label = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for b in prints[i + 1:]:
                if (a ^ b).bit_count() <= 3 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def clustered(rng, n, skew):
    """Fingerprints in chains and clusters, some bits nearly always equal."""
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            p = rng.choice(out)
            for _ in range(rng.randint(0, 5)):
                p ^= 1 << rng.randrange(64)
        else:
            p = rng.getrandbits(64) & (~0 << skew)
        out.append(p & (2**64 - 1))
    return out


@pytest.mark.parametrize("seed,skew,small,large", [(1, 0, 48, 4096), (2, 40, 4, 8), (3, 20, 2, 4), (4, 55, 48, 6)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, seed, skew, small, large):
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    monkeypatch.setattr(simhash, "LARGE_BUCKET", large)
    prints = clustered(random.Random(seed), 260, skew)
    signed = np.array(sorted(set(prints)), dtype=np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(p,) for p in signed], "fp0 long")
    links = simhash.near_links(frame).collect()
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 3 for r in links)
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    wanted, group = slow_components(prints), {}
    for p in signed:
        group.setdefault(found.get(p, p), set()).add(wanted[p & (2**64 - 1)])
    assert all(len(g) == 1 for g in group.values()) and len(group) == len(set(wanted.values()))


def test_allocation():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (5000, 64)).astype(float)
    bits[:, 1::2] = bits[:, ::2]  # pairs of equal bits
    parts = simhash.allocate(5000, bits.T @ bits)
    used = [b for p in parts for b in p.bits]
    assert len(set(used)) == len(used) and sum(p.threshold + 1 for p in parts) == simhash.RADIUS + 1
    groups = simhash.group_bits(5000, bits.T @ bits, 4)
    assert sorted(b for g in groups for b in g) == list(range(64)) and all((b ^ 1) in g for g in groups for b in g)
    assert simhash.allocate(3 * 10**10, 3 * 10**10 * np.full((64, 64), 0.25) + 3 * 10**10 * 0.25 * np.eye(64))[0].threshold > 0  # at that size wide partitions with probes


def test_near_duplicates(spark):
    rows = cases.documents(5, 80)
    words = rows[30][1].split()
    rows += [(200 + k, " ".join(words[:60 * k % 90] + words[60 * k % 90 + 1:]), "en", "s", 0) for k in range(25)]
    got = simhash.near_duplicates(cases.clashing(cases.frame(spark, rows)))
    prints = [slow_fingerprint(r[1]) for r in rows]
    label = slow_components(prints)
    first = {}
    for r, p in zip(rows, prints):
        if r[0] is not None:
            first[label[p]] = min(first.get(label[p], r[0]), r[0])
    wanted = sorted((str(r[0]), f"{p:016x}", first.get(label[p]), prints.count(p)) for r, p in zip(rows, prints))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"], r["n_same"]) for r in got.collect()) == wanted
    assert simhash.near_duplicates(cases.frame(spark, [])).count() == 0 == simhash.keep_one(cases.frame(spark, [])).count()


def jaccard(a, b):
    sets = [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_one_stays_of_texts_without_a_doc_id(spark):
    rng = random.Random(21)
    text, other = (cases.prose(rng, cases.vocabulary(12, 900), 80) for _ in range(2))
    rows = [(None, text, "en", "s", 0)] * 3 + [(None, text + " more", "en", "s", 0), (None, None, "en", "s", 0), (None, "", "en", "s", 0), (3, other, "en", "s", 0), (3, other + " end", "en", "s", 0)]
    kept = simhash.keep_one(cases.clashing(cases.frame(spark, rows))).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "None", "None"] and sum((r["text"] or "").startswith(text) for r in kept) == 1


def test_keep_one_of_similar_texts(spark):
    rng, rows = random.Random(9), cases.documents(5, 120)
    for k in range(40, 100):  # copies of long texts with a word changed here and there
        words = cases.prose(rng, cases.vocabulary(11, 3000), 400).split()
        rows[k] = (k, " ".join(words), "en", "s", 0)
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = "other"
        rows.append((1000 + k, " ".join(words), "en", "s", 0))
    kept = simhash.keep_one(cases.clashing(cases.frame(spark, rows))).collect()
    texts = [(r["doc_id"], r["text"]) for r in kept]
    assert len(texts) == len(set(texts)) and kept[0]["key"] == "own"
    ids = {r["doc_id"] for r in kept}
    assert set(range(40, 100)) <= ids  # strangers stay
    copies = [k for k in range(40, 100) if jaccard(rows[k][1], next(r[1] for r in rows if r[0] == 1000 + k)) >= 0.9]
    assert len(copies) > 40 and sum(1000 + k in ids for k in copies) <= len(copies) // 10
    assert 4 in ids and 5 not in ids and sum(r["doc_id"] == 4 for r in kept) == 1


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(0, 300) if k % 60 != 59] + [(1000, 1000 + k) for k in range(1, 80)] + [(5000, 5000)]
    rng.shuffle(links)
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame([p if rng.random() < 0.5 else p[::-1] for p in links], "a long, b long")).collect()}
    assert all(found.get(k, k) == k // 60 * 60 for k in range(300)) and all(found[1000 + k] == 1000 for k in range(1, 80)) and 5000 not in found


def slow_align(item, passage):
    """Smith-Waterman, cell by cell."""
    h = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a == b and a >= 0 else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(max(r) for r in h)


def test_alignment_equals_the_plain_one():
    rng = random.Random(3)
    for _ in range(150):
        item = np.array([rng.randint(0, 6) for _ in range(rng.randint(1, 15))])
        passage = np.array([rng.randint(-1, 6) for _ in range(rng.randint(1, 25))])
        least = rng.randint(1, 8)
        best, _ = decontam.best_ends(item, passage)
        assert best.max() == slow_align(item.tolist(), passage.tolist())
        found = decontam.align_all(item, passage, least)
        assert (best.max() >= least) == bool(found) and (not found or max(x[0] for x in found) == best.max())
        edges = [0, *[x for _, a, b in found for x in (a, b)], len(passage)]
        assert edges == sorted(edges)
        for score, a, b in found:
            assert slow_align(item.tolist(), passage[a:b].tolist()) == score >= least
        for a, b in zip(edges[::2], edges[1::2]):  # nothing is left between them
            assert slow_align(item.tolist(), passage[a:b].tolist()) < least


def test_every_passage_of_every_item():
    word = lambda k: f"w{k}"
    item = " ".join(map(word, range(20)))
    long = " ".join(f"v{k}" for k in range(100_000))
    index = decontam.Index([(1, item), (2, "four words are enough"), (3, "one"), (4, long)], {}, 0)

    def found(text):
        ids = np.array([index.vocabulary.get(w, -1) for w in decontam.words(text)])
        return sorted((index.items[k][0], a, b) for k, _, a, b in index.passages(ids, index.find(ids)))

    assert found(" ".join([item] * 3)) == [(1, 0, 20), (1, 20, 40), (1, 40, 60)]
    assert found(f"x {item} x x {item}") == [(1, 1, 21), (1, 23, 43)]
    assert found("x four words are enough one, four words enough") == [(2, 1, 5), (3, 5, 6)]
    assert found("x " * 50 + " ".join(f"v{k}" for k in range(500, 540)) + " x") == [(4, 50, 90)]  # a part of a long item
    assert found("") == []


BENCHMARK = "item_id long, text string"


def edited(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < share / 3 else [w, "extra"] if x < 2 * share / 3 else ["changed"] if x < share else [w]
    return out


def test_leaks(spark):
    rng, own, other = random.Random(7), cases.vocabulary(8, 2000), cases.vocabulary(9, 2000)
    items = [(k, " ".join(rng.choice(own) for _ in range(30)).capitalize() + ".") for k in range(12)] + [(50, "too short"), (None, items_text := " ".join(rng.choice(own) for _ in range(20))), (51, None), (52, "")]
    rows = cases.documents(6, 40)
    plain = [(300 + k, cases.prose(rng, other, 150), "en", "s", 0) for k in range(30)]
    leaked = [(400 + k, cases.prose(rng, other, 40) + " " + " ".join(edited(rng, items[k][1].split(), 0.15 * (k % 2))) + "\n" + cases.prose(rng, other, 30), "en", "s", 0) for k in range(12)]
    hot = [(500 + k, items[3][1] + f" tail {k}", "en", "s", 0) for k in range(60)]
    rows += plain + leaked + hot + [(None, "x " + items_text, None, None, 0), (700, items[0][1] + " and " + items[1][1] + " again " + items[0][1], None, None, 0)]
    docs, bench = cases.frame(spark, rows), spark.createDataFrame(items, BENCHMARK)
    found = decontam.leaks(cases.clashing(docs), bench).collect()
    pairs = sorted((str(r["doc_id"]), str(r["item_id"])) for r in found)
    wanted = [(str(400 + k), str(k)) for k in range(12)] + [(str(500 + k), "3") for k in range(60)] + [("None", "None"), ("700", "0"), ("700", "0"), ("700", "1")]
    assert pairs == sorted(wanted)
    texts = {r[0]: r[1] for r in rows}
    exact = [r for r in found if r["doc_id"] is not None and r["doc_id"] >= 500]
    assert all(r["score"] == 1.0 and texts[r["doc_id"]][r["start"]:r["end"]].lower() == items[r["item_id"]][1][:-1].lower() for r in exact)
    kept = decontam.without_leaks(cases.clashing(docs), bench)
    bad = {r["doc_id"] for r in found}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] not in bad or r[0] is None and not r[1].startswith("x "))
    assert decontam.leaks(docs, spark.createDataFrame([], BENCHMARK)).count() == 0 == decontam.leaks(cases.frame(spark, []), bench).count()


def test_leaks_in_blocks_are_the_same(spark, monkeypatch):
    rng, own = random.Random(7), cases.vocabulary(8, 2000)
    items = [(k, " ".join(rng.choice(own) for _ in range(30))) for k in range(20)]
    docs = cases.frame(spark, [(k, f"before {items[k][1]} after", "en", "s", 0) for k in range(20)])
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1000)
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, spark.createDataFrame(items, BENCHMARK)).collect()) == [(k, k) for k in range(20)]


def slow_base(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k:k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in places]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def slow_labels(texts):
    """The method over all texts: rarest licence words, best relative position, key phrases."""
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for t in texts]
    frequency = {w: sum(w in set(ws) for ws in split) for w in licenses.vocabulary()}
    weight = {w: x for _, w, _, x in licenses.index_rows(frequency, len(texts))}
    out = []
    for ws in split:
        joined = f" {' '.join(ws)} "
        rare = sorted((w for w in weight if w in ws), key=lambda w: (-weight[w], w))[: licenses.LOOKED_UP]
        labels, best = set(), 0.0
        for label, text, phrases in licenses.TEMPLATES:
            if not all(f" {p} " in joined for p in phrases):
                continue
            template = text.split()
            sought = sum(weight[w] for w in template if w in rare)
            at = {}
            for p, w in enumerate(ws):
                for q, v in enumerate(template):
                    if w == v and w in rare:
                        at[p - q] = at.get(p - q, 0.0) + weight[w]
            share = max(at.values(), default=0.0) / sought if sought else 0.0
            best = max(best, share)
            if share >= licenses.THRESHOLD:
                labels.add(label)
        out.append((labels, best))
    return out


LINES = ["Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "under the MIT license under the mit\nLICENSE",
         "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "MIT License", "the license of the mit", "apache license version 2", "GNU GENERAL public license and far away version 3", "cc by nc cc by nc", "Licence CC BY-SA 4.0", "mit der license"]


def test_license_scan(spark):
    rng, rows = random.Random(2), cases.documents(4, 40)
    rows += [(300 + k, cases.prose(rng, cases.vocabulary(1), 20 + k) + "\n" + line + "\n" + (line if k % 3 else "É the of"), "en", "s", 0) for k, line in enumerate(LINES * 3)] + [(999, LINES[1], None, None, None)] * 2
    got = licenses.scan(cases.clashing(cases.frame(spark, rows), "words", "norm", "words2", "found_labels", "base")).collect()
    method = slow_labels([r[1] for r in rows])
    wanted = []
    for r, (labels, best) in zip(rows, method):
        n, n_base, first, last, base = slow_base(r[1])
        wanted.append((str(r[0]), n, n_base, first, last, base, ",".join(sorted(labels | set(filter(None, base.split(","))))), 1.0 if base else min(best, 1.0)))
    key = lambda x: tuple(str(v) for v in x[:7])
    mine = sorted([(str(r["doc_id"]), *tuple(r)[1:7], r["score"]) for r in got], key=key)
    wanted = sorted(wanted, key=key)
    assert [m[:7] for m in mine] == [w[:7] for w in wanted] and np.allclose([m[7] for m in mine], [w[7] for w in wanted])
    assert {"gpl-3", "mit", "apache-2", "cc-by-nc"} <= {x for m in mine for x in m[6].split(",")}
    assert licenses.scan(cases.frame(spark, [])).count() == 0


def slow_spans(x):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 8 <= sum(c.isascii() and c.isdigit() for c in m.group()) <= 15]


PRIVATE = ["write to jo.e+1@mail.example.com or x@y.z!", "from 10.0.0.1 and 300.1.1.1 to 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "+1 (988) 555-2485 4111111111111111", "call (988) 555-2485 now", "😀 a@b.cc 😀 +49 30 1234567", "١٢٣ 12٣", "@@a@b@c.d.e", "token = \"0641917ea4e9feb9cda83477b57ac2654884f485\"", "version 2.0 of 2024-05-17"]


def test_base_spans():
    rng = random.Random(2)
    texts = PRIVATE + ["".join(rng.choice("a@.1 2-+().%9\n") for _ in range(rng.randint(1, 40))) for _ in range(8000)]
    for t in texts:
        assert pii.base_spans(t) == slow_spans(t), t
    for long in ("a" * 200_000, "1" * 200_000 + ".", "1." * 60_000, "+1" + "(" * 100_000, "a@" * 60_000):
        pii.base_spans(long)  # in linear time


def test_model_finds_other_forms_and_leaves_numbers_alone():
    model = pii.fit([f"text {p} text" for p in PRIVATE] * 20)
    def all_spans(t):
        return pii.find(t, model, lambda z: model.best(pii.Lattice(z)))[1]
    assert all_spans(PRIVATE[4]) == [(3, 5, 19)]
    assert [x[0] for x in all_spans(PRIVATE[3])] == [2, 3]  # the pattern alone takes both for one number and drops it
    for t in ("version 2.0 of 2024-05-17", "page 123 of 4567", "in 1999, 2.50 or 10:45", "no digits"):
        assert all_spans(t) == []
    for t in PRIVATE:
        base, every = pii.find(t, model, lambda z: model.best(pii.Lattice(z)))
        assert set(base) <= set(every) and every == sorted(every)


def test_long_zones_are_read_whole():
    model = pii.fit([])
    text = "x " + " ".join(["(988) 555-2485", "4111 1111 1111 1111", "in 1999"] * 400)
    every = pii.find(text, model, lambda z: model.best(pii.Lattice(z)))[1]
    assert [text[a:b] for k, a, b in every if k == 3] == ["(988) 555-2485"] * 400 and sum(k == 2 for k, _, _ in every) == 400
    assert pii.find("1" * 5000, model, lambda z: model.best(pii.Lattice(z)))[1] == []


def test_dynamic_program_is_best():
    rng = random.Random(5)
    for _ in range(60):
        lattice = pii.Lattice("".join(rng.choice("a1. +@") for _ in range(rng.randint(1, 12))))
        names = sorted({f for row in lattice.ending for _, _, fs in row for f in fs})
        model = pii.Model({f: rng.uniform(-2, 4) for f in names})
        n = len(lattice.tokens)

        def best(j):
            if j == 0:
                return 0.0
            return max([best(j - 1)] + [best(i) + s for i, _, fs in lattice.ending[j] if (s := model.span(fs)) >= pii.MARGIN])

        spans = model.best(lattice)
        places = {(lattice.tokens[i][0], lattice.tokens[j - 1][1], k): model.span(fs) for j, row in enumerate(lattice.ending) for i, k, fs in row}
        assert abs(sum(places[a, b, k] for k, a, b in spans) - best(n)) < 1e-9
        assert all(x[2] <= y[1] for x, y in zip(spans, spans[1:]))


def test_gradient_of_the_likelihood():
    """A step makes the labelled division likelier."""
    lattice, spans = pii.Lattice("a (988) 555-2485 b"), [(3, 2, 16)]
    model = pii.Model()
    for _ in range(40):
        model.learn(lattice, spans, 0.3)
    assert model.best(lattice) == spans


def test_annotate(spark):
    rows = cases.documents(4, 30) + [(300 + k, t, "en", "s", 0) for k, t in enumerate(PRIVATE * 4)]
    docs = cases.clashing(cases.frame(spark, rows), "n_email")
    got = pii.annotate(docs, mask=True).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] >= 300:
            base = sorted(slow_spans(texts[r["doc_id"]]))
            assert [r[n] for n in ("n_email", "n_ip", "n_card", "n_phone")] == [sum(x[0] == k for x in base) for k in range(4)]
            assert r["base_sha256"] == hashlib.sha256(pii.written_form(base).encode()).hexdigest()
            assert set(filter(None, pii.written_form(base).split(","))) <= set(r["spans"].split(",")) and not slow_spans(r["text"])
        elif r["doc_id"] == 7:
            assert r["text"] is None and r["spans"] == ""
        assert r["key"] == "own"
    assert pii.masked("a 1.1.1.1 b@c.d", [(0, 10, 15), (1, 2, 9)]) == "a <IP> <EMAIL>"
    assert pii.annotate(cases.frame(spark, [])).count() == 0
