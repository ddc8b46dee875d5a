import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillstream.llm import packing, repair
from quillstream.llm.tokens import ByteEncoder, WordEncoder
from tests.llm import cases

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a  b\n\n\nc\t d ", "<|endoftext|> x<|endoftext|>", "<|ENDOFTEXT|>", "Don't I'LL 's d's", "é́ ÉÈ ß ẞ İ ΣΑΣ ſ ﬁ", "123 45a a1 ½ ª º", "a.b,c!! ... ??!", "日本語 テスト", "😀😀 x\x85y\xa0z\x1cw", "x" * 3000, "$$$ %%% ### ***", "ok,, so.. yes!?", " ".join("ab" * k for k in range(40))]


def test_all_ids_are_the_library_s():
    texts = ODD + [r[1] or "" for r in cases.documents()]
    byte, word = ByteEncoder(BYTE), WordEncoder(WORD)
    assert byte.fast is not None
    for text in texts:
        assert byte(text).tolist() == Tokenizer.from_file(byte.path).encode(text, add_special_tokens=False).ids, text[:80]
        assert np.frombuffer(word(text), "<u4").tolist() == word.library.encode(text, add_special_tokens=False).ids, text[:80]


def best_fit(lengths, capacity):
    """Best-fit decreasing, one piece after the other: how much each bin has left, and the number of bins."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        if fits:
            k = min(fits, key=lambda k: rooms[k])
            rooms[k] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(1, 60))
    lengths = rng.integers(1, capacity + 1, size=int(rng.integers(0, 300))).tolist()
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    held, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, first, each, at in packing.plan_best_fit(dict(counts), capacity):
        for k in range(n):
            held[first + k // each].append((at + k % each * length, length))
            ranks[length].append(rank + k)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
    assert sorted(capacity - sum(n for _, n in p) for p in held.values()) == best_fit(lengths, capacity)


def test_plan_does_not_follow_the_number_of_pieces():
    runs = packing.plan_best_fit({n: 10**9 + n for n in range(1, 1025)})
    assert len(runs) < 60_000 and sum(r[2] for r in runs) == sum(10**9 + n for n in range(1, 1025))
    with pytest.raises(ValueError):
        packing.plan_best_fit({1025: 1})


def test_tree():
    tree, rng, have = packing.CapacityTree(100), np.random.default_rng(1), set()
    for _ in range(600):
        k = int(rng.integers(0, 101))
        have ^= {k}
        tree.set(k, k in have)
        need = int(rng.integers(0, 140))
        assert tree.tightest(need) == min((r for r in have if r >= need), default=None)


def test_packed_documents(spark):
    rows = cases.documents()
    docs = cases.clashing(cases.frame(spark, rows)).repartition(3)
    found = packing.packed_documents(docs, BYTE, with_ids=True)
    got = found.collect()
    library = Tokenizer.from_file(BYTE)
    wanted = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        wanted += [(str(r[0]), k, a, b - a, np.array(ids[a:b], "<u4").tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in got) == sorted(wanted)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)
    whole = {r["sequence_id"]: r for r in packing.sequences(found).collect()}
    for r in got:
        assert bytes(whole[r["sequence_id"]]["ids"])[4 * r["offset"]:4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    assert all(s["length"] <= 1024 and len(s["ids"]) == 4 * s["length"] for s in whole.values()) and sum(s["length"] for s in whole.values()) == sum(r["length"] for r in got)
    assert len(whole) == len(best_fit([r["length"] for r in got], 1024))
    assert packing.packed_documents(cases.frame(spark, []), BYTE).count() == 0


@pytest.mark.parametrize("ids", [[5, 6] * 200, [7] * 501, list(range(50)), [1], [9, 9, 9, 2] * 100])
def test_repair_round_trip(ids):
    docs = [np.array(x, "<u4").tobytes() for x in (ids, [2], ids[::-1], ids[:1])]
    for terminals in (100, 70_000):
        shard = repair.Shard(repair.pack_shard([3, None, -4, 5], docs, terminals))
        assert shard.doc_ids == [3, None, -4, 5]
        assert [shard.document(k).astype("<u4").tobytes() for k in range(4)] == docs
        flat = np.frombuffer(b"".join(docs), "<u4")
        rng = np.random.default_rng(1)
        for _ in range(40):
            a, b = sorted(rng.integers(0, len(flat) + 1, 2).tolist())
            assert a == b or shard.ids(a, b).tolist() == flat[a:b].tolist()
    assert len(ids) < 300 or len(shard.seq) < len(flat) / 4


def test_random_shards_round_trip():
    rng = np.random.default_rng(4)
    for _ in range(12):
        docs = [np.append(rng.choice([1, 1, 1, 4, 5, 900], int(rng.integers(0, 400))), 2).astype("<u4").tobytes() for _ in range(20)]
        shard = repair.Shard(repair.pack_shard(list(range(20)), docs, 1000))
        assert [shard.document(k).astype("<u4").tobytes() for k in range(20)] == docs
        assert (shard.lengths[shard.seq].sum() * 4) == sum(map(len, docs))


def test_shards_of_documents(spark):
    rows = cases.documents()
    library = Tokenizer.from_file(WORD)
    shards = repair.write_shards(cases.clashing(cases.frame(spark, rows)), WORD, shard_ids=3000, task_bytes=40_000)
    assert shards.count() > 3
    got = sorted(repair.read_shards(shards).collect(), key=lambda r: r["start"])
    ids = {}
    for r in rows:
        ids.setdefault(r[0], []).append(np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
    order = [None, *sorted(k for k in ids if k is not None)]
    assert [r["doc_id"] for r in got] == [k for k in order for _ in ids[k]]
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        ids[r["doc_id"]].remove(bytes(r["ids"]))
        at += r["n_tokens"]
    assert not any(ids.values())
    assert repair.read_shards(repair.write_shards(cases.frame(spark, []), WORD)).count() == 0
