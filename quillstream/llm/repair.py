"""Token-id output by Re-Pair grammars (operator 9).

A shard holds consecutive documents in ascending doc_id.  Its ids are rewritten by
rules: a round counts the neighbouring pairs, gives the most frequent ones a
nonterminal each, and replaces them where they don't overlap; the next round counts
again, nonterminals included, until no pair is frequent enough to pay for its rule, or a round replaces next to nothing.  The file keeps the rules, the length to which each
expands, the rewritten sequence and where each document starts in it, so that any
document, or any range of ids, is decoded without the rest.

Layout of a shard, little-endian: ``QRP1``; uint32 terminals, rules, width (2 or 4)
of a symbol; uint64 symbols, documents; rules as uint32 pairs; uint64 expansion
length of each rule; for each document a byte (1: it has a doc_id), int64 doc_id
and uint64 first symbol; the symbols.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import byte_slices, once_a_process, tidy, written
from quillstream.llm.tokens import WordEncoder

MAGIC = b"QRP1"
HEAD = "<4sIIIQQ"
END_ID = 2
#: Ids in a shard, at least one document; and bytes of text that one task gets.
SHARD_IDS = 1_500_000
TASK_BYTES = 24_000_000
#: Rules that a round may add, and the least occurrences of a pair worth a rule.
RULES_A_ROUND, LEAST = 4096, 16
#: The last round is the one that replaces under one in PAYS symbols: it reads the whole shard for next to nothing.
PAYS = 50
#: Symbols that two bytes tell apart.  Where the terminals leave room below, rules end there: one more would make every symbol wider.
NARROW = 1 << 16
#: Slots that pairs are hashed to for counting, as a power of two: few enough to stay in a core's cache.
SLOT_BITS = 18


def compress(ids: np.ndarray, lengths: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (pairs), rewritten symbols, and how many symbols each document has; documents have one id or more."""
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), dtype=bool)
    last[np.cumsum(lengths) - 1] = True
    rules = np.zeros((0, 2), dtype=np.uint32)
    # A slot holds one of the pairs that are hashed to it, most likely the most frequent one, and counts it alone; another
    # factor each round gives the others their chance.
    narrow = terminals < NARROW
    key_type, shift, bits = (np.uint32, 16, 32) if narrow else (np.uint64, 32, 64)
    slots, factor = 1 << SLOT_BITS, 0x9E3779B97F4A7C15 >> (64 - bits) | 1
    while len(seq) > 1:
        room = min(RULES_A_ROUND, NARROW - terminals - len(rules)) if narrow else RULES_A_ROUND
        if not room:
            break
        factor = factor * 0x5851F42D4C957F2D % (1 << bits) | 1
        key = (seq[:-1].astype(key_type) << key_type(shift)) | seq[1:]
        slot = ((key * key_type(factor)) >> key_type(bits - SLOT_BITS)).astype(np.intp)
        held = np.zeros(slots + 1, dtype=key_type)
        held[slot] = key
        slot[(held[slot] != key) | last[:-1]] = slots  # no pair crosses documents
        count = np.bincount(slot, minlength=slots + 1)
        count[slots] = 0
        often = np.flatnonzero(count >= LEAST)
        if not len(often):  # is there one that gave its slot to another?
            inner = np.flatnonzero(~last[:-1])
            found, n = np.unique(key[inner], return_counts=True)
            found = found[np.argsort(n, kind="stable")][np.sort(n) >= LEAST]
            if not len(found):
                break
            held[((found * key_type(factor)) >> key_type(bits - SLOT_BITS)).astype(np.intp)] = found  # the most frequent last
            slot = ((key * key_type(factor)) >> key_type(bits - SLOT_BITS)).astype(np.intp)
            slot[(held[slot] != key) | last[:-1]] = slots
            count = np.bincount(slot, minlength=slots + 1)
            count[slots] = 0
            often = np.flatnonzero(count >= LEAST)
        # The most frequent first, equals by their slots, that is at random: in the order of ids a run of rising ones would give way to one pair of it.
        chosen = often[np.argsort(-count[often], kind="stable")[:room]]
        none = len(chosen)
        rank_of = np.full(slots + 1, none, dtype=np.int32)
        rank_of[chosen] = np.arange(none)
        rank = np.full(len(seq) + 1, none, dtype=np.int32)
        rank[1:-1] = rank_of[slot]
        chosen = held[chosen]
        here, before, after = rank[1:-1], rank[:-2], rank[2:]
        # Of overlapping pairs the more frequent one is taken; where a pair overlaps itself, as in a run of one id, every other one.
        some = np.flatnonzero((here < none) & (here <= after))
        own, left = here[some], before[some]
        first = left != own
        if first.all():
            taken = some[own < left]
        else:
            runs = np.flatnonzero(here < none)
            starts = np.maximum.accumulate(np.where(before[runs] != here[runs], runs, 0))
            taken = some[(own <= left) & ((some - starts[np.searchsorted(runs, some)]) % 2 == 0)]
        symbol = here[taken].astype(np.uint32)
        seq[taken] = terminals + len(rules) + symbol
        last[taken] = last[taken + 1]
        stay = np.ones(len(seq), dtype=bool)
        stay[taken + 1] = False
        seq, last = seq[stay], last[stay]
        rules = np.concatenate([rules, np.stack([chosen >> key_type(shift), chosen & key_type((1 << shift) - 1)], axis=1).astype(np.uint32)])
        if len(taken) * PAYS < len(seq):
            break
    ends = np.flatnonzero(last) + 1
    return rules, seq, np.diff(ends, prepend=0)


def expansion_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """How many ids each symbol stands for; a rule names only symbols before it."""
    out = [1] * terminals
    for a, b in rules.tolist():
        out.append(out[a] + out[b])
    return np.array(out, dtype=np.int64)


def pack_shard(doc_ids: list[int | None], docs: list[bytes], terminals: int) -> bytes:
    """The file of one shard; docs: each document's ids as little-endian 32-bit bytes."""
    lengths = np.array([len(d) // 4 for d in docs], dtype=np.int64)
    rules, seq, symbols = compress(np.frombuffer(b"".join(docs), dtype="<u4"), lengths, terminals)
    width = 2 if terminals + len(rules) <= 1 << 16 else 4
    index = np.zeros(len(docs), dtype=[("known", "u1"), ("doc_id", "<i8"), ("first", "<u8")])
    index["known"] = [d is not None for d in doc_ids]
    index["doc_id"] = [d or 0 for d in doc_ids]
    index["first"] = np.cumsum(symbols) - symbols
    return b"".join([
        struct.pack(HEAD, MAGIC, terminals, len(rules), width, len(seq), len(docs)), rules.astype("<u4").tobytes(),
        expansion_lengths(rules, terminals)[terminals:].astype("<u8").tobytes(), index.tobytes(), seq.astype(f"<u{width}").tobytes(),
    ])


class Shard:
    """Reads a shard's file; document(k) and ids(a, b) decode no more than they return."""

    def __init__(self, data: bytes):
        magic, self.terminals, n_rules, width, n_symbols, n_docs = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = struct.calcsize(HEAD)
        rules = np.frombuffer(data, "<u4", 2 * n_rules, at).reshape(-1, 2)
        at += 8 * n_rules
        self.lengths = np.concatenate([np.ones(self.terminals, dtype=np.int64), np.frombuffer(data, "<u8", n_rules, at).astype(np.int64)])
        at += 8 * n_rules
        kind = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("first", "<u8")])
        index = np.frombuffer(data, kind, n_docs, at)
        at += kind.itemsize * n_docs
        self.seq = np.frombuffer(data, f"<u{width}", n_symbols, at)
        self.doc_ids = [int(d) if k else None for k, d in zip(index["known"], index["doc_id"])]
        self.first = np.append(index["first"].astype(np.int64), n_symbols)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths[self.seq])])  # ids before each symbol
        self.at = np.cumsum(self.lengths) - self.lengths
        self.flat = np.empty(int(self.lengths.sum()), dtype=np.uint32)  # each symbol's ids, one symbol after the other
        self.flat[:self.terminals] = np.arange(self.terminals)
        flat, at, size = self.flat, self.at.tolist(), self.lengths.tolist()
        to = self.terminals
        for a, b in rules.tolist():
            for s in (a, b):
                flat[to:to + size[s]] = flat[at[s]:at[s] + size[s]]
                to += size[s]

    def symbols(self, a: int, b: int) -> np.ndarray:
        """The ids of the symbols a to b."""
        seq = self.seq[a:b]
        n = self.lengths[seq]
        jump = self.at[seq] - (np.cumsum(n) - n)
        return self.flat[np.repeat(jump, n) + np.arange(n.sum())]

    def document(self, k: int) -> np.ndarray:
        return self.symbols(self.first[k], self.first[k + 1])

    def ids(self, a: int, b: int) -> np.ndarray:
        """The ids a to b of the shard, b exclusive."""
        first = int(np.searchsorted(self.starts, a, side="right")) - 1
        stop = int(np.searchsorted(self.starts, b, side="left"))
        return self.symbols(first, stop)[a - self.starts[first]: b - self.starts[first]]


SHARDS = "shard long, n_docs long, n_ids long, data binary"


def _encode(batches, path: str, end_id: int, shard_ids: int):
    import pyarrow as pa
    from pyspark import TaskContext

    encode = once_a_process(("word", path), lambda: WordEncoder(path))
    terminals, end = encode.library.get_vocab_size(), np.array([end_id], dtype="<u4").tobytes()
    part, made, names, docs, held = TaskContext.get().partitionId(), 0, [], [], 0

    def shard():
        nonlocal made, names, docs, held
        row = [[(part << 24) + made], [len(docs)], [held // 4], [pack_shard(names, docs, terminals)]]
        made, names, docs, held = made + 1, [], [], 0
        return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1], pa.int64()), pa.array(row[2], pa.int64()), pa.array(row[3], pa.binary())], names=["shard", "n_docs", "n_ids", "data"])

    for whole in batches:
        for batch in byte_slices(whole, most=1_000_000):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), map(encode, batch.column("text").to_pylist())):
                if held and held + len(ids) > 4 * shard_ids:
                    yield shard()
                names.append(doc_id)
                docs.append(ids + end)
                held += len(ids) + 4
    if docs:
        yield shard()


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Encodes and writes every document, ascending by doc_id (null first, then by the text's hash), and returns the written shards.

    A null text counts as empty and gives the end id alone; rows with one doc_id are documents of their own;
    an empty table gives no shard; other columns are left behind.  Shard numbers ascend with the documents.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = narrow.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    tie = F.xxhash64("text")
    ranged = narrow.repartitionByRange(max(1, -(-total // task_bytes)), F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    return written(ranged.mapInArrow(tidy(lambda it: _encode(it, tokenizer_path, end_id, shard_ids)), SHARDS), "repair-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, shard, n_tokens, ids (little-endian 32-bit) of every document, and start: the ids of all documents before it.

    The shards before one are summed in two steps, over blocks of 4096 shards, so that no task sees them all.
    """
    block = F.shiftright("shard", 24)
    size = shards.select("shard", "n_ids", block.alias("block"))
    blocks = size.groupBy("block").agg(F.sum("n_ids").alias("n"))
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per writing task
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("in_blocks"))
    inner = Window.partitionBy("block").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = size.withColumn("in_block", F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).join(blocks, "block").select("shard", (F.col("in_blocks") + F.col("in_block")).alias("before"))

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            for number, first, data in zip(batch.column("shard").to_pylist(), batch.column("before").to_pylist(), batch.column("data")):
                shard = Shard(data.as_py())
                starts = shard.starts[shard.first]
                ids = shard.symbols(0, len(shard.seq)).astype("<u4")
                for a in range(0, len(shard.doc_ids), 2000):
                    b = min(a + 2000, len(shard.doc_ids))
                    edge = starts[a:b + 1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number] * (b - a), pa.int64()), pa.array(shard.doc_ids[a:b], pa.int64()), pa.array(first + edge[:-1], pa.int64()), pa.array(np.diff(edge), pa.int64()),
                         pa.array([ids[x:y].tobytes() for x, y in zip(edge, edge[1:])], pa.binary())],
                        names=["shard", "doc_id", "start", "n_tokens", "ids"])

    placed = shards.select("shard", "data").join(before, "shard")  # the compressed shards meet their offsets, not the decoded rows
    return placed.mapInArrow(tidy(decode), "shard long, doc_id long, start long, n_tokens long, ids binary")
