"""SimHash near-duplicates by the generalised pigeonhole principle (operator 7).

Fingerprints within ``radius`` bits are linked.  If 64 bits are dealt to m
partitions with thresholds T_i whose sum is radius - m + 1, any two such
fingerprints differ by at most T_i bits in some partition i (T_i = -1: the
partition is not looked at).  Correlated bits go to one partition; the thresholds
come from a dynamic program over the candidates each would give, estimated from the
agreement of bits over all fingerprints; candidates are probed and verified.

Three bits of 64 find copies that differ in a few words.  keep_one() is owed all of a similarity of SIMILARITY over
five-word shingles, which no radius of fingerprints finds whole: the links of this search and texts that
minhash.copies() brings together are held against one another by their shingles.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import byte_slices, dropped, join_skewed, tidy, written
from quillstream.llm.components import components
from quillstream.llm.minhash import SHINGLE as COPY_SHINGLE
from quillstream.llm.minhash import SIMILARITY, copies

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
#: Buckets up to this are compared pair by pair; larger ones by a search that gives a spanning forest.
SMALL_BUCKET = 48
#: Buckets over this are dealt again by the bits that they don't share.
LARGE_BUCKET = 4096
#: What a shuffled signature costs, in comparisons of two fingerprints.
SIGNATURE_COST = 200.0


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Other hashes made of hashes: the finish of splitmix64 from the k-th start."""
    z = h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints_of(text: str | None, shingle: int, n: int) -> list[int]:
    """n unsigned fingerprints of one text, the first of its shingles' own hashes: 0 if it has no word."""
    from xxhash import xxh64_digest

    found = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A to Z alone, and the blanks of the contract alone
    if not found:
        return [0] * n
    joined = b" ".join(found)
    if len(found) <= shingle:
        digests = xxh64_digest(joined, SEED)
    else:
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1
        ends = np.cumsum(size)
        starts = (ends - size)[: 1 - shingle].tolist()
        digests = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())])
    hashes = np.frombuffer(digests, dtype=">u8")
    out = []
    for k in range(n):
        own = hashes if k == 0 else _mixed(hashes.astype(np.uint64), k).astype(">u8")
        bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1)
        over = 2 * np.add.reduce(bits, axis=0, dtype=np.int64) > len(bits)
        out.append(int.from_bytes(np.packbits(over).tobytes(), "big"))
    return out


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of one text: 0 if it has no word."""
    return fingerprints_of(text, SHINGLE, 1)[0]


def _fingerprints(batches, shingle: int, n: int):
    import pyarrow as pa

    for whole in batches:
        for batch in byte_slices(whole):
            values = np.array([fingerprints_of(t, shingle, n) for t in batch.column("text").to_pylist()], dtype=np.uint64).reshape(-1, n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *[pa.array(np.ascontiguousarray(values[:, k]).view(np.int64)) for k in range(n)]], names=["doc_id", "text_hash", *_columns(n)])


def _columns(n: int) -> list[str]:
    return [f"fp{k}" for k in range(n)]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, n: int = 1) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text, null as empty) and fp0 on (the fingerprints as signed longs) of every document."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(docs).alias("text_hash"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(tidy(lambda it: _fingerprints(it, shingle, n)), "doc_id long, text_hash long, " + ", ".join(f"{c} long" for c in _columns(n)))


def text_hash(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def agreement(distinct: DataFrame, column: str = "fp0") -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have both bit i and bit j set, for all i and j, over all of them."""

    def count(batches):
        import pyarrow as pa

        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = batch.column(column).to_numpy(zero_copy_only=False)
            for k in range(0, len(fp), 100_000):
                bits = np.unpackbits(fp[k:k + 100_000].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
                total += bits.T @ bits
            n += len(fp)
        i, j = np.indices((BITS, BITS))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i.ravel(), -1)), pa.array(np.append(j.ravel(), -1)), pa.array(np.append(total.ravel(), n).astype(np.int64))], names=["i", "j", "n"])

    rows = distinct.select(column).mapInArrow(tidy(count), "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((BITS, BITS))
    n = 0
    for r in rows:  # 4097 rows
        if r["i"] < 0:
            n = r["n"]
        else:
            both[r["i"], r["j"]] = r["n"]
    return n, both


@dataclass(frozen=True)
class Partition:
    """Bits (0: the highest) that are looked at together, and how many of them may differ."""

    bits: tuple[int, ...]
    threshold: int

    def masks(self) -> list[int]:
        """The changes that a probe makes: none, and every choice of up to ``threshold`` bits."""
        single = [1 << (BITS - 1 - b) for b in self.bits]
        return [sum(c) for k in range(self.threshold + 1) for c in combinations(single, k)]

    def mask(self) -> int:
        return sum(1 << (BITS - 1 - b) for b in self.bits)


def group_bits(n: int, both: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """The bits in m groups of about one size, each grown by the bit that correlates most with it."""
    p = np.diag(both) / max(n, 1)
    deviation = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(deviation, deviation)
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for size in [BITS // m + (k < BITS % m) for k in range(m)]:
        rest = sorted(free)
        start = max(rest, key=lambda b: (corr[b, rest].max(initial=0), -b))
        group = [start]
        while len(group) < size:
            group.append(max(free - set(group), key=lambda b: (corr[b, group].mean(), -b)))
        free -= set(group)
        groups.append(tuple(group))
    return groups


def expected_agreement(n: int, both: np.ndarray, bits: tuple[int, ...], radius: int = RADIUS) -> list[float]:
    """The chance that two fingerprints differ in at most 0, 1, ... radius of the bits, each bit's agreement following the one before it."""
    def cells(i: int, j: int) -> np.ndarray:
        a, b, c = both[i, i] / n, both[j, j] / n, both[i, j] / n
        return np.clip(np.array([[1 - a - b + c, b - c], [a - c, c]]), 0, 1)

    p = both[bits[0], bits[0]] / n
    same = p * p + (1 - p) ** 2
    state = np.zeros((2, radius + 2))  # agreement of the bit before, differences so far (more than the radius in the last)
    state[1, 0], state[0, 1] = same, 1 - same
    for i, j in zip(bits, bits[1:]):
        c = cells(i, j)
        joint = np.zeros((2, 2))  # [i agrees][j agrees]
        for x in np.ndindex(2, 2):
            for y in np.ndindex(2, 2):
                joint[int(x[0] == y[0]), int(x[1] == y[1])] += c[x] * c[y]
        step = joint / np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
        agree, differ = state.T @ step[:, 1], state.T @ step[:, 0]
        state[1] = agree
        state[0] = np.append(0, differ[:-1])
        state[0, -1] += differ[-1]
    return np.cumsum(state.sum(axis=0))[: radius + 1].tolist()


def allocate(n: int, both: np.ndarray, radius: int = RADIUS) -> list[Partition]:
    """The partitions and thresholds of least expected work, over 2 to radius + 1 partitions (more would leave some unused)."""
    best: tuple[float, list[Partition]] | None = None
    n = max(n, 1)
    for m in range(2, radius + 2):
        groups = group_bits(n, both, m)
        chance = [expected_agreement(n, both, g, radius) for g in groups]
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # sum of (threshold + 1) so far -> least work
        for g, c in zip(groups, chance):
            work = [0.0] + [n * SIGNATURE_COST * (1 + (e > 0) * sum(comb(len(g), k) for k in range(e + 1))) + n * n * c[e] / 2 for e in range(radius + 1)]
            step: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, chosen) in table.items():
                for e in range(-1, radius + 1):
                    total = spent + e + 1
                    if total <= radius + 1 and (total not in step or cost + work[e + 1] < step[total][0]):
                        step[total] = (cost + work[e + 1], [*chosen, e])
            table = step
        cost, chosen = table[radius + 1]  # the thresholds' sum is radius - m + 1
        if best is None or cost < best[0]:
            best = cost, [Partition(g, e) for g, e in zip(groups, chosen) if e >= 0]
    return best[1]


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits rows of fingerprints differ, all their fingerprints together."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _search(fps: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """A spanning forest of the links among distinct rows of fingerprints, each compared with those not reached yet."""
    out, rest = [], fps[np.lexsort(fps.T[::-1])]
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = _apart(rest, x) <= limit
            if near.any():
                out += [(tuple(x.tolist()), tuple(y)) for y in rest[near].tolist()]
                queue += list(rest[near])
                rest = rest[~near]
    return out


def bucket_links(fps: np.ndarray, which: int, free: list[int], radius: int, limit: int) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """Links that connect what is linked among the distinct rows of a bucket; free: bits of the fingerprint ``which`` in which they may differ."""
    if len(fps) <= LARGE_BUCKET or len(free) <= radius + 1:
        return _search(fps, limit)
    out: list[tuple[tuple[int, ...], tuple[int, ...]]] = []
    for k in range(radius + 1):  # two within the radius agree on one of radius + 1 parts of the free bits
        part = free[k::radius + 1]
        value = fps[:, which] & np.uint64(sum(1 << (BITS - 1 - b) for b in part))
        order = np.argsort(value, kind="stable")
        cuts = np.flatnonzero(np.diff(value[order])) + 1
        for group in np.split(fps[order], cuts):
            if len(group) > 1:
                out += bucket_links(group, which, [b for b in free if b not in part], radius, limit)
    return _forest(out)


def _forest(links: list[tuple]) -> list[tuple]:
    """As few of the links as connect the same rows."""
    parent: dict = {}

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    kept = []
    for a, b in links:
        if (x := find(a)) != (y := find(b)):
            parent[x] = y
            kept.append((a, b))
    return kept


def _links(batches, partitions: list[tuple[int, Partition]], radius: int, n: int, limit: int):
    """Links within buckets; the rows come sorted by partition and signature, so a bucket's rows are neighbours."""
    import pyarrow as pa

    held: list[tuple[np.ndarray, ...]] = []

    def out(links):
        ends = [np.array([x[side] for x in links], dtype=np.uint64).reshape(-1, n) for side in (0, 1)]
        columns = [pa.array(np.ascontiguousarray(e[:, k]).view(np.int64)) for e in ends for k in range(n)]
        return pa.RecordBatch.from_arrays(columns, names=[f"{side}{k}" for side in "ab" for k in range(n)])

    def work(k: np.ndarray, sig: np.ndarray, probe: np.ndarray, fp: np.ndarray):
        links: list[tuple] = []
        edge = np.flatnonzero((np.diff(k) != 0) | (np.diff(sig) != 0)) + 1
        first, stop = np.append(0, edge), np.append(edge, len(k))
        size = stop - first
        big = np.repeat(size > SMALL_BUCKET, size)
        bucket = np.repeat(np.arange(len(size)), size)
        at = np.flatnonzero(~big)
        b, f, p = bucket[at], fp[at], probe[at]
        index = np.arange(max(0, len(at) - 1))
        for d in range(1, SMALL_BUCKET):
            index = index[index + d < len(at)]
            index = index[b[index] == b[index + d]]
            if not len(index):
                break
            apart = _apart(f[index], f[index + d])
            near = (apart <= limit) & (apart > 0) & ~(p[index] & p[index + d])
            links += zip(map(tuple, f[index[near]].tolist()), map(tuple, f[index[near] + d].tolist()))
        for s in np.flatnonzero(size > SMALL_BUCKET):
            which, part = partitions[k[first[s]]]
            # What probes meet in a bucket differs in a bit or more of the partition, so all bits are free there.
            free = list(range(BITS)) if part.threshold else [x for x in range(BITS) if x not in part.bits]
            links += bucket_links(np.unique(fp[first[s]:stop[s]], axis=0), which, free, radius, limit)
        return out(_forest(links))

    for batch in batches:
        if not batch.num_rows:
            continue
        fp = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in _columns(n)], axis=1)
        held.append((batch.column("k").to_numpy(), batch.column("sig").to_numpy(), batch.column("probe").to_numpy(zero_copy_only=False), fp))
        k, sig = held[-1][0], held[-1][1]
        if (k[0], sig[0]) == (k[-1], sig[-1]):
            continue  # one bucket so far; it may go on
        rows = [np.concatenate(x) for x in zip(*held)]
        last = int(np.flatnonzero((rows[0] != k[-1]) | (rows[1] != sig[-1]))[-1]) + 1
        yield work(*(x[:last] for x in rows))
        held = [tuple(x[last:] for x in rows)]
    if held:
        yield work(*(np.concatenate(x) for x in zip(*held)))


def _changed(k: int, own, changes):
    return F.transform(changes, lambda c, i: F.struct(F.lit(k).alias("k"), own.bitwiseXOR(c).alias("sig"), (i > 0).alias("probe")))


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp0) that connect all within ``radius`` bits of one another."""
    n, limit = 1, radius
    partitions = [(q, p) for q, c in enumerate(_columns(n)) for p in allocate(*agreement(distinct, c), radius)]
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    signatures = []
    for k, (q, p) in enumerate(partitions):
        own = F.col(f"fp{q}").bitwiseAND(F.lit(signed(p.mask())))
        changes = F.array(*[F.lit(signed(x)).cast("long") for x in p.masks()])
        # The first change is none: that row is what the others probe for.
        signatures.append(_changed(k, own, changes))
    rows = distinct.select(*_columns(n), F.inline(F.concat(*signatures)))
    dealt = rows.repartition("k", "sig").sortWithinPartitions("k", "sig").select("k", "sig", "probe", *_columns(n))
    links = dealt.mapInArrow(tidy(lambda it: _links(it, partitions, radius, n, limit)), ", ".join(f"{side}{k} long" for side in "ab" for k in range(n)))
    return links.select(*[_key([f"{side}{k}" for k in range(n)]).alias(side) for side in "ab"])


def _key(columns: list[str]):
    """One column for a row of fingerprints."""
    return F.col(columns[0]) if len(columns) == 1 else F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)])


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fingerprint (16 hex digits), component_id and n_same (documents with that fingerprint) of every document.

    A null text, or one without words, has fingerprint zero and is linked like any other; a text shorter than a
    shingle is one shingle.  Rows with one doc_id are linked by their own texts; a row without a doc_id takes part
    but can't name a component, which is null if it has no other rows.  Other columns are left behind.
    """
    each = written(fingerprints(docs, shingle).withColumn("fp", F.col("fp0")), "fingerprints")
    distinct = written(each.groupBy("fp", "fp0").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_same")), "distinct-fingerprints")
    total = each.count()
    roots = components(near_links(distinct, radius))
    # Only fingerprints with a link are in roots; a root itself is added to its own component.
    named = roots.union(roots.select("root", "root").distinct())
    member = written(named.toDF("fp", "root").join(distinct, "fp"), "linked-fingerprints")
    group = member.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n_members"))
    linked = join_skewed(member.select("fp", "root"), group, "root", "n_members", member.count()).select("fp", "component_id")
    by_print = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), "n_same", F.col("n_same").alias("weight"))
    joined = join_skewed(each, by_print, "fp", "weight", total)
    return joined.select("doc_id", "text_hash", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id", "n_same")


def near_texts(docs: DataFrame, shingle: int) -> DataFrame:
    """Pairs a, b of text_hash that connect the texts whose fingerprints over shingles of so many words are linked.

    Each text with the first one of its fingerprint, and the first ones of linked fingerprints with one another.
    """
    texts = written(fingerprints(docs, shingle).groupBy("text_hash").agg(F.first("fp0").alias("fp0")), "text-fingerprints")
    distinct = written(texts.groupBy("fp0").agg(F.min("text_hash").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    named = join_skewed(texts, distinct, "fp0", "n", texts.count()).where("text_hash <> first").select(F.col("text_hash").alias("a"), F.col("first").alias("b"))
    links = near_links(distinct)
    for side in "ab":
        links = links.join(distinct.select(F.col("fp0").alias(side), F.col("first").alias(f"{side}_first")), side)
    out = written(named.union(links.select("a_first", "b_first")), "near-texts")
    dropped(texts, distinct)
    return out


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of texts of that similarity, with all its columns: the one of the smallest doc_id.

    Texts that the fingerprints link, and those that minhash.copies() brings together beside them, are copies if the Jaccard of
    their whole sets of five-word shingles says so.  Rows of one doc_id and text are one document; in a group without any
    doc_id one row stays.
    """
    narrow = docs.select("doc_id", text_hash(docs).alias("text_hash"), "text")
    met = near_texts(docs, COPY_SHINGLE)
    near = copies(narrow, similarity, met)
    dropped(met)
    found = written(near.groupBy("doc_id", "text_hash").agg(F.first("component_id").alias("component_id"), F.first("root").alias("root"), F.count("*").alias("n")), "near-duplicates")
    dropped(near)
    # Who stays: the documents that name their component, and of a component without a name the least text.
    stays = F.when(F.col("component_id").isNotNull(), F.col("doc_id").eqNullSafe(F.col("component_id"))).otherwise(F.col("text_hash") == F.col("root"))
    keys = [F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash")]

    def same(left: DataFrame, right: DataFrame):
        return left["doc_id"].cast("long").eqNullSafe(right["_doc_id"]) & (text_hash(left) == right["_text_hash"])

    out = found.where(~stays).select(*keys)
    kept = docs.join(out, same(docs, out), "left_anti")
    # A kept doc_id may have several texts in its component, and a kept text several rows: one row of each component.
    again = found.where(stays).groupBy("root").agg(F.sum("n").alias("rows"), F.min("text_hash").alias("least")).where("rows > 1")
    if again.isEmpty():
        return kept
    once = found.where(stays).join(again.select("root", "least"), "root").select(*keys, F.col("text_hash") == F.col("least"))
    once = written(once.toDF("_doc_id", "_text_hash", "_least"), "kept-rows")
    single = kept.join(once, same(kept, once), "left_anti")
    least = once.where("_least").drop("_least")
    several = kept.join(least, same(kept, least), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    one = several.select(row, F.col("doc_id").alias("_id"), text_hash(several).alias("_hash")).dropDuplicates(["_id", "_hash"])
    return single.unionByName(one.select("_row.*"))
