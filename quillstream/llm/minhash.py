"""Copies of a similarity (Jaccard) over five-word shingles, for the pipeline's near-dedup stage.

A text's BANDS keys are hashes of ROWS minima each, over its set of shingles; two texts with one key in common meet.
At similarity s they meet with the chance 1 - (1 - s**ROWS)**BANDS: 0.9998 at 0.8.  Whether texts that meet are
copies is decided by the Jaccard of their whole sets alone.  First each text is held against one text of each of its
keys, another for every key; that puts most copies in one component.  Then, in every key whose texts are not all in one
component, all texts of different components are held against one another, block against block.  So any two texts
with a key in common are in one component, or were held against one another themselves, however many have that key.

Blocks bound what a task holds, and a pair of blocks gives fewer links than it has texts.  The comparisons of a key
are its texts outside its largest component times all its texts: the square of their number at worst, which is the
price of losing no link.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import byte_slices, dropped, join_skewed, tidy, written
from quillstream.llm.components import components

#: Words in a shingle, similarity that counts as a copy, keys of a text, minima in a key.
SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 16, 4
SEED = 42
#: Texts, and shingles, that a block of a key has on average at most.
BLOCK_TEXTS, BLOCK_SHINGLES = 2048, 1_000_000
#: Cells of a matrix of texts by shingles that are multiplied at once.
CELLS = 4_000_000
#: Odd factors, one for each minimum.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles that are multiplied at once, so that they stay in the processor's cache.
AT_ONCE = 8192


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted: of all words if there are fewer, one zero without a word."""
    from xxhash import xxh64_digest

    found = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A to Z alone, and the blanks of the contract alone
    if not found:
        return np.zeros(1, dtype=np.uint64)
    joined = b" ".join(found)
    if len(found) <= SHINGLE:
        digests = xxh64_digest(joined, SEED)
    else:
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1
        ends = np.cumsum(size)
        starts = (ends - size)[: 1 - SHINGLE].tolist()
        digests = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1:] - 1).tolist())])
    return np.unique(np.frombuffer(digests, dtype=">u8").astype(np.uint64))


def keys(hashes: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set of shingles."""
    least = np.full(len(FACTORS), ~np.uint64(0))
    for k in range(0, len(hashes), AT_ONCE):
        part = hashes[k:k + AT_ONCE]
        least = np.minimum(least, np.fromiter(((part * f).min() for f in FACTORS), dtype=np.uint64, count=len(FACTORS)))
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in least.reshape(BANDS, ROWS).T:
        out = (out ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(31)
    return out


def _mapped(docs: DataFrame, name: str, of) -> DataFrame:
    """doc_id, text_hash, n_shingles and ``name``, an array of longs made of a text's shingles."""

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in byte_slices(whole):
                sets = [shingles(t) for t in batch.column("text").to_pylist()]
                made = [np.ascontiguousarray(of(s)).view(np.int64) for s in sets]
                offsets = pa.array(np.cumsum([0, *map(len, made)]), pa.int32())
                values = pa.array(np.concatenate(made) if made else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "text_hash", "n_shingles", name])

    return docs.select("doc_id", "text_hash", "text").mapInArrow(tidy(run), f"doc_id long, text_hash long, n_shingles long, {name} array<long>")


def shared_shingles(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of left shares with each of right, by products of 0-1 matrices over the hashes of both sides."""
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    values = [np.concatenate(side) for side in (left, right)]
    common = np.intersect1d(*values)
    rows, at = [], []
    for value, size in zip(values, sizes):
        place = np.searchsorted(common, value)
        found = place < len(common)
        found[found] = common[place[found]] == value[found]
        rows.append(np.repeat(np.arange(len(size)), size)[found])
        at.append(place[found])
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    step = max(1, CELLS // max(len(left), len(right)))
    for start in range(0, len(common), step):
        parts = []
        for side, r, c in zip((left, right), rows, at):
            now = (c >= start) & (c < start + step)
            cells = np.zeros((len(side), min(step, len(common) - start)), dtype=np.float32)
            cells[r[now], c[now] - start] = 1
            parts.append(cells)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def block_links(blocks: np.ndarray, texts: np.ndarray, roots: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect what is so similar between two blocks, or within one: as few as connect the same components."""
    first = np.flatnonzero(blocks == blocks.min())
    second = np.flatnonzero(blocks == blocks.max())
    shared = shared_shingles([sets[x] for x in first], [sets[x] for x in second])
    size = np.array([len(x) for x in sets])
    near = shared >= similarity * (size[first][:, None] + size[second] - shared) - 1e-9
    near &= roots[first][:, None] != roots[second]
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in np.argwhere(near).tolist():
        x, y = first[i], second[j]
        if (a := find(int(roots[x]))) != (b := find(int(roots[y]))):
            parent[a] = b
            out.append((int(texts[x]), int(texts[y])))
    return out


def links_of_keys(named: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links a, b between texts that share a key and are in different components, which connect all that are so similar.

    named: key, text_hash, n_shingles, root.  A key's blocks are numbered: those of texts outside its largest
    component come first, and each of them meets itself and all later ones.  A key that fits in one block is one.
    """
    parts = named.groupBy("key", "root").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("s"))
    state = parts.groupBy("key").agg(F.max_by(F.struct("root", "m", "s"), F.struct("m", "root")).alias("most"), F.sum("m").alias("n"), F.sum("s").alias("s"), F.count("*").alias("n_roots"))

    def blocks(texts, hashes):
        return F.greatest(F.ceil(texts / BLOCK_TEXTS), F.ceil(hashes / BLOCK_SHINGLES)).cast("int")

    one = blocks(F.col("n"), F.col("s")) == 1
    mixed = state.where("n_roots > 1").select(
        "key", "n", F.col("most.root").alias("largest"),
        F.when(one, 1).otherwise(blocks(F.col("n") - F.col("most.m"), F.col("s") - F.col("most.s"))).alias("others"),
        F.when(one, 0).otherwise(blocks(F.col("most.m"), F.col("most.s"))).alias("own"))
    left = join_skewed(named, written(mixed, "mixed-keys"), "key", "n", named.count())
    draw = F.xxhash64("text_hash", F.lit(1))
    within = (F.col("own") > 0) & (F.col("root") == F.col("largest"))
    block = F.when(within, F.col("others") + F.pmod(draw, F.col("own"))).otherwise(F.pmod(draw, F.col("others"))).cast("int")
    last = F.when(within, F.col("others") - 1).otherwise(F.col("others") + F.col("own") - 1)
    dealt = left.select("key", "text_hash", "root", block.alias("block"), F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("with"))
    dealt = dealt.select("key", "text_hash", "root", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))

    def compare(group):
        import pyarrow as pa

        get = lambda c: group.column(c).to_numpy()
        hashes = group.column("hashes").combine_chunks()
        offsets, values = hashes.offsets.to_numpy(), hashes.values.to_numpy()
        block, low, high = get("block"), group.column("i")[0].as_py(), group.column("j")[0].as_py()
        found = []
        if len(block) > 1 and (low == high or len(np.unique(block)) == 2):  # a block may have no text at all
            found = block_links(block, get("text_hash"), get("root"), [values[a:b] for a, b in zip(offsets, offsets[1:])], similarity)
        return pa.table({side: pa.array([x[k] for x in found], pa.int64()) for k, side in enumerate("ab")})

    return dealt.join(sets, "text_hash").groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def copies(docs: DataFrame, similarity: float = SIMILARITY, met_before: DataFrame | None = None) -> DataFrame:
    """doc_id, text_hash, component_id (the least doc_id, null if there is none) and root (the least text_hash) of every document.

    docs: doc_id (long), text_hash and text, others are left behind.  Equal texts are one; rows without a doc_id take part.
    met_before: pairs a, b of text_hash that another search brought together; they are held against one another as well.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text_hash", F.col("text").cast("string").alias("text"))
    each = written(_mapped(narrow, "keys", keys), "text-keys")
    distinct = written(each.groupBy("text_hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_same"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys")), "distinct-texts")

    # Texts of each key that more than one text has; the centre is another text for every key.
    every = distinct.select("text_hash", "n_shingles", F.explode("keys").alias("key"))
    shared = every.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("text_hash", "key").alias("h"), "text_hash", "n_shingles")).alias("centre")).where("n > 1")
    shared = written(shared.select("key", "n", F.col("centre.text_hash").alias("c"), F.col("centre.n_shingles").alias("c_shingles")), "shared-keys")
    met = written(join_skewed(every, shared, "key", "n", every.count()), "texts-of-keys")

    def alike(n, m):
        """Sets of other sizes than this can't be so similar."""
        return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = met.where(F.col("c") != F.col("text_hash")).where(alike(F.col("n_shingles"), F.col("c_shingles")))
    tried = stars.select(*pair(F.col("text_hash"), F.col("c")))
    others = [met.select("text_hash")]
    if met_before is not None:
        tried = tried.union(met_before.where("a <> b").select(*pair(F.col("a"), F.col("b"))))
        others += [met_before.select(F.col(side).alias("text_hash")) for side in "ab"]
    tried = written(tried.distinct(), "pairs")
    # The set of each text that met another, made of one row with that text.
    wanted = reduce(DataFrame.union, others).distinct().join(distinct, "text_hash").select(F.col("text_hash").alias("_h"), F.col("first").alias("_first"))
    some = narrow.join(wanted, (narrow["text_hash"] == F.col("_h")) & narrow["doc_id"].eqNullSafe(F.col("_first")), "left_semi")
    sets = written(_mapped(some, "hashes", lambda s: s).dropDuplicates(["text_hash"]).select("text_hash", "hashes"), "shingle-sets")

    def similar(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose whole sets are so similar."""
        total = pairs.count()
        for side in "ab":
            often = pairs.groupBy(side).agg(F.count("*").alias("n"))
            side_sets = often.join(sets, F.col(side) == F.col("text_hash")).select(side, "n", F.col("hashes").alias(f"{side}_set"))
            pairs = join_skewed(pairs, side_sets, side, "n", total)
        both = F.size(F.array_intersect("a_set", "b_set"))
        return pairs.where(both >= similarity * (F.size("a_set") + F.size("b_set") - both) - 1e-9).select("a", "b")

    links = written(similar(tried), "links")
    roots = components(links)
    named = written(met.join(roots, met["text_hash"] == roots["node"], "left").select("key", "text_hash", "n_shingles", F.coalesce("root", "text_hash").alias("root")), "texts-of-keys")
    rest = written(links_of_keys(named, sets, similarity), "links")
    if not rest.isEmpty():
        roots = components(links.union(rest))
    dropped(shared, met, tried, sets, links, named, rest)

    # Only texts with a link are in roots; a root itself is added to its own component.
    members = roots.union(roots.select("root", "root").distinct()).toDF("text_hash", "root").distinct()
    member = written(members.join(distinct.select("text_hash", "first"), "text_hash"), "linked-texts")
    group = member.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n_members"))
    linked = join_skewed(member.select("text_hash", "root"), group, "root", "n_members", member.count()).select("text_hash", "root", "component_id")
    by_text = distinct.join(linked, "text_hash", "left").select("text_hash", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("root", "text_hash").alias("root"), F.col("n_same").alias("weight"))
    out = written(join_skewed(each.select("doc_id", "text_hash"), by_text, "text_hash", "weight", each.count()), "copies")
    dropped(each, distinct, roots, member)
    return out
