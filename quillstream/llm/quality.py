"""Quality rules by hashed n-gram log-likelihood ratios (operator 1).  Built-in functions only.

Words and pairs of words are hashed into BUCKETS; two multinomials over the buckets
are counted, one over trusted documents (labels.quality = 1), one over all documents.
A document's score is the mean log ratio of its n-grams' shares; documents under
a cut go, which comes from the labelled documents' scores.  Base rules on length and
repetition come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import BLANKS, in_sample, let, settled, words, written

#: Trusted documents that make the target, about, if there are more.
SAMPLE_DOCS = 20_000
#: Hash buckets, pseudo-counts per bucket, and the least mean log ratio that is kept where labels don't say.
BUCKETS, SMOOTHING, THRESHOLD = 1 << 16, 0.5, -0.3
#: Digits of a ratio after the point.
DIGITS = 4
#: The base rules: fewer words fail, and so does a larger percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
#: Labelled documents of each kind from which a cut is derived; steps of a score in which they are counted.
LEAST_LABELLED, STEPS = 20, 1000


def neighbours(hashes: Column) -> Column:
    """A hash for every two words next to each other."""
    return F.zip_with(F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))), F.slice(hashes, 2, F.greatest(F.size(hashes), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def repeated_words(hashes: Column, pairs: Column) -> Column:
    """How many words stand in three-word windows that the text has twice or more, from hashes of words and of their pairs."""

    def counted(found: Column) -> Column:
        """Windows that occur again, found next to each other once sorted; each adds the words that the one before does not cover."""
        ordered = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, i, j: F.coalesce(F.get(s, j)["h"] == F.get(s, i)["h"], F.lit(False))
        places = let(ordered, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: same(s, i, i - 1) | same(s, i, i + 1)), lambda x: x["i"])))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    windows = F.zip_with(F.slice(pairs, 1, F.greatest(F.size(pairs) - 1, F.lit(0))), F.slice(hashes, 3, F.greatest(F.size(hashes), F.lit(1))), lambda p, c: F.xxhash64(p, c))
    return F.when(F.size(hashes) < 3, F.lit(0)).otherwise(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(counted(h))))


def bucket(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(BUCKETS)).cast("int")


def trusted_sample(labels: DataFrame) -> DataFrame:
    """The trusted documents whose counts make the target: all, or about SAMPLE_DOCS, by their hashes."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good.where(in_sample(F.xxhash64("doc_id"), SAMPLE_DOCS, good.count()))


def ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket and ratio, the log ratio of its share in trusted documents to that in all, for every bucket; all 0 without trusted words.

    Every row counts.  A text is trusted if one of its documents is, and then all its copies are, so that a clean text that is
    copied often weighs as much on one side as on the other.
    """
    text_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    sample = F.broadcast(trusted_sample(labels).select(F.col("doc_id").alias("_trusted")))  # about SAMPLE_DOCS rows at most
    known = docs.select(F.col("doc_id").cast("long").alias("_doc_id"), text_hash.alias("_hash")).join(sample, F.col("_doc_id") == F.col("_trusted"))
    # One text of each trusted doc_id, so that they are no more than the sample.
    trusted = F.broadcast(known.groupBy("_doc_id").agg(F.min("_hash").alias("_good")).select("_good").distinct())
    rows = docs.select(text_hash.alias("_hash"), F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    found = rows.join(trusted, F.col("_hash") == F.col("_good"), "left").select(F.col("_good").isNotNull().alias("good"), "w")
    pairs = found.select("good", F.inline(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))))
    grams = pairs.select("good", F.explode(F.array(bucket(F.col("a")), F.when(F.col("b").isNotNull(), bucket(F.xxhash64("a", "b"))))).alias("bucket")).where("bucket is not null")
    counts = written(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("good").alias("target")), "ngram-counts")
    totals = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    share = lambda c: F.log((F.coalesce(F.col(c), F.lit(0)) + SMOOTHING) / ((totals[c] or 0) + SMOOTHING * BUCKETS))
    ratio = share("target") - share("raw") if totals["target"] else F.lit(0.0)
    return docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").select("bucket", ratio.alias("ratio"))


def derived_cut(steps: list[tuple[int, int, int]]) -> float:
    """The least score that is kept, from (step, clean documents, junk documents) of the labelled ones that pass the base rules.

    It is the first step above the junk at which the fewest labelled documents are on the wrong side: the clean ones' own
    words are in the target, so other clean documents may score less than they do.  THRESHOLD if there are too few of a kind.
    """
    steps = sorted(steps)
    junk = sum(j for _, _, j in steps)
    if min(junk, sum(c for _, c, _ in steps)) < LEAST_LABELLED:
        return THRESHOLD
    wrong, cut, least = junk, steps[0][0], junk
    for step, clean, bad in steps:
        wrong += clean - bad
        if wrong < least:
            least, cut = wrong, step + 1
    return cut / STEPS


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text and any other columns) with the base measures, base_failed, score and kept.

    n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words are as the contract has them; score is the mean log
    ratio (null without a word).  kept is false if base_failed, else score >= derived_cut().  A null text counts as empty
    and fails; rows with one doc_id are judged each; without trusted documents the base rules alone decide; columns of docs
    with the names given here are replaced.
    """
    # The BUCKETS ratios in order, as one constant of the plan, which names it once and with few digits: its text stands in every report of the plan.
    ordered = [f"{r['ratio']:.{DIGITS}f}" for r in ratios(docs, labels).orderBy("bucket").collect()]
    lookup = F.split(F.lit(",".join(ordered)), ",").cast("array<double>")
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])

    def of(hashes: Column) -> Column:
        total = lambda found: F.aggregate(found, F.lit(0.0), lambda a, h: a + F.get(lookup, bucket(h)))
        n = F.size(hashes)
        return let(neighbours(hashes), lambda pairs: F.struct(
            n.cast("long").alias("n_words"), repeated_words(hashes, pairs).cast("long").alias("n_repeat_words"),
            (total(F.concat(hashes, pairs)) / F.nullif(2 * n - 1, F.lit(-1))).alias("score")))

    found = settled(
        docs.select(row.alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(F.transform(words(text), lambda w: F.xxhash64(w)), of).alias("_w"),
    )
    failed = (F.col("_w.n_words") < LEAST_WORDS) | (100 * F.col("_w.n_repeat_words") > MOST_REPEATED * F.col("_w.n_words"))
    judged = written(found.select("_row", F.col("_id"), "_w.n_words", "word_chars", "n_symbols", "n_dup_lines", "_w.n_repeat_words", failed.alias("base_failed"), "_w.score"), "judged-documents")
    sides = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    scores = judged.where("not base_failed and score is not null").select("_id", F.floor(F.col("score") * STEPS).cast("long").alias("step")).join(sides, "_id")
    steps = scores.groupBy("step").agg(F.sum(F.col("low")).alias("clean"), F.sum(1 - F.col("low")).alias("junk")).collect()  # a row for each thousandth of a score
    kept = ~F.col("base_failed") & F.coalesce(F.col("score") >= derived_cut([tuple(r) for r in steps]), F.lit(True))
    return judged.select("_row.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", kept.alias("kept"))
