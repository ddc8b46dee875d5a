"""Small tables that operators are held against: nulls, empty and long texts, repeated rows and clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOWELS, STOPS = "aeiou", "bcdfglmnprst"


def vocabulary(seed: int, n: int = 400) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(STOPS) + rng.choice(VOWELS) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(rng: random.Random, words: list[str], n: int) -> str:
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    rng, words = random.Random(seed), vocabulary(seed)
    rows = [(k, prose(rng, words, rng.randint(60, 200)), "en", f"s{k % 3}", 0) for k in range(n)]
    rows[5] = (5, rows[4][1], "en", "s0", 0)  # a copy
    rows[7] = (7, None, None, None, None)
    rows[8] = (8, "", "en", "s0", 0)
    rows[9] = (9, " \t\n ", "en", "s0", 0)
    rows[10] = (10, "one", "en", "s0", 3)
    rows[11] = (11, prose(rng, words, 30_000), "en", "s1", 0)  # a long one
    rows[12] = (None, rows[13][1], None, "s1", 0)
    rows.append(rows[4])  # the same row again
    rows.append((20, "another text with the id of an other row " * 9, "en", "s2", 0))
    return rows


def frame(spark, rows=None, schema=SCHEMA):
    return spark.createDataFrame(documents() if rows is None else rows, schema)


def clashing(docs, *names):
    """docs with more columns, named like those that operators make."""
    from pyspark.sql import functions as F

    for n in ("score", "kept", "shard", "slot", "fp", "component_id", "spans", "labels", "held_out", "key", "value", "text_hash", "piece", "_text", "_w", "_row", "_doc_id", "_text_hash", "n_words", "count", *names):
        docs = docs.withColumn(n, F.lit("own"))
    return docs


LABELS = "doc_id long, quality int, toxic int"
