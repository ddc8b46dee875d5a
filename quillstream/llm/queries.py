"""The registered queries of the operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quillstream.llm import decontam, langid, licenses, packing, pii, quality, repair, sharding, simhash, toxicity
from quillstream.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return sharding.shuffle_into_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 9))


def op9_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = repair.write_shards(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return repair.read_shards(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.annotate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_sharding, op3_toxicity, op4_decontamination, op5_best_fit_packing, op6_language_id, op7_simhash, op8_license_scan, op9_repair_tokens, op10_personal_data, pipeline)}


def _license_sql() -> str:
    """The scan of licences over documents with different doc_ids, written from the rules."""
    quoted = lambda x: "'" + x + "'"
    has = lambda p: f"contains(norm, ' {p} ')"
    verified = "list_filter([" + ", ".join(f"CASE WHEN {' AND '.join(map(has, phrases))} THEN {t} ELSE -1 END" for t, (_, _, phrases) in enumerate(licenses.TEMPLATES)) + "], lambda t: t >= 0)"
    places = ", ".join(f"({t}, {quoted(label)}, {quoted(w)}, {k})" for t, (label, text, _) in enumerate(licenses.TEMPLATES) for k, w in enumerate(text.split()))
    starts = " || ".join("list_filter(range(len(ws)), lambda k: " + " AND ".join(f"ws[k + {i}] = {quoted(w)}" for i, w in enumerate(p.split(), 1)) + ")" for p, _ in licenses.BASE)
    base = "list_filter([" + ", ".join(f"CASE WHEN {has(p)} THEN {quoted(label)} ELSE '' END" for p, label in licenses.BASE) + "], lambda x: x <> '')"
    return f"""WITH normal AS (SELECT doc_id, ' ' || trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g')) || ' ' AS norm FROM documents),
split AS (SELECT doc_id, norm, list_filter(string_split(norm, ' '), lambda w: w <> '') AS ws, {verified} AS verified FROM normal),
idx(t, label, word, spot) AS (VALUES {places}),
vocabulary AS (SELECT DISTINCT word FROM idx),
counted AS (SELECT v.word, count(d.doc_id) AS df FROM vocabulary v LEFT JOIN (SELECT DISTINCT doc_id, unnest(ws) AS word FROM split) d ON d.word = v.word GROUP BY v.word),
weighed AS (SELECT word, ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1.0)) + 0.01 AS weight FROM counted),
candidates AS (SELECT doc_id, ws, verified FROM split WHERE len(verified) > 0),
found AS (SELECT DISTINCT c.doc_id, w.word, w.weight FROM (SELECT doc_id, unnest(ws) AS word FROM candidates) c JOIN weighed w ON c.word = w.word),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, word) AS r FROM found),
rare AS (SELECT doc_id, word, weight FROM ranked WHERE r <= {licenses.LOOKED_UP}),
placed AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS place FROM candidates),
met AS (SELECT p.doc_id, i.t, i.label, p.place - i.spot AS relative, r.weight FROM placed p JOIN rare r ON p.doc_id = r.doc_id AND p.word = r.word JOIN idx i ON i.word = p.word JOIN candidates c ON c.doc_id = p.doc_id WHERE list_contains(c.verified, i.t)),
aligned AS (SELECT doc_id, t, label, relative, sum(weight) AS weight FROM met GROUP BY doc_id, t, label, relative),
sought AS (SELECT r.doc_id, i.t, sum(r.weight) AS weight FROM rare r JOIN idx i ON i.word = r.word GROUP BY r.doc_id, i.t),
shares AS (SELECT a.doc_id, a.t, a.label, max(a.weight) / max(s.weight) AS share FROM aligned a JOIN sought s ON a.doc_id = s.doc_id AND a.t = s.t GROUP BY a.doc_id, a.t, a.label),
method AS (SELECT doc_id, max(share) AS best, list(label) FILTER (share >= {licenses.THRESHOLD}) AS labels FROM shares GROUP BY doc_id),
based AS (SELECT doc_id, len(ws) AS n_words, {starts} AS starts, {base} AS base FROM split)
SELECT b.doc_id, CAST(b.n_words AS BIGINT) AS n_words, CAST(len(b.starts) AS BIGINT) AS n_base, CAST(list_min(b.starts) AS BIGINT) AS first_word, CAST(list_max(b.starts) AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(b.base)), ',') AS base_labels, array_to_string(list_sort(list_distinct(b.base || coalesce(m.labels, []))), ',') AS labels,
  CASE WHEN len(b.base) > 0 THEN CAST(1 AS DOUBLE) ELSE round(least(coalesce(m.best, 0.0), 1.0), 9) END AS score FROM based b LEFT JOIN method m ON b.doc_id = m.doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; tests/llm holds the others against brute force."""
    return {"op8_license_scan": _license_sql()}
