"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.  run() writes each stage's result in the shared folder and rereads
it as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import decontam, packing, pii, quality, simhash
from quillstream.llm.common import table, written


#: What an operator gets of the documents, and what tells rows apart.
OWN = ("doc_id", "text")


def _apart(docs: DataFrame) -> DataFrame:
    """doc_id, text, and _row with all columns, which no operator's own columns can then replace."""
    return docs.select(*OWN, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.assess(_apart(docs), table(spark, sf_dir, "labels")).where("kept").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each component of near-duplicates."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a test item."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars is that of the new text."""
    masked = pii.annotate(_apart(docs), mask=True)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return masked.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their ids and places in sequences."""
    import public_tokenizers

    packed = packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)
    return packed.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: No stage but the first could be put in SQL; tests/llm holds each stage against brute force or planted cases, and run() against its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
