"""Chapters that arrive as a stream: compiled as they come, with a manifest of what has been done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators.dialogue import compile_utterances
from quillstream.operators.render import text_hash

KEYS = ["book_id", "chapter_index"]
MANIFEST = "book_id string, chapter_index long, text_hash string, batch long"


def latest_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The last entry of each chapter; each batch added a folder of its own."""
    try:
        entries = spark.read.schema(MANIFEST).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        entries = spark.createDataFrame([], MANIFEST)
    return entries.groupBy(*KEYS).agg(F.max_by(F.struct("text_hash", "batch"), "batch").alias("e")).select(*KEYS, "e.*")


def current_utterances(spark: SparkSession, output: str, manifest: str) -> DataFrame:
    """The utterances of each chapter's last batch."""
    return spark.read.parquet(output).join(latest_manifest(spark, manifest).select(*KEYS, "batch"), [*KEYS, "batch"]).drop("batch", "part")


def run(chapters: DataFrame, output: str, manifest: str, checkpoint: str) -> None:
    """Takes what is there of a stream of chapters (book_id, chapter_index, raw_text), and stops.

    A chapter whose text the manifest has already is passed over.  A batch writes folders that bear its number, so
    a batch that is run again replaces its own rows alone.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.withColumn("text_hash", text_hash(F.col("raw_text"))).dropDuplicates([*KEYS, "text_hash"])
        # What other batches have done; this one's own entries, of a run that failed, don't count.
        known = latest_manifest(spark, manifest).where(F.col("batch") != number).select(*KEYS, "text_hash")
        new = last.join(known, [*KEYS, "text_hash"], "left_anti")
        compile_utterances(new).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{output}/part={number}")
        new.select(*KEYS, "text_hash", F.lit(number).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{manifest}/part={number}")

    chapters.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
