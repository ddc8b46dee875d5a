"""Helpers that several operators share."""

from __future__ import annotations

import os
import pickle
import sys
import tempfile
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words in the contracts: space, and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Only where that is unset and all runs on one
    machine, as in tests, a folder of this machine is set and used; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "quillstream-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, from a table written in the shared folder.

    This cuts the lineage and survives lost executors; later steps read the columns they need.
    """
    path = f"{shared_folder(df.sparkSession)}/quillstream/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes tables that written() gave, once nothing that is yet to run reads them."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sent(spark: SparkSession, value):
    """A broadcast of value, its class pickled by value like the functions that use it; received() gives it back on executors."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(broadcast):
    return pickle.loads(broadcast.value)


def in_sample(draw: Column, n: int, total: int) -> Column:
    """Whether a row is in a sample of about n of total rows, by a hash of it; all are if there are no more.

    A bound on the hash, unlike a sort and a limit, brings no more rows together than it keeps.
    """
    return F.lit(True) if total <= n else F.pmod(draw, F.lit(1 << 31)) < F.lit(max(1, n * (1 << 31) // total))


def let(value: Column, use) -> Column:
    """use(value), with value worked out once for each row however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """The words of the contracts, ``[^\\x20\\x09-\\x0D]+``, in order; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS)), " "), "")


def fold_case(text: Column) -> Column:
    """Lower case for A to Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def byte_slices(batch, column: str = "text", most: int = 4_000_000):
    """Parts of an Arrow batch with about ``most`` bytes of text each; a longer text makes a part alone."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(size) // most
    edges = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *edges], [*edges, batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


def join_skewed(facts: DataFrame, dim: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """facts joined to dim on key, where a few keys may hold most facts.

    dim has one row per key, and ``weight`` says how many of the ``total`` facts have it.  The keys, which are numbers,
    with over a thousandth of the facts, so a thousand at most, are a constant of the plan, and their rows of dim are
    broadcast; all others are joined by a shuffle, which facts of hot keys take no part in.
    """
    often = F.col(weight) * 1000 > total
    hot = [r[0] for r in dim.where(often).select(key).collect()]
    if not hot:
        return facts.join(dim.drop(weight), key)
    few = facts.where(F.col(key).isin(hot)).join(F.broadcast(dim.where(often).drop(weight)), key)
    many = facts.where(~F.col(key).isin(hot)).join(dim.where(~often).drop(weight), key)
    return few.unionByName(many)


def once_a_process(key: tuple, make):
    """make(), kept under key for as long as this Python worker lives; functions sent by value have no globals that last."""
    kept = sys.modules.setdefault("_quillstream_kept", types.ModuleType("_quillstream_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def tidy(run):
    """run, a function over Arrow batches, which at its end gives back to the system what memory it no longer uses.

    Workers outlive their tasks, and an executor has several: what their allocators keep would add up.
    """

    def tidied(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return tidied


def settled(df: DataFrame, *columns: Column) -> DataFrame:
    """df with columns worked out once for each row.

    A filter above a plain projection is pushed below it and works its columns out again for every mention; it
    can't be pushed below a generator.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*columns))))
