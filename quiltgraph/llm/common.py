"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from uuid import uuid4

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of two numbers that may be broadcast, 32 MB of them.
BROADCAST_ROWS = 1 << 21
#: Bytes of rows that ``small_batches`` lets go to a Python worker at once, and the setting that limits them.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: ``[\x20\x09-\x0D]``, the white space of every word contract, in Java syntax.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Only ``columns`` of a table, so that further columns can't clash."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: the one named in ``spark.checkpoint.dir``.

    Where that is unset, as in tests on one machine, a temporary folder is made once.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quilt-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stage_written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder, and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name.replace(' ', '-')}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small(ids: DataFrame) -> DataFrame:
    """``ids``, checkpointed rows of a few numbers, to be broadcast if they are ``BROADCAST_ROWS`` or fewer; beyond that, to be joined as they are."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python workers in batches of ``BATCH_BYTES`` and a row at most, unless the session has a limit of its own.

    Each task holds its batch outside the heap and again in its worker. Under
    Spark's limits, 10,000 rows and 64 MB, texts of 3 KB make batches of 30 MB.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def gram_hashes(words: list[bytes], gram: int) -> np.ndarray:
    """Hashes of the runs of ``gram`` words."""
    n = len(words)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    grams = np.zeros(n - gram + 1, dtype=np.uint64)
    for k in range(gram):
        grams *= np.uint64(0x9E3779B97F4A7C15)
        grams += hashes[k : n - gram + 1 + k]
        grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    return grams
