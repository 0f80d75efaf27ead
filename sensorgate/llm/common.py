"""Registry of the corpus queries and small helpers that several operators use."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgate.session import prepare, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORD_VOCAB = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCAB = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def wrap(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(prepare(spark), folder.rstrip("/"))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return f

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and whole texts; a null text is an empty one."""
    return table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later steps prune columns and no lineage is replayed."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc32(ids) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.asarray(ids).astype("<u4").tobytes())


def in_slices(batches, rows: int = 256):
    """Arrow batches cut by rows, so that a worker turns few texts at once into Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def freeing(cached: Callable):
    """For functions over Arrow batches: a worker gives back what ``cached`` (an ``lru_cache``) holds when a task has ended.

    Python workers outlive their tasks, and those of one stage wait beside those of the next.
    """

    def wrap(run):
        def go(batches):
            yield from run(batches)
            cached.cache_clear()
            pa.default_memory_pool().release_unused()

        return go

    return wrap
