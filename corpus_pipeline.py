"""From raw documents to packed training sequences in four stages, each of them one operator of ``sensorgate.llm``.

A stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with all columns; the last one returns the
pieces of the packed sequences. ``run`` writes every result to the shared folder and reads it back, so a stage works on
all that its predecessor kept and a lost executor never repeats an earlier stage.

There is no SQL for the result: the first stage fits a model. Tests compare the stages with brute force on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgate.llm import minhash, packing, quality, suffixes
from sensorgate.llm.common import stored
from sensorgate.session import prepare

#: A passage of over fifty words is longer than this many bytes.
PASSAGE = 200


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier rejects go: those of low probability to be of the best grade."""
    labels = prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality.kept(docs, quality.train(docs, quality.graded(labels)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one of the smallest id."""
    prepare(spark)
    return minhash.without_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that were seen before in the order of ids are cut; the first copy and every document stay."""
    prepare(spark)
    out = suffixes.remove_repeats(docs, PASSAGE, first=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids."""
    prepare(spark)
    return packing.pack_documents(docs)


STAGES = [("quality", select_quality), ("near_duplicates", drop_near_duplicates), ("repeats", cut_repeats), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
