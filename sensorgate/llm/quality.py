"""Ordinal cumulative-link regression on graded ratings.

A text becomes hashed features: its words and runs of symbols in lower case, and a few tokens for its shape (share of
repeated neighbours, of the most frequent word, of symbols and of capitals, in steps). One weight vector is shared by all
grades; ordered thresholds cut the score: P(grade <= k) = 1 / (1 + exp(score - threshold_k)). So one model gives the
expected grade and every tail probability P(grade >= k), and selection asks for one of these.

Fitting uses at most ``sample`` rated rows of each grade, those with the smallest hashes of their ids; that bound is the
only one. Features of the sample are made by Spark; the convex fit itself runs over those bounded rows on the driver.
Scoring maps over all rows with the weights (2**18 floats) as a broadcast.

Defined cases: a null or empty text has only its shape tokens; equal texts get equal scores; texts of any length count
whole; rated rows with a null rating or no text are left out; with fewer than two grades among the ratings all weights
stay 0; an empty table gives no row; columns named like the results are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from sensorgate.llm.common import freeing, query, table

DIMENSIONS = 1 << 18
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def _step(x: float) -> int:
    """Steps of a share: fine near 0."""
    return int(np.sqrt(min(max(x, 0.0), 1.0)) * 10)


class Featurizer:
    def __init__(self, most: int = 300_000):
        self.most, self.known = most, {}

    def _index(self, token: str) -> int:
        i = self.known.get(token)
        if i is None:
            if len(self.known) >= self.most:
                self.known.clear()
            i = zlib.crc32(token.encode("utf-8", "surrogatepass")) % DIMENSIONS
            if len(token) <= 64:
                self.known[token] = i
        return i

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and their values: 1 + ln(count) of a word, 1 of a shape token, scaled to one length."""
        tokens = _TOKEN.findall(text.lower())
        n, counts, index = len(tokens), Counter(tokens), self._index
        at = [index(t) for t in counts]
        value = 1 + np.log(np.fromiter(counts.values(), float, len(counts)))
        letters = max(1, len(text))
        shape = {
            "same": sum(map(eq, tokens, tokens[1:])) / max(n, 1),
            "top": max(counts.values(), default=0) / max(n, 1) if n > 30 else 0.0,
            "new": len(counts) / max(n, 1) if n > 30 else 1.0,
            "caps": sum(map(str.isupper, text)) / letters,
            "signs": sum(c * (not t[0].isalnum()) for t, c in counts.items()) / max(n, 1),
        }
        at += [index(f"\n{k} {_step(v)}") for k, v in shape.items()]
        value = np.concatenate([value, np.ones(len(shape))])
        value *= LENGTH / np.sqrt((value**2).sum())
        return np.array(at, np.int32), value.astype(np.float32)


@lru_cache(maxsize=1)
def featurizer() -> Featurizer:
    """One for a task."""
    return Featurizer()


BUCKETS = 256  # of each grade, for the sample
LENGTH = 4.0  # of every feature vector: a text's length in words doesn't move its score
FEATURES = pa.schema([("grade", pa.int32()), ("place", pa.int64()), ("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; threshold k parts the grades up to k from those above

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


def fit(flat: np.ndarray, x: np.ndarray, sizes: np.ndarray, grade: np.ndarray, grades: int, penalty: float = 3e-4, steps: int = 200, least: int = 8) -> OrdinalModel:
    """Features of all texts in a row (numbers, values), how many each has, and its grade.

    Penalised maximum likelihood with grades weighted to equal shares; gradient steps with momentum and scaling.

    Features of fewer than ``least`` rated texts keep the weight 0: one text's own words say nothing about another.
    Thresholds are a first one and logarithms of gaps, so they stay in order.
    """
    if not len(grade) or len(np.unique(grade)) < 2:
        return OrdinalModel(np.zeros(DIMENSIONS, np.float32), np.arange(grades - 1, dtype=float))
    often = np.bincount(flat, minlength=DIMENSIONS) >= least
    used, number = np.flatnonzero(often), np.cumsum(often, dtype=np.int32) - 1
    kept = often[flat]
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[kept]
    flat, x = number[flat[kept]], x[kept]
    del kept
    share = 1 / np.bincount(grade, minlength=grades).clip(1)
    mass = share[grade] / share[grade].sum()
    p = np.zeros(len(used) + grades - 1)
    p[len(used)] = -1.0
    first, second = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, cuts = p[: len(used)], p[len(used)] + np.concatenate([[0], np.cumsum(np.exp(p[len(used) + 1 :]))])
        score = np.bincount(row, w[flat] * x, len(sizes))
        ends = np.concatenate([[-np.inf], cuts, [np.inf]])
        upper = 1 / (1 + np.exp(np.clip(score - ends[grade + 1], -50, 50)))  # P(grade <= own)
        lower = 1 / (1 + np.exp(np.clip(score - ends[grade], -50, 50)))
        hit = np.maximum(upper - lower, 1e-12)
        up, low = upper * (1 - upper) / hit * mass, lower * (1 - lower) / hit * mass
        by_cut = np.bincount(grade, up, grades)[: grades - 1] - np.bincount(grade, low, grades)[1:]  # d log-likelihood / d cut
        slope = np.empty_like(p)
        slope[: len(used)] = np.bincount(flat, ((up - low)[row]) * x, len(used)) + penalty * w
        slope[len(used)] = -by_cut.sum()
        slope[len(used) + 1 :] = -np.cumsum(by_cut[::-1])[::-1][1:] * np.exp(p[len(used) + 1 :])
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        p -= 0.2 * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-10)
    weights = np.zeros(DIMENSIONS, np.float32)
    weights[used] = p[: len(used)]
    return OrdinalModel(weights, p[len(used)] + np.concatenate([[0], np.cumsum(np.exp(p[len(used) + 1 :]))]))


def train(docs: DataFrame, ratings: DataFrame, grade: str = "grade", grades: int = 3, sample: int = 4000) -> OrdinalModel:
    """Fit on at most ``sample`` rows of each grade of ``ratings`` (doc_id, grade 0..grades-1)."""
    rated = ratings.select("doc_id", F.col(grade).cast("int").alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL")
    rated = rated.groupBy("doc_id").agg(F.max("grade").alias("grade"))  # repeated ratings of a document count once
    # Within buckets of a grade first: a common grade's rows never meet in one task.
    rated = rated.withColumn("place", F.xxhash64("doc_id"))
    for group in (["grade", F.pmod("place", F.lit(BUCKETS))], ["grade"]):
        order = Window.partitionBy(*group).orderBy("place", "doc_id")
        rated = rated.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample).drop("_n")
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(rated), "doc_id")

    @freeing(featurizer)
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = featurizer()
        for batch in batches:
            got = [make(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), batch.column("place"), pa.array([g[0] for g in got], FEATURES[2].type), pa.array([g[1] for g in got], FEATURES[3].type)], schema=FEATURES)

    # At most grades * sample rows come here, in an order that does not depend on the tasks.
    made = texts.select("grade", "place", "text").mapInArrow(features, "grade int, place long, at array<int>, value array<float>")
    found = made.orderBy("place", "grade", F.hash("at")).toArrow()
    grade_of = found.column("grade").to_numpy().astype(int)
    flat, sizes = _flat(found.column("at"), np.int32)
    x, _ = _flat(found.column("value"), np.float32)
    del found, made
    return fit(flat, x, sizes, grade_of, grades)


def _flat(lists: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """Elements of all lists in a row, and the sizes of the lists; no Python object for any of them."""
    parts = [c.flatten().to_numpy() for c in lists.chunks]
    sizes = [np.diff(c.offsets.to_numpy()) for c in lists.chunks]
    return np.concatenate([np.zeros(0, kind), *parts]).astype(kind), np.concatenate([np.zeros(0, int), *sizes]).astype(int)


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """All columns of ``docs`` and ``expected_grade``, ``tails`` (P(grade > k) for each k)."""
    kept = docs.drop("expected_grade", "tails")
    schema = StructType([*kept.schema.fields, StructField("expected_grade", DoubleType()), StructField("tails", ArrayType(DoubleType()))])
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    @freeing(featurizer)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, own = featurizer(), OrdinalModel(*sent.value)
        for batch in batches:
            got = [make(t or "") for t in batch.column("text").to_pylist()]
            scores = np.array([float(own.weights[a].astype(float) @ v.astype(float)) for a, v in got])
            tails = own.tails(scores)
            arrays = [pa.array(tails.sum(1)), pa.array(list(tails), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "expected_grade", "tails"])

    return kept.mapInArrow(run, schema)


#: Rejected below this probability of the best grade.
KEEP = 0.3


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from the two labels: 0 poor, 1 well written but toxic, 2 good."""
    poor, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return labels.select("doc_id", F.when(poor, 0).when(toxic, 1).when(F.col("quality").isNotNull(), 2).alias("grade"))


def judged(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with their expected grade, tail probabilities and the decision."""
    model = train(docs, graded(table(spark, folder, "labels")))
    return score(docs, model).withColumn("selected", F.element_at("tails", -1) >= KEEP)


def kept(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The documents that are not rejected, with all their own columns, whatever their names are."""
    names = [c if c == "text" else f"_{k}" for k, c in enumerate(docs.columns)]
    good = score(docs.toDF(*names), model).where(F.element_at("tails", -1) >= KEEP)
    return good.select(*names).toDF(*docs.columns)


@query("op7_quality")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    tails = [F.element_at("tails", k + 1).alias(f"p_at_least_{k + 1}") for k in range(2)]
    return judged(spark, docs, folder).select("doc_id", "expected_grade", *tails, "selected")
