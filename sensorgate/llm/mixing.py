"""Mix sources to target weights by capped water-filling, in SQL functions only.

Sources in code-point order (null last) get weights in turn and share a budget of words by weight. No source gives more
than ``EPOCHS`` times its own size: sources above that are clamped, their excess goes to the others in proportion to
their weights, and so on until none is above. A round is one aggregate over the sources and carries one number, the
words for one unit of weight; it never falls, so the rounds end.

A source's target over its size is the number of epochs of its documents: the whole ones for all of them, and the
fraction as one more repetition of the documents whose spot (60 bits of a seeded hash of the id) lies below the source's
limit. The limit is the one whose sum of sizes comes nearest to what is wanted. It is found by refinement: a round sums
the sizes of ``1 << STEP`` ranges of spots for each source, and only the range that holds the wanted sum goes on. So a
source of any share of the rows is never sorted, the sum misses the target by half a document at most, and the draw
depends on the seed and the ids alone.

Defined cases: a null text has no words; a null source is a source, the last one; documents of one id have one spot and
are drawn together (null ids are told apart by their texts); equal distances to the target take the smaller sum; sources
without words have target 0; without any words all targets are 0; an empty table gives no row; other columns are ignored
by ``plan_mix`` and kept by ``draw``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorgate.llm.common import query, stored, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
EPOCHS, SEED = 3, 11
BITS, STEP = 60, 12
#: Rows of a range that are summed one by one, and sources of one block of the numbering.
FEW, BLOCK = 10_000, 100_000


def words(text: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def spot(doc_id: str, text: str, seed: int) -> Column:
    """Where a document lies in the order of the draw."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))))
    return F.conv(F.substring(F.md5(F.encode(key, "UTF-8")), 1, BITS // 4), 16, 10).cast("long")


def _numbered(sources: DataFrame) -> DataFrame:
    """Add ``place``, from 0 in code-point order, null last: row numbers within ranges, after the sizes of the ranges before."""
    ranges = max(1, math.ceil(sources.count() / BLOCK))
    cut = stored(sources.repartitionByRange(ranges, F.asc_nulls_last("source")).withColumn("block", F.spark_partition_id()), "sources")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    offsets = cut.groupBy("block").count().select("block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("block").orderBy(F.asc_nulls_last("source"))
    return cut.withColumn("place", F.row_number().over(within) - 1).join(offsets, "block").withColumn("place", F.col("place") + F.col("offset")).drop("block", "offset")


def targets(sources: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS, share: float = 1.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: ``share`` of all words, shared by capped weights."""
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = stored(_numbered(sources).select("source", "source_size", turn.alias("weight"), (epochs * F.col("source_size")).cast("double").alias("cap")), "weights")
    budget = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        clamped = F.col("cap") <= F.lit(level) * F.col("weight")
        spent, free = rows.agg(F.sum(F.when(clamped, F.col("cap"))), F.sum(F.when(~clamped, F.col("weight")))).first()
        higher = (budget - (spent or 0.0)) / free if free else level
        if not higher > level:
            break
        level = higher
    return rows.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def _limits(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``source, limit``: spots below the limit have the sum of sizes nearest to ``want``.

    ``rows`` has ``source, size, spot``, ``wanted`` has ``source, want`` with want below the source's size.
    """
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    # The range that is open: its first spot and the sum of sizes before it.
    opened = wanted.select("source", "want", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("before"))
    shift = BITS
    along = Window.partitionBy("source").orderBy("range")
    while True:
        width = shift
        shift = max(0, shift - STEP)
        inside = rows.alias("r").join(opened.alias("o"), same(rows, opened)).where(F.expr(f"shiftright(r.spot - o.low, {width}) = 0"))
        inside = inside.select("o.source", "want", "before", "low", "size", F.expr(f"shiftright(r.spot - o.low, {shift})").alias("range"))
        sums = inside.groupBy("source", "range").agg(F.sum("size").alias("sum"), F.count("*").alias("rows"), F.first("want").alias("want"), F.first("before").alias("before"), F.first("low").alias("low"))
        sums = sums.withColumn("through", F.col("before") + F.sum("sum").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        held = sums.where("through > want").groupBy("source").agg(F.min_by(F.struct("want", (F.col("low") + F.shiftleft("range", shift)).alias("low"), (F.col("through") - F.col("sum")).alias("before"), "rows"), "range").alias("h"))
        opened = stored(held.select("source", "h.*"), "ranges")
        most = opened.agg(F.max("rows")).first()[0]
        if most is None or most <= FEW or shift == 0:
            break
    inside = rows.alias("r").join(opened.alias("o"), same(rows, opened)).where(F.expr(f"shiftright(r.spot - o.low, {shift}) = 0"))
    sums = inside.groupBy("o.source", "spot").agg(F.sum("size").alias("sum"), F.first("want").alias("want"), F.first("before").alias("before"), F.first("low").alias("low"))
    sums = sums.withColumn("through", F.col("before") + F.sum("sum").over(Window.partitionBy("source").orderBy("spot").rowsBetween(Window.unboundedPreceding, 0)))
    end = F.struct("through", (F.col("spot") + 1).alias("limit"))
    ends = sums.groupBy("source").agg(
        F.first("want").alias("want"),
        F.coalesce(F.max(F.when(F.expr("through <= want"), end)), F.first(F.struct(F.col("before").alias("through"), F.col("low").alias("limit")))).alias("under"),
        F.min(F.when(F.expr("through > want"), end)).alias("over"),
    )
    return ends.select("source", F.expr("if(over.through - want < want - under.through, over.limit, under.limit)").alias("limit"))


def plan_mix(docs: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS, share: float = 1.0, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Sizes and spots of all documents (``doc_id, source, size, spot``), and the plan: one row per source with
    ``source_size, target``, the whole epochs and the limit of the one more."""
    rows = stored(docs.select("doc_id", "source", words("text").alias("size"), spot("doc_id", "text", seed).alias("spot")), "sizes")
    shares = stored(targets(stored(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sums"), weights, epochs, share), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    shares = shares.withColumn("whole", whole)
    limits = _limits(rows, shares.where("source_size > 0").select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("want")))
    plan = shares.alias("s").join(limits.alias("l"), F.col("s.source").eqNullSafe(F.col("l.source")), "left").select("s.*", F.coalesce("l.limit", F.lit(0)).alias("limit"))
    return rows, stored(plan, "plan")


def repetitions(spots: Column, epochs: float = EPOCHS) -> Column:
    """How often a document is taken, beside its source's row of the plan; never more than ``epochs``."""
    return F.least(F.col("whole") + (spots < F.col("limit")).cast("long"), F.lit(math.floor(epochs)).cast("long"))


def draw(docs: DataFrame, plan: DataFrame, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: every document, with all its columns, as often as the plan takes it."""
    plan = plan.select(F.col("source").alias("_of"), "whole", "limit")
    kept = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("source").alias("_from"), spot("doc_id", "text", seed).alias("_spot"))
    taken = kept.join(plan, F.col("_from").eqNullSafe(F.col("_of"))).withColumn("_times", repetitions(F.col("_spot"), epochs)).where("_times > 0")
    return taken.select(F.explode(F.expr("sequence(1L, _times)")), "_doc").select("_doc.*")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || md5('11:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))))[1:15])::BIGINT AS spot FROM documents
), sources AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)
), weights AS (
  SELECT source, source_size, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3.0::DOUBLE * source_size AS cap FROM sources
), ordered AS (
  -- With the sources of least cap for their weight clamped, the level is right where it is highest.
  SELECT coalesce(sum(cap) OVER before, 0) AS spent, sum(weight) OVER after AS free FROM weights WHERE source_size > 0
  WINDOW before AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    after AS (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT coalesce(max(((SELECT sum(source_size)::DOUBLE FROM sources) - spent) / free), 0) AS level FROM ordered
), shares AS (
  SELECT source, source_size, least(cap, level * weight) AS target FROM weights, level
), wants AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM shares
), spots AS (
  SELECT source, spot, sum(sum(size)) OVER (PARTITION BY source ORDER BY spot)::BIGINT AS through FROM sized GROUP BY source, spot
), near AS (
  SELECT w.source, max(w.target - w.whole * w.source_size) AS want, coalesce(max(through) FILTER (through <= w.target - w.whole * w.source_size), 0) AS under,
    min(through) FILTER (through > w.target - w.whole * w.source_size) AS over
  FROM wants w JOIN spots s ON w.source IS NOT DISTINCT FROM s.source GROUP BY w.source
)
SELECT d.doc_id, d.size, w.source_size, w.target,
  d.size * (w.whole + CASE WHEN s.through <= (CASE WHEN n.over - n.want < n.want - n.under THEN n.over ELSE n.under END) THEN 1 ELSE 0 END) AS taken
FROM sized d JOIN wants w ON d.source IS NOT DISTINCT FROM w.source JOIN near n ON d.source IS NOT DISTINCT FROM n.source
  JOIN spots s ON d.source IS NOT DISTINCT FROM s.source AND d.spot = s.spot
"""


@query("op12_mixing", SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    rows, plan = plan_mix(table(spark, folder, "documents"))
    taken = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * repetitions(F.col("spot"))).alias("taken"))
