"""Exact quantiles with linear interpolation, for groups of any size.

``percentile`` keeps every distinct value of a group in one buffer. That is right for a group with a known bound
(a week of hours, the dimensions of a vector) and wrong for raw readings, where one group may hold a third of the
table. ``exact_quantiles`` counts equal values first (combined map-side, spread over the cluster by value), finds
the narrow value range which holds each rank, and sorts only those ranges.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorgate.functions.exprs import as_col
from sensorgate.session import cut_lineage

RANGES = 64  # that the values of a group are cut in


def value_ranges(df: DataFrame, keys, value: str, out: str) -> DataFrame:
    """Adds a whole-number range label that does not fall as the value rises within a group.

    Cuts are approximate quantiles of the group's own values, so ranges hold about equal numbers of rows whatever offset
    or scale the values have. Rows should be distinct by value (or counted), as equal values cannot be parted. The cuts are
    written once: merged in another order they may come out otherwise, and labels of two reads of the rows must agree.
    """
    keys = list(keys)
    shares = [k / RANGES for k in range(1, RANGES)]
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, shares, 40 * RANGES).alias("_cuts"))
    cuts = cut_lineage(cuts)
    d = df.join(cuts, keys) if keys else df.withColumn("_cuts", cuts.scalar())
    label = F.size(F.filter("_cuts", lambda c: c < F.col(value))).cast("long")
    return d.withColumn(out, F.coalesce(label, F.lit(0).cast("long"))).drop("_cuts")


def _melt(df: DataFrame, keys, cols: dict) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("_f"), as_col(c).cast("double").alias("_x")) for n, c in cols.items()])
    d = df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p._f", "_p._x")
    return d.filter(F.col("_x").isNotNull() & ~F.isnan("_x"))


def quantiles_long(df: DataFrame, keys, cols: dict, qs) -> DataFrame:
    """Rows ``(keys, _f, _q, _val)`` for each named column and each quantile; groups without a value are absent."""
    keys = list(keys)
    group = [*keys, "_f"]
    counts = _melt(df, keys, cols).groupBy(*group, "_x").agg(F.count("*").alias("_n"))
    counts = value_ranges(counts, group, "_x", "_r")
    ranges = counts.groupBy(*group, "_r").agg(F.sum("_n").alias("_n"))
    along = W.partitionBy(*group).orderBy("_r")
    ranges = ranges.withColumn("_before", F.sum("_n").over(along.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n"))
    ranges = ranges.withColumn("_all", F.sum("_n").over(W.partitionBy(*group)))
    target = F.transform(
        F.array(*[F.lit(float(q)) for q in qs]),
        lambda q, i: F.struct(i.alias("q"), (q * (F.col("_all") - 1)).alias("pos")),
    )
    start, stop = F.col("_before"), F.col("_before") + F.col("_n")

    def inside(s, lo, hi):
        return ((F.floor(s["pos"]) >= lo) & (F.floor(s["pos"]) < hi)) | ((F.ceil(s["pos"]) >= lo) & (F.ceil(s["pos"]) < hi))

    ranges = ranges.select(*group, "_r", "_before", F.filter(target, lambda s: inside(s, start, stop)).alias("_want"))
    ranges = ranges.filter(F.size("_want") > 0)
    upto = W.partitionBy(*group, "_r").orderBy("_x").rowsBetween(W.unboundedPreceding, 0)
    hit = counts.join(ranges, [*group, "_r"]).withColumn("_end", F.col("_before") + F.sum("_n").over(upto))
    first, end = F.col("_end") - F.col("_n"), F.col("_end")
    hit = hit.select(*group, "_x", first.alias("_first"), "_end", F.explode(F.filter("_want", lambda s: inside(s, first, end))).alias("_s"))
    low, high = F.floor("_s.pos"), F.ceil("_s.pos")
    has = lambda at: (at >= F.col("_first")) & (at < F.col("_end"))
    lo, hi = F.max(F.when(has(low), F.col("_x"))), F.max(F.when(has(high), F.col("_x")))
    return hit.groupBy(*group, F.col("_s.q").alias("_q")).agg((lo + (hi - lo) * F.max(F.col("_s.pos") - low)).alias("_val"))


ACCURACY = 640  # of the approximate quantiles on both sides of a wanted rank


def stored_quantiles_long(df: DataFrame, keys, cols: dict, qs) -> DataFrame:
    """The same for rows that are cheap to read again: three reads, and only rows close to a wanted rank are shuffled.

    Approximate quantiles just below and above each rank bound its values; a count of the rows below and between shows
    that they hold the rank. Where they do not, all values of the group are looked at.
    """
    keys, qs = list(keys), [float(q) for q in qs]
    group, x, reach = [*keys, "_f"], F.col("_x"), 2 / ACCURACY
    d = _melt(df, keys, cols)
    shares = [min(max(q + s, 0.0), 1.0) for q in qs for s in (-reach, reach)]
    cuts = d.groupBy(*group).agg(F.percentile_approx("_x", shares, ACCURACY).alias("_c"), F.count("*").alias("_all"))
    names = [f"_{n}{i}" for i in range(len(qs)) for n in ("lo", "hi")]
    cuts = cut_lineage(cuts.select(*group, "_all", *[F.col("_c")[j].alias(n) for j, n in enumerate(names)]))
    between = [(x >= F.col(f"_lo{i}")) & (x <= F.col(f"_hi{i}")) for i in range(len(qs))]
    counted = d.join(cuts, group).groupBy(*group).agg(
        *[F.count_if(x < F.col(f"_lo{i}")).alias(f"_b{i}") for i in range(len(qs))], *[F.count_if(c).alias(f"_n{i}") for i, c in enumerate(between)]
    )
    d0 = cuts.join(counted, group)
    ranks = {}
    for i, q in enumerate(qs):
        pos, before = F.lit(q) * (F.col("_all") - 1), F.col(f"_b{i}")
        holds = (F.floor(pos) >= before) & (F.ceil(pos) < before + F.col(f"_n{i}"))
        ranks |= {f"_pos{i}": pos, f"_b{i}": F.when(holds, before).otherwise(0)}
        ranks |= {f"_lo{i}": F.when(holds, F.col(f"_lo{i}")).otherwise(float("-inf")), f"_hi{i}": F.when(holds, F.col(f"_hi{i}")).otherwise(float("inf"))}
    d0 = cut_lineage(d0.select(*group, *[c.alias(n) for n, c in ranks.items()]))
    near = d.join(d0, group).filter(reduce(or_, between))
    near = near.select(*group, "_x", F.explode(F.array(*[F.when(c, F.struct(F.lit(i).alias("_q"), F.col(f"_pos{i}").alias("_pos"), F.col(f"_b{i}").alias("_b"))) for i, c in enumerate(between)])).alias("_s"))
    near = near.filter("_s IS NOT NULL").groupBy(*group, "_s._q", "_s._pos", "_s._b", "_x").agg(F.count("*").alias("_n"))
    end = F.col("_b") + F.sum("_n").over(W.partitionBy(*group, "_q").orderBy("_x").rowsBetween(W.unboundedPreceding, 0))
    near = near.withColumn("_end", end)
    has = lambda at: F.max(F.when((at >= F.col("_end") - F.col("_n")) & (at < F.col("_end")), x))
    lo, hi = has(F.floor("_pos")), has(F.ceil("_pos"))
    return near.groupBy(*group, "_q", "_pos").agg((lo + (hi - lo) * (F.col("_pos") - F.floor("_pos"))).alias("_val")).drop("_pos")


def exact_quantiles(df: DataFrame, keys, cols: dict, qs, names=None, stored: bool = False) -> DataFrame:
    """One row per group with columns ``<name>_<suffix>``; ``names`` gives the suffixes (default p00..p99).

    ``stored`` rows are read several times instead of being shuffled whole.
    """
    keys, qs = list(keys), list(qs)
    names = names or [f"p{round(q * 100):02d}" for q in qs]
    long = (stored_quantiles_long if stored else quantiles_long)(df, keys, cols, qs).withColumn("_k", F.concat_ws(":", "_f", "_q"))
    d = long.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_val"))).alias("_m"))
    label = {f"{n}:{i}": f"{n}_{names[i]}" if n else names[i] for n in cols for i in range(len(qs))}
    return d.select(*keys, *[F.col("_m")[k].alias(a) for k, a in label.items()])
