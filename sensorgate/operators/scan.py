"""Ordered scans that stay parallel when one key holds a large share of the rows.

A plain window over ``partitionBy(key)`` sends a whole key to one task. Here the key is cut in blocks along its
order column: rows are scanned inside their block, one summary row per block is scanned along the key, and the
summary is joined back. The block column must be a non-decreasing function of the order column, and blocks should
be narrow enough for one task; the summary table holds one row per key and block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorgate.functions.exprs import as_col

_UP, _DOWN = W.unboundedPreceding, W.unboundedFollowing


def _join_blocks(df: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(summary, [*keys, "_blk"], "left")


def running_sum(df: DataFrame, keys, order, value, out: str, block: Column) -> DataFrame:
    """Inclusive running sum of ``value`` along ``order`` within ``keys``; NULL counts as nothing."""
    keys, order = list(keys), list(order)
    d = df.withColumns({"_blk": block, "_v": as_col(value)})
    totals = d.groupBy(*keys, "_blk").agg(F.sum("_v").alias("_tot"))
    before = W.partitionBy(*keys).orderBy("_blk").rowsBetween(_UP, -1)
    offsets = totals.select(*keys, "_blk", F.sum("_tot").over(before).alias("_off"))
    inside = W.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(_UP, 0)
    d = d.withColumn("_loc", F.sum("_v").over(inside))
    zero = F.lit(0)
    return (
        _join_blocks(d, offsets, keys)
        .withColumn(out, F.coalesce("_loc", zero) + F.coalesce("_off", zero))
        .drop("_blk", "_v", "_loc", "_off")
    )


def carry(
    df: DataFrame, keys, order, value, out: str, block: Column, inclusive: bool = True, forward: bool = True
) -> DataFrame:
    """Nearest non-NULL ``value`` at or before the row (``forward``) or at or after it; may be a struct."""
    keys, order = list(keys), list(order)
    d = df.withColumns({"_blk": block, "_v": as_col(value)})
    inside = W.partitionBy(*keys, "_blk").orderBy(*order)
    along = W.partitionBy(*keys).orderBy("_blk")
    rank = F.when(F.col("_v").isNotNull(), F.struct(*order))
    if forward:
        edge = F.max_by("_v", rank)
        local = F.last("_v", ignorenulls=True).over(inside.rowsBetween(_UP, 0 if inclusive else -1))
        other = F.last("_edge", ignorenulls=True).over(along.rowsBetween(_UP, -1))
    else:
        edge = F.min_by("_v", rank)
        local = F.first("_v", ignorenulls=True).over(inside.rowsBetween(0 if inclusive else 1, _DOWN))
        other = F.first("_edge", ignorenulls=True).over(along.rowsBetween(1, _DOWN))
    summary = d.groupBy(*keys, "_blk").agg(edge.alias("_edge")).select(*keys, "_blk", other.alias("_car"))
    d = d.withColumn("_loc", local)
    return (
        _join_blocks(d, summary, keys).withColumn(out, F.coalesce("_loc", "_car")).drop("_blk", "_v", "_loc", "_car")
    )


def previous_row(df: DataFrame, keys, order, cols, out: str, block: Column) -> DataFrame:
    """``cols`` of the row just before, as a struct (NULL on the first row): ``lag`` for keys of any size."""
    return carry(df, keys, order, F.struct(*cols), out, block, inclusive=False)


def with_halo(df: DataFrame, position: str, width: int, before: int, after: int) -> DataFrame:
    """Copy rows to every block of ``width`` positions whose framed windows can see them.

    Adds ``_blk`` and ``_core``; window over ``(keys, _blk)`` with a frame inside ``[-before, after]``, then keep
    ``_core``. Both sides of the frame must be shorter than ``width`` for the copies to stay below three.
    """
    p = F.col(position)
    lo = F.floor((p - after) / width).cast("long")
    hi = F.floor((p + before) / width).cast("long")
    return df.withColumn("_blk", F.explode(F.sequence(lo, hi))).withColumn(
        "_core", F.col("_blk") == F.floor(p / width).cast("long")
    )


def decayed_sum(df: DataFrame, keys, position: str, value, decay: float, out: str, bounded: bool = False) -> DataFrame:
    """``S_t = decay^(t - s) S_s + value_t`` for the previous row s; positions without a row only decay.

    A linear recurrence, so no state loop is needed: inside a block it is a prefix sum of ``value * decay^-i``
    scaled back by ``decay^i``; earlier blocks enter through their last few totals, beyond which the weight is
    below the precision of a double. ``bounded`` keys (hours of one record) do without the summary join.
    """
    keys = list(keys)
    length = max(1, int(math.log(1e5) / -math.log(decay)))
    depth = max(1, math.ceil(math.log(1e-18) / (length * math.log(decay))))
    p = F.col(position).cast("long")
    d = df.withColumn("_blk", F.floor(p / length).cast("long"))
    d = d.withColumn("_i", (p - F.col("_blk") * length).cast("double"))
    d = d.withColumn("_v", F.coalesce(as_col(value), F.lit(0.0)) * F.pow(F.lit(decay), -F.col("_i")))
    inside = W.partitionBy(*keys, "_blk").orderBy(position).rowsBetween(_UP, 0)
    if bounded:
        along = W.partitionBy(*keys).orderBy("_blk")
        parts = [
            F.coalesce(F.sum("_v").over(along.rangeBetween(-k, -k)), F.lit(0.0)) * (decay ** (length * k - 1))
            for k in range(1, depth + 1)
        ]
        carry_in = sum(parts[1:], parts[0])
        d = d.withColumns({"_loc": F.sum("_v").over(inside), "_car": carry_in})
        return d.withColumn(out, (F.col("_loc") + F.col("_car") * decay) * F.pow(F.lit(decay), F.col("_i"))).drop(
            "_blk", "_i", "_v", "_loc", "_car"
        )
    totals = d.groupBy(*keys, "_blk").agg((F.sum("_v") * decay ** (length - 1)).alias("_tot"))
    recent = W.partitionBy(*keys).orderBy("_blk").rangeBetween(-depth, -1)
    totals = totals.withColumn("_prev", F.collect_list(F.struct("_blk", "_tot")).over(recent))
    carried = F.aggregate(
        "_prev",
        F.lit(0.0),
        lambda acc, x: acc
        + x["_tot"] * F.pow(F.lit(decay), ((F.col("_blk") - 1 - x["_blk"]) * length).cast("double")),
    )
    totals = totals.select(*keys, "_blk", carried.alias("_car"))
    d = d.withColumn("_loc", F.sum("_v").over(inside) * F.pow(F.lit(decay), F.col("_i")))
    return (
        _join_blocks(d, totals, keys)
        .withColumn(out, F.col("_loc") + F.coalesce("_car", F.lit(0.0)) * F.pow(F.lit(decay), F.col("_i") + 1.0))
        .drop("_blk", "_i", "_v", "_loc", "_car")
    )
