"""Small column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


def as_col(c) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(c)


def rnd(c, digits: int = 6) -> Column:
    """Rounded for output; adding 0.0 turns -0.0 into 0.0."""
    return F.round(as_col(c), digits) + F.lit(0.0)


def micros(ts) -> Column:
    return F.unix_micros(as_col(ts).cast("timestamp"))


def int_div(a, b: int) -> Column:
    """Floor division on whole numbers, also below zero (clocks before 1970)."""
    a, b = as_col(a), F.lit(b).cast("long")
    return F.call_function("div", a - F.pmod(a, b), b)


def hour_index(ts) -> Column:
    return int_div(micros(ts), MICROS_PER_HOUR)


def day_index(ts) -> Column:
    return int_div(micros(ts), MICROS_PER_DAY)


def nan_to_null(c) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def clean_nan(df: DataFrame) -> DataFrame:
    """Missing readings arrive as NaN from float files; the operators treat missing as NULL."""
    floats = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: nan_to_null(n) for n in floats})


def safe_div(a, b) -> Column:
    b = as_col(b)
    return F.when(b != 0, as_col(a) / b)


def clip(c, lo, hi) -> Column:
    return F.least(F.greatest(as_col(c), F.lit(lo)), F.lit(hi))


def decibel_amplitude(c) -> Column:
    return F.log10(as_col(c) + F.lit(1e-10)) * 20.0


def decibel_power(c) -> Column:
    return F.log10(as_col(c) + F.lit(1e-10)) * 10.0


def row_mean(cols) -> Column:
    """Mean over columns of one row, ignoring NULL; NULL when all are NULL."""
    cols = [as_col(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.when(n > 0, total / n)


def any_present(cols) -> Column:
    return reduce(lambda a, b: a | b, [as_col(c).isNotNull() for c in cols])


def is_true(c) -> Column:
    return F.coalesce(as_col(c), F.lit(False))


def coverage_state(has_audio, has_video_lit) -> Column:
    a, v = as_col(has_audio), as_col(has_video_lit)
    return (
        F.when(a & v, F.lit("both_lit")).when(a, F.lit("audio_only")).when(v, F.lit("video_only")).otherwise(F.lit("gap"))
    )


def prefix_columns(df: DataFrame, prefix: str, keys) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keys})


def mix(a, b, salt: int = 0) -> Column:
    """Whole-number hash below 2^31 - 1, so that any engine can rebuild the same draws."""
    m = 2147483647
    x = (as_col(a) * F.lit(7919).cast("long") + as_col(b) * F.lit(104729).cast("long") + F.lit(salt * 611953 + 13)) % m
    return (x * x + x * F.lit(31)) % m


def mix_sql(a: str, b: str, salt: int = 0) -> str:
    """The same draw as SQL text."""
    m = 2147483647
    x = f"((CAST({a} AS BIGINT)*7919 + CAST({b} AS BIGINT)*104729 + {salt * 611953 + 13}) % {m})"
    return f"(({x}*{x} + {x}*31) % {m})"
