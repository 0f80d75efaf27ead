"""Detector backtesting as table jobs: trials are rows, draws come from whole-number hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorgate.functions.exprs import as_col, mix, safe_div
from sensorgate.operators import normalize
from sensorgate.operators.ordered import row_index


def index_pool(df: DataFrame, order, cols) -> DataFrame:
    """Clean rows numbered 0..n-1 along ``order``; no task ever orders the whole pool."""
    d = row_index(df, [], order, "pool_idx")
    return d.select("pool_idx", *cols)


def pool_size(pool: DataFrame) -> Column:
    return pool.agg(F.count("*")).scalar()


SMALL_POOL = 1_000_000  # rows of a pool that every task may hold
ROWS_PER_TASK = 2_000_000  # hours of timelines


def parts_for(trials: DataFrame, length: int) -> int:
    """Partitions for timelines of ``length`` hours: their number grows with the trials, a task's rows do not."""
    return max(int(trials.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-trials.count() * length // ROWS_PER_TASK))


def draw_from(draws: DataFrame, pool: DataFrame, parts: int, idx: str = "pool_idx") -> DataFrame:
    """Join with the drawn pool rows. Draws are many times their trials and planned as if they were as few, so the side
    that every task holds is named here: the pool if it is small, otherwise none, and both are dealt out in ``parts``."""
    if pool.count() <= SMALL_POOL:
        return draws.join(F.broadcast(pool), idx).drop(idx)
    return draws.repartition(parts, idx).join(pool.repartition(parts, idx).hint("merge"), idx).drop(idx)


def resample(trials: DataFrame, pool: DataFrame, trial: str, length: int, salt: int = 0) -> DataFrame:
    """Each trial becomes a timeline of ``length`` hours drawn with replacement from the pool.

    Draws are spread evenly over the pool, so the join key has no hot value.
    """
    n = parts_for(trials, length)
    d = trials.repartition(n, trial).withColumn("_n", pool_size(pool))
    d = d.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    d = d.withColumn("pool_idx", (mix(trial, "t", salt) % F.col("_n")).cast("long"))
    return draw_from(d, pool, n).drop("_n")


def contiguous_slice(trials: DataFrame, pool: DataFrame, trial: str, length: int, salt: int = 0) -> DataFrame:
    """A run of consecutive pool rows from a drawn start; a pool shorter than the run starts again from its first row."""
    n = parts_for(trials, length)
    d = trials.repartition(n, trial).withColumn("_n", pool_size(pool))
    d = d.withColumn("_s", (mix(trial, F.lit(0), salt) % F.greatest(F.col("_n") - length, F.lit(1))).cast("long"))
    d = d.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn("pool_idx", (F.col("_s") + F.col("t")) % F.col("_n"))
    return draw_from(d, pool, n).drop("_n", "_s")


def plan_events(trials: DataFrame, trial: str, length: int = 240, n_spikes: int = 4, salt: int = 100) -> DataFrame:
    """The layout of the timelines. One sustained span [a0, a1) and single-hour spikes per trial."""
    draw = lambda i, n: (mix(trial, F.lit(i), salt) % n).cast("int")
    d = trials.withColumn("a0", 40 + draw(0, length - 80))
    d = d.withColumn("a1", F.col("a0") + 12 + draw(1, 18))
    return d.withColumn("spikes", F.array(*[20 + draw(2 + j, length - 24) for j in range(n_spikes)]))


def plan_slots(trials: DataFrame, trial: str, length: int = 240, n_sustained: int = 3, n_spikes: int = 5, salt: int = 200):
    """Several events per trial in different slots of a lattice: long rows (kind, t0, t1, sign).

    Slots are ordered by a hash per trial; the first ones take sustained events of 12..29 hours, the next ones spikes.
    """
    slots = F.explode(F.sequence(F.lit(20), F.lit(length - 41), F.lit(8)))
    d = trials.withColumn("t0", slots).withColumn("_o", mix(trial, "t0", salt))
    d = d.withColumn("_k", F.row_number().over(W.partitionBy(trial).orderBy("_o", "t0"))).filter(F.col("_k") <= n_sustained + n_spikes)
    sustained = F.col("_k") <= n_sustained
    d = d.withColumn("kind", F.when(sustained, F.lit("sustained")).otherwise(F.lit("spike")))
    size = F.when(sustained, 12 + mix(trial, "_k", salt + 1) % 18).otherwise(F.lit(1))
    d = d.withColumn("t1", (F.col("t0") + size).cast("int"))
    sign = F.when(mix(trial, "_k", salt + 2) % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    return d.withColumn("sign", sign).withColumn("event", F.col("_k")).drop("_o", "_k")


def spike_count(t: str, spikes: str) -> Column:
    return F.size(F.filter(F.col(spikes), lambda s: s == F.col(t)))


def add_events(df: DataFrame, score: str, magnitude, spike_magnitude) -> DataFrame:
    """Raise the score inside the span and at each spike (a spike drawn twice counts twice)."""
    inside = (F.col("t") >= F.col("a0")) & (F.col("t") < F.col("a1"))
    up = F.when(inside, as_col(magnitude)).otherwise(F.lit(0.0))
    return df.withColumn(score, F.col(score) + up + spike_count("t", "spikes") * as_col(spike_magnitude))


def add_slot_events(df: DataFrame, events: DataFrame, trial, score: str, amount: Column) -> DataFrame:
    """Add the total of ``amount`` of the events that cover a row (a trial has a handful of events).

    Neither side is held whole by a task or the driver: covered hours are many times the events they are planned as.
    """
    trial = [trial] if isinstance(trial, str) else list(trial)
    hours = events.select(*trial, F.explode(F.sequence("t0", F.col("t1") - 1)).alias("t"), amount.alias("_a"))
    hours = hours.groupBy(*trial, "t").agg(F.sum("_a").alias("_a"))
    d = df.join(hours.hint("merge"), [*trial, "t"], "left")
    return d.withColumn(score, F.col(score) + F.coalesce("_a", F.lit(0.0))).drop("_a")


def event_outcomes(alarms: DataFrame, keys, alarm: str = "onset") -> DataFrame:
    """Per timeline: event detected, delay, spikes that set off an alarm within two hours, alarms elsewhere.

    Needs columns t, a0, a1 and spikes; a timeline's alarm hours are gathered in one short array.
    """
    d = alarms.groupBy(*keys).agg(
        F.first("a0").alias("a0"),
        F.first("a1").alias("a1"),
        F.first("spikes").alias("spikes"),
        F.array_sort(F.collect_list(F.when(F.col(alarm), F.col("t")))).alias("_at"),
    )
    return hours_outcomes(d, keys, "_at")


def hours_outcomes(df: DataFrame, keys, hours: str) -> DataFrame:
    """The same from one row per timeline with its sorted alarm hours."""
    at = F.col(hours)
    inside = F.filter(at, lambda t: (t >= F.col("a0")) & (t < F.col("a1")))
    by_spike = lambda t: F.exists(F.col("spikes"), lambda s: (t >= s) & (t < s + 2))
    outside = F.filter(at, lambda t: ((t < F.col("a0")) | (t >= F.col("a1"))) & ~by_spike(t))
    hit_spikes = F.filter("spikes", lambda s: F.exists(at, lambda t: (t >= s) & (t < s + 2)))
    return df.select(
        *keys,
        (F.size(inside) > 0).alias("detected"),
        (F.try_element_at(inside, F.lit(1)) - F.col("a0")).alias("delay"),
        F.size(hit_spikes).alias("spike_fp"),
        F.size(outside).alias("clean_fa"),
    )


def slot_outcomes(alarms: DataFrame, events: DataFrame, keys, alarm: str) -> DataFrame:
    """Per event: any alarm in the span (two hours for a spike) and the delay of the first."""
    keys = list(keys)
    hours = alarms.filter(F.col(alarm)).groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("_at"))
    return slot_hits(events.join(hours, keys, "left"))


def slot_hits(d: DataFrame) -> DataFrame:
    """The same from events with the sorted alarm hours ``_at`` of their timeline."""
    end = F.when(F.col("kind") == "spike", F.col("t0") + 2).otherwise(F.col("t1"))
    d = d.withColumn("_in", F.filter("_at", lambda t: (t >= F.col("t0")) & (t < end)))
    hit = F.coalesce(F.size("_in") > 0, F.lit(False))
    return d.withColumn("hit", hit).withColumn("delay", F.try_element_at("_in", F.lit(1)) - F.col("t0")).drop("_at", "_in")


def first_hit(alarms: DataFrame, keys, alarm: str, t: str = "t") -> DataFrame:
    """First alarm inside the span and its delay from the span start."""
    inside = F.col(alarm) & (F.col(t) >= F.col("a0")) & (F.col(t) < F.col("a1"))
    d = alarms.groupBy(*keys).agg(F.min(F.when(inside, F.col(t))).alias("first_hit"), F.first("a0").alias("a0"))
    return d.withColumn("delay", F.col("first_hit") - F.col("a0")).drop("a0")


def prf(df: DataFrame, tp, fp, fn, undefined=0.0) -> DataFrame:
    """Precision, recall and F1; ``undefined`` (0 or NULL) where a denominator is 0."""
    tp, fp, fn, u = as_col(tp), as_col(fp), as_col(fn), F.lit(undefined).cast("double")
    d = df.withColumn("precision", F.coalesce(safe_div(tp, tp + fp), u)).withColumn("recall", F.coalesce(safe_div(tp, tp + fn), u))
    p, r = F.col("precision"), F.col("recall")
    return d.withColumn("f1", F.coalesce(F.when(p + r > 0, p * r * 2 / (p + r)), u))


def point_scores(df: DataFrame, keys, flag: str, truth: str, time: str) -> DataFrame:
    """Point-level counts, precision, recall, F1 (NULL when undefined) and delay of the first correct flag."""
    f, y = F.coalesce(F.col(flag), F.lit(False)), F.col(truth)
    d = df.groupBy(*keys).agg(
        F.count_if(f & y).alias("tp"),
        F.count_if(f & ~y).alias("fp"),
        F.count_if(~f & y).alias("fn"),
        (F.min(F.when(f & y, F.col(time))) - F.min(F.when(y, F.col(time)))).alias("delay"),
    )
    return prf(d, "tp", "fp", "fn", None)


def inject_series(df: DataFrame, keys, time: str, value: str, sigmas: float = 3.0, onset: int = 24) -> DataFrame:
    """Spike at 75 %, level shift from 65 %, ramp from 55 % of each series and all three together; sizes in its sigma.

    Adds a row per ``kind`` with the changed value and the truth flag (24 hours from each start).
    """
    w = W.partitionBy(*keys)
    d = df.withColumns(
        {
            "_i": F.row_number().over(w.orderBy(time)) - 1,
            "_n": F.count("*").over(w),
            "_a": F.stddev_samp(value).over(w) * sigmas,
        }
    )
    n, third, i = F.col("_n"), F.floor(F.col("_n") / 3), F.col("_i")

    def spike(at):
        return F.when(i == at, F.col("_a")).otherwise(0.0), i == at

    def shift(at):
        return F.when(i >= at, F.col("_a")).otherwise(0.0), (i >= at) & (i < at + onset)

    def ramp(at):
        steps = F.greatest(n - at - 1, F.lit(1))
        return F.when(i >= at, F.col("_a") * (i - at) / steps).otherwise(0.0), (i >= at) & (i < at + onset)

    cut = lambda x: F.floor(x).cast("long")
    parts = {
        "spike": spike(cut(n * 0.75)),
        "level_shift": shift(cut(n * 0.65)),
        "trend_drift": ramp(cut(n * 0.55)),
    }
    three = [spike(cut(third * 0.5)), shift(third + cut(third * 0.3)), ramp(third * 2 + cut(third * 0.2))]
    parts["combined"] = (three[0][0] + three[1][0] + three[2][0], three[0][1] | three[1][1] | three[2][1])
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), a.alias("add"), y.alias("truth")) for k, (a, y) in parts.items()])
    d = d.withColumn("_k", F.explode(kinds))
    return d.select(*keys, time, F.col("_k.kind").alias("kind"), (F.col(value) + F.col("_k.add")).alias(value), F.col("_k.truth").alias("truth"))


def bootstrap_draws(trials: DataFrame, idx: str, replicates: int, salt: int = 300) -> DataFrame:
    """Rows (b, idx): each replicate draws as many trials as there are, with replacement.

    Every trial row makes its own draw per replicate, so this is an explode and an equi-join on the drawn number.
    """
    d = trials.select(F.col(idx).alias("_i")).repartition(parts_for(trials, replicates))
    d = d.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_n", pool_size(trials))
    return d.select("b", (mix("b", "_i", salt) % F.col("_n")).cast("long").alias(idx))


def bootstrap(trials: DataFrame, idx: str, sums, statistic, replicates: int, salt: int = 300) -> DataFrame:
    """Replicate table: summed columns and the statistic computed from the sums. ``idx`` numbers the trials from 0."""
    d = draw_from(bootstrap_draws(trials, idx, replicates, salt), trials.select(idx, *sums), parts_for(trials, replicates), idx)
    return statistic(d.groupBy("b").agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias("n")))


def interval(df: DataFrame, col: str, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Percentile interval over replicates (their number is fixed)."""
    return df.agg(F.percentile(col, F.lit(lo)).alias("ci_lo"), F.percentile(col, F.lit(hi)).alias("ci_hi"))


def _score_counts(df: DataFrame, keys, score: str, label: str) -> DataFrame:
    y = F.col(label).cast("int")
    return df.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum(y).alias("_p"), F.sum(1 - y).alias("_q"))


def roc_auc(df: DataFrame, keys, score: str, label: str) -> DataFrame:
    """Area under the ROC curve, ties at average rank.

    Scores are first counted by value; the running count of negatives is a blocked scan over value ranges.
    """
    from sensorgate.operators.quantiles import value_ranges
    from sensorgate.operators.scan import running_sum

    keys = list(keys)
    c = _score_counts(df, keys, score, label).withColumn(score, F.col(score).cast("double"))
    c = running_sum(value_ranges(c, keys, score, "_r"), keys, [score], "_q", "_below", F.col("_r"))
    wins = F.sum(F.col("_p") * (F.col("_below") - F.col("_q") * 0.5))
    d = c.groupBy(*keys).agg(wins.alias("_u"), F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg"))
    return d.select(*keys, safe_div(F.col("_u"), F.col("n_pos") * F.col("n_neg")).alias("auc"), "n_pos", "n_neg")


def roc_auc_ordered(df: DataFrame, keys, score: str, label: str, tie: str) -> DataFrame:
    """Trapezoid area with ties broken by ``tie`` order: each positive counts the negatives that come after it."""
    from sensorgate.operators.quantiles import value_ranges
    from sensorgate.operators.scan import running_sum

    keys = list(keys)
    y = F.col(label).cast("int")
    d = df.filter(F.col(score).isNotNull()).withColumns({"_p": y, "_q": 1 - y, "_ns": -F.col(score).cast("double")})
    # Rows of one score share a range, so ranges are cut by score first and a score's rows by their tie order.
    d = value_ranges(d, keys, "_ns", "_r")
    d = value_ranges(d, [*keys, "_r"], tie, "_t")
    single = d.groupBy(*keys, "_r").agg((F.min("_ns") == F.max("_ns")).alias("_single"))
    block = F.struct("_r", F.when(F.col("_single"), F.col("_t")).otherwise(0).alias("_t"))
    d = running_sum(d.join(single, [*keys, "_r"]), keys, ["_ns", tie], "_q", "_above", block)
    g = d.groupBy(*keys).agg(
        F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg"), F.sum(F.col("_p") * F.col("_above")).alias("_lost")
    )
    both = F.col("n_pos") * F.col("n_neg")
    return g.select(*keys, safe_div(both - F.col("_lost"), both).alias("auc"), "n_pos", "n_neg")


def shuffled_pairs(df: DataFrame, idx: str, u: str, v: str, replicates: int, salt: int = 400) -> DataFrame:
    """Rows ``rep, u, v``: u with a shuffled v per replicate; ``idx`` numbers the rows from 0.

    A shuffle is the order of a hash; all replicates are ranked in one ordered scan, so none has to fit one task. Pairing is an equi-join on the rank.
    """
    reps = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")
    d = df.select(F.col(idx).alias("_i"), v, reps).withColumn("_h", mix("_i", "rep", salt))
    d = row_index(d, ["rep"], ["_h", "_i"], idx)
    return d.select("rep", idx, v).join(df.select(idx, u), idx).select("rep", u, v)


def drawn_pairs(df: DataFrame, idx: str, u: str, v: str, replicates: int, salt: int) -> DataFrame:
    """Rows ``rep, u, v``: as many rows as there are, drawn with replacement per replicate."""
    n = df.agg(F.count("*")).scalar()
    reps = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")
    draws = df.select(F.col(idx).alias("_i"), reps).select("rep", (mix("rep", "_i", salt) % n).alias(idx))
    return draws.join(df.select(idx, u, v), idx).select("rep", u, v)


def permutation_null(df: DataFrame, idx: str, u: str, v: str, replicates: int, salt: int = 400) -> DataFrame:
    """Correlation of u with a shuffled v per replicate."""
    return shuffled_pairs(df, idx, u, v, replicates, salt).groupBy("rep").agg(F.corr(u, v).alias("r"))


def permutation_test(null: DataFrame, observed: DataFrame, r: str) -> DataFrame:
    """p = (1 + replicates at or above the observed value) / (replicates + 1), null median and 95th percentile."""
    d = null.withColumn("_obs", observed.select(r).scalar())
    return d.agg(
        ((F.count_if(F.col("r") >= F.col("_obs")) + 1) / (F.count("*") + 1)).alias("p_value"),
        F.percentile("r", F.lit(0.5)).alias("null_median"),
        F.percentile("r", F.lit(0.95)).alias("null_p95"),
    )


def canonical_test(df: DataFrame, order, vector: str, split: int, k: int, replicates: int, salt: int) -> DataFrame:
    """Canonical correlation of two blocks of a vector with its permutation p-value and bootstrap interval: one row.

    The blocks become k unit-variance principal components each. A shuffle of rows leaves the components of a block as
    they are, so every replicate is fitted anew from sums of products of these few numbers; bootstrap samples are fitted
    within the same components. Rows without a vector are left out.
    """
    d = df.where(F.col(vector).isNotNull()).select(*order, vector)
    m = normalize.moments(d, [vector])
    sizes = (min(k, split), min(k, len(m.mean) - split))
    d = row_index(normalize.block_scores(d, vector, m, split, k).drop(vector), [], list(order), "idx").select("idx", "u", "w")
    observed = normalize.canonical_r(d, [], "u", "w", sizes)
    null = normalize.canonical_r(shuffled_pairs(d, "idx", "u", "w", replicates, salt), ["rep"], "u", "w", sizes)
    drawn = normalize.canonical_r(drawn_pairs(d, "idx", "u", "w", replicates, salt + 1), ["rep"], "u", "w", sizes)
    interval = drawn.agg(*[F.percentile("r", F.lit(q)).alias(n) for n, q in (("lo", 0.025), ("hi", 0.975))])
    out = permutation_test(null, observed, "r").withColumn("r", observed.scalar())
    return normalize.attach(out, interval, []).select("r", "p_value", "null_median", "null_p95", "lo", "hi")
