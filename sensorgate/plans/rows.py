"""Projections, filters, joins, alignment, deduplication, set operators, sort and top-k."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorgate.functions import exprs as ex
from sensorgate.functions.exprs import rnd
from sensorgate.operators import align
from sensorgate.operators import normalize as nz
from sensorgate.operators.quantiles import exact_quantiles
from sensorgate.plans.common import EV, FLOW, GRID, MERGED, MODAL, R, query
from sensorgate.sources import readers as io

KEEP = ["l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"]


@query("f01_fixed_projection", "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem")
def projection(t):
    return t.lineitem.select(*KEEP)


@query(
    "f02_inclusive_time_window",
    """SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 23:00:00'""",
)
def time_window(t):
    lo, hi = (F.lit(s).cast("timestamp_ntz") for s in ("2024-01-05 00:00:00", "2024-01-20 23:00:00"))
    return t.events.select("event_id", "ts").filter(F.col("ts").between(lo, hi))


@query("f03_daytime_filter", "SELECT event_id, ts, value FROM events WHERE hour(ts) >= 6 AND hour(ts) < 18")
def daytime(t):
    return t.events.filter((F.hour("ts") >= 6) & (F.hour("ts") < 18)).select("event_id", "ts", "value")


@query(
    "f04_dropna_any_all",
    f"""WITH {MERGED} SELECT 'any' AS mode, count(*) AS n FROM merged WHERE aud_level IS NOT NULL AND vid_flow IS NOT NULL
    UNION ALL SELECT 'all', count(*) FROM merged WHERE aud_level IS NOT NULL OR vid_flow IS NOT NULL""",
)
def dropna(t):
    pair = ["aud_level", "vid_flow"]
    modes = [t.merged.dropna(how=m, subset=pair).agg(F.lit(m).alias("mode"), F.count("*").alias("n")) for m in ("any", "all")]
    return align.stack(modes)


@query(
    "f05_coverage_filter",
    f"WITH {MERGED} SELECT entity, hr, {R('aud_level')} AS aud_level, {R('vid_flow')} AS vid_flow FROM merged WHERE aud_level IS NOT NULL AND vid_flow IS NOT NULL",
)
def coverage_filter(t):
    state = ex.coverage_state(F.col("aud_level").isNotNull(), F.col("vid_flow").isNotNull())
    d = t.merged.filter(state == "both_lit")
    return d.select("entity", "hr", rnd("aud_level").alias("aud_level"), rnd("vid_flow").alias("vid_flow"))


@query(
    "f06_prefix_feature_selection",
    f"WITH {MERGED} SELECT {R('aud_level')} AS aud_level, aud_n, {R('vid_flow')} AS vid_flow, vid_n, {R('env_temp', 8)} AS env_temp FROM merged",
)
def feature_selection(t):
    cols = io.by_modality(io.numeric_columns(t.merged, ("env_", "vid_", "aud_")))
    return t.merged.select(*[rnd(c, 8 if c == "env_temp" else 6).alias(c) if k == "double" else F.col(c) for c, k in t.merged.select(*cols).dtypes])


@query(
    "f07_quiet_pool",
    f"""WITH {EV}, m AS (SELECT median(value) AS med FROM ev), s AS (SELECT greatest(1.4826 * median(abs(value - med)), 1e-6) AS sc FROM ev, m)
    SELECT event_id, value FROM ev, m, s WHERE abs(value - med) < 3 * sc""",
)
def quiet_pool(t):
    st = nz.robust_stats(t.events, [], ["value"], bounded=False)
    d = nz.attach(t.events.select("event_id", "value"), st, [])
    return d.filter(F.abs(F.col("value") - F.col("med_value")) < nz.robust_scale("mad_value") * 3).select("event_id", "value")


@query(
    "f08_quiet_core",
    f"""WITH {EV}, r AS (SELECT event_id, sqrt(value * value + user_id * user_id) AS rad FROM ev)
    SELECT event_id, {R('rad')} AS rad FROM r WHERE rad < (SELECT quantile_cont(rad, 0.9) FROM r)""",
)
def quiet_core(t):
    d = t.events.select("event_id", F.sqrt(F.col("value") * F.col("value") + F.col("user_id") * F.col("user_id")).alias("rad"))
    cut = exact_quantiles(d, [], {"rad": F.col("rad")}, [0.9])
    return d.filter(F.col("rad") < cut.select("rad_p90").scalar()).select("event_id", rnd("rad").alias("rad"))


@query(
    "f09_temporal_split",
    f"""WITH {FLOW}, x AS (SELECT entity, hr, row_number() OVER (PARTITION BY entity ORDER BY hr) - 1 AS rn, count(*) OVER (PARTITION BY entity) AS c FROM flow)
    SELECT entity, hr, CAST(rn >= floor(c * 0.7::DOUBLE) AS INTEGER) + CAST(rn >= floor(c * 0.85::DOUBLE) AS INTEGER) AS part FROM x""",
)
def temporal_split(t):
    return nz.split_by_time(t.flow, ["entity"], "hr", [0.7, 0.15, 0.15]).select("entity", "hr", "part")


@query(
    "f10_dark_gating",
    f"""WITH {EV} SELECT entity, hr, {R('avg(CASE WHEN value >= 15 THEN value END)')} AS lit_mean, count(CASE WHEN value >= 15 THEN 1 END) AS n_lit,
      {R('avg(CAST(value < 15 AS INTEGER))')} AS dark_fraction FROM ev WHERE event_type = 'purchase' GROUP BY ALL""",
)
def dark_gating(t):
    dark = F.col("value") < 15
    return t.ev.filter(F.col("event_type") == "purchase").groupBy("entity", "hr").agg(
        rnd(F.avg(F.when(~dark, F.col("value")))).alias("lit_mean"), F.count_if(~dark).alias("n_lit"), rnd(F.avg(dark.cast("double"))).alias("dark_fraction")
    )


@query(
    "j01_hourly_spine",
    f"""WITH {EV}, e AS (SELECT entity, min(us) // 3600000000 AS lo, (max(us) + 3599999999) // 3600000000 AS hi FROM ev GROUP BY entity)
    SELECT entity, unnest(generate_series(lo, hi)) AS hr FROM e""",
)
def hourly_spine(t):
    """From the hour of the first reading up to the first full hour at or after the last."""
    d = t.ev.select("entity", "hr").unionByName(t.ev.select("entity", ex.int_div(F.col("us") + 3599999999, ex.MICROS_PER_HOUR).alias("hr")))
    return align.spine([d], ["entity"], "hr")


@query("j02_spine_left_joins", f"WITH {MERGED} SELECT entity, hr, {R('aud_level')} AS aud_level, aud_n, {R('vid_flow')} AS vid_flow, vid_n FROM merged")
def spine_joins(t):
    base = align.spine([t.aud, t.vid], ["entity"], "hr")
    d = align.join_all(base, [t.aud, t.vid], ["entity", "hr"])
    return d.select("entity", "hr", rnd("aud_level").alias("aud_level"), "aud_n", rnd("vid_flow").alias("vid_flow"), "vid_n")


@query(
    "j03_overlap_join",
    f"WITH {MODAL} SELECT count(*) AS n_overlap, count(*) < 100 AS too_sparse FROM aud JOIN vid USING (entity, hr)",
)
def overlap(t):
    return align.overlap(t.aud, t.vid, ["entity", "hr"], 100)


@query(
    "j04_full_outer_join",
    f"WITH {MODAL} SELECT entity, hr, aud_n, vid_n FROM aud FULL JOIN vid USING (entity, hr)",
)
def full_outer(t):
    return t.aud.join(t.vid, ["entity", "hr"], "full").select("entity", "hr", "aud_n", "vid_n")


@query("j05_daily_to_hourly", f"WITH {MERGED} SELECT entity, hr, dy, {R('env_temp', 8)} AS env_temp FROM merged")
def daily_hourly(t):
    return t.merged.select("entity", "hr", "dy", rnd("env_temp", 8).alias("env_temp"))


@query(
    "j06_asof_alignment",
    f"""WITH {EV}, q AS (SELECT user_id, us, value FROM ev WHERE event_type = 'signup'), p AS (SELECT event_id, user_id, us FROM ev WHERE event_type <> 'signup'),
    b AS (SELECT p.event_id, p.user_id, q.value AS v FROM p ASOF LEFT JOIN q ON p.user_id = q.user_id AND p.us >= q.us),
    f AS (SELECT user_id, arg_min(value, us) AS v FROM q GROUP BY user_id)
    SELECT b.event_id, b.user_id, coalesce(b.v, f.v) AS reading FROM b LEFT JOIN f USING (user_id)""",
)
def asof(t):
    signup = F.col("event_type") == "signup"
    rows = t.ev.select("event_id", "user_id", "us", "event_type", "value")
    d = align.asof_within(rows, signup, ["user_id"], "us", "value", "reading", backfill=True)
    return d.select("event_id", "user_id", "reading")


@query("j07_complete_grid", f"WITH {GRID} SELECT entity, hr, {R('v')} AS v, n FROM grid")
def complete(t):
    return t.grid.select("entity", "hr", rnd("v").alias("v"), "n")


@query(
    "j08_count_table_join",
    """WITH c AS (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey, o_totalprice, n_lines FROM orders LEFT JOIN c ON o_orderkey = l_orderkey""",
)
def count_join(t):
    c = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    return t.orders.join(c, "o_orderkey", "left").select("o_orderkey", "o_totalprice", "n_lines")


@query(
    "j09_semi_membership",
    f"WITH {MODAL} SELECT entity, hr, aud_n FROM aud WHERE EXISTS (SELECT 1 FROM vid WHERE vid.entity = aud.entity AND vid.hr = aud.hr)",
)
def semi(t):
    return t.aud.join(t.vid, ["entity", "hr"], "left_semi").select("entity", "hr", "aud_n")


@query(
    "j09_missing_calendar_days",
    """WITH h AS (SELECT DISTINCT o_orderpriority AS p, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'F'),
    e AS (SELECT p, CAST(greatest(date_trunc('month', min(day)), DATE '1995-02-10') AS DATE) AS lo, last_day(max(day)) AS hi FROM h GROUP BY p),
    w AS (SELECT p, CAST(unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM e)
    SELECT p AS o_orderpriority, day FROM w WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.p = w.p AND h.day = w.day)""",
)
def missing_days(t):
    d = t.orders.filter(F.col("o_orderstatus") == "F").select("o_orderpriority", F.col("o_orderdate").cast("date").alias("day"))
    return align.missing_days(d, ["o_orderpriority"], "day", F.lit("1995-02-10").cast("date"))


@query(
    "j10_band_farthest_match",
    f"""WITH x AS (SELECT vec_id, sqrt(list_sum([CAST(embedding[i] AS DOUBLE) * embedding[i] for i in range(33, 65)])) AS nv,
      CAST(embedding[1] AS DOUBLE) AS u, CAST(embedding[33] AS DOUBLE) AS w FROM embeddings),
    z AS (SELECT vec_id, CASE WHEN vec_id = (SELECT arg_max(vec_id, nv) FROM x) THEN nv * 2 ELSE nv END AS nv, w, -u AS expected FROM x),
    pr AS (SELECT a.vec_id, b.vec_id AS pool_id, abs(b.nv - a.nv) AS dn, abs(b.w - a.expected) AS far, abs(b.nv - a.nv) < 0.15 * a.nv + 1e-9 AS inb FROM z a, z b),
    rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dn, pool_id) AS rk, count(*) FILTER (inb) OVER (PARTITION BY vec_id) AS nb FROM pr),
    c AS (SELECT vec_id, pool_id, far, nb < 5 AS widened FROM rk WHERE (nb >= 5 AND inb) OR (nb < 5 AND rk <= 20))
    SELECT vec_id, first(pool_id ORDER BY far DESC, pool_id) AS pool_id, {R('max(far)')} AS far, any_value(widened) AS widened FROM c GROUP BY vec_id""",
)
def band_match(t):
    from sensorgate.functions.arrays import l2_norm

    d = t.embeddings.select(
        "vec_id", l2_norm(F.slice("embedding", 33, 32)).alias("nv"),
        F.get("embedding", F.lit(0)).cast("double").alias("u"), F.get("embedding", F.lit(32)).cast("double").alias("w"),
    )
    top = d.agg(F.max_by("vec_id", "nv").alias("v")).scalar()
    d = d.withColumn("nv", F.when(F.col("vec_id") == top, F.col("nv") * 2).otherwise(F.col("nv")))
    events = d.select("vec_id", F.col("nv").alias("norm"), (-F.col("u")).alias("expected"))
    pool = d.select(F.col("vec_id").alias("pool_id"), F.col("nv").alias("pool_norm"), "w")
    m = align.farthest_in_band(events, pool, "vec_id")
    return m.select("vec_id", "pool_id", rnd("far").alias("far"), "widened")


@query(
    "j11_scalar_broadcast",
    f"""WITH {FLOW}, m AS (SELECT median(v) AS med, quantile_cont(v, 0.95) AS q95 FROM flow)
    SELECT entity, hr, {R('v - med')} AS above_median, v > q95 AS extreme FROM flow, m""",
)
def scalar_broadcast(t):
    q = exact_quantiles(t.flow, [], {"v": F.col("v")}, [0.5, 0.95])
    d = nz.attach(t.flow, q, [])
    return d.select("entity", "hr", rnd(F.col("v") - F.col("v_p50")).alias("above_median"), (F.col("v") > F.col("v_p95")).alias("extreme"))


@query(
    "d01_keep_first_dedup",
    """WITH x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS c FROM orders)
    SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, c AS n_copies FROM x WHERE rn = 1""",
)
def dedup(t):
    return align.keep_first(t.orders, ["o_custkey", "o_orderdate"], ["o_orderkey"], "n_copies")


@query(
    "d02_union_by_name",
    """SELECT event_id, ts, value, NULL::VARCHAR AS event_type FROM events WHERE event_type IN ('view', 'click')
    UNION ALL SELECT event_id, ts, NULL::DOUBLE, event_type FROM events WHERE event_type NOT IN ('view', 'click')""",
)
def union(t):
    audio = F.col("event_type").isin("view", "click")
    a = t.events.filter(audio).select("event_id", "ts", "value")
    b = t.events.filter(~audio).select("event_type", "ts", "event_id")
    return align.stack([a, b])


@query(
    "d03_set_difference",
    """SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem EXCEPT SELECT CAST(o_orderdate AS DATE) FROM orders""",
)
def set_difference(t):
    days = t.lineitem.select(F.col("l_shipdate").cast("date").alias("day"))
    return days.subtract(t.orders.select(F.col("o_orderdate").cast("date").alias("day")))


@query(
    "d04_mixed_sort",
    """SELECT n_nationkey, c_custkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY n_nationkey, c_acctbal DESC, c_custkey""",
)
def mixed_sort(t):
    d = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return d.select("n_nationkey", "c_custkey", "c_acctbal").orderBy(F.asc("n_nationkey"), F.desc("c_acctbal"), "c_custkey")


@query(
    "d05_top_k_per_group",
    """SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority
    ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 10""",
)
def top_k(t):
    d = align.top_k(t.orders, ["o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"], 10)
    return d.select("o_orderpriority", "o_orderkey", "o_totalprice", "rank")


@query("d06_top_k_overall", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 10")
def top_overall(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return d.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(10)


@query(
    "d06_longest_segments",
    f"""WITH {MODAL}, g AS (SELECT entity, hr, hr - lag(hr) OVER w AS gap FROM vid WINDOW w AS (PARTITION BY entity ORDER BY hr)),
    s AS (SELECT entity, hr, sum(CASE WHEN gap > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY hr) AS sid FROM g),
    l AS (SELECT entity, CAST(sid AS BIGINT) AS segment_id, max(hr) - min(hr) + 1 AS span FROM s GROUP BY ALL)
    SELECT entity, segment_id, span, row_number() OVER (PARTITION BY entity ORDER BY span DESC, segment_id) <= 2 AS is_main FROM l""",
)
def longest_segments(t):
    from sensorgate.operators.timeseries import segments

    d = segments(t.vid, ["entity"], "hr", 6)
    d = d.groupBy("entity", "segment_id").agg((F.max("hr") - F.min("hr") + 1).alias("span"))
    w = W.partitionBy("entity").orderBy(F.desc("span"), "segment_id")
    return d.withColumn("is_main", F.row_number().over(w) <= 2)
