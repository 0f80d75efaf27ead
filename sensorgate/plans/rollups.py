"""Aggregations of frames to minutes, hours and days, vector statistics, coverage and audits."""

from pyspark.sql import functions as F

from sensorgate.functions.exprs import rnd
from sensorgate.operators import aggregate as ag
from sensorgate.operators import normalize as nz
from sensorgate.operators.quantiles import exact_quantiles
from sensorgate.plans.common import EV, FLOW, MERGED, MODAL, R, Tables, query


def rounded(df, digits: int = 6):
    return df.withColumns({c: rnd(c, digits) for c, k in df.dtypes if k == "double"})


def selected(sql_cols: dict, digits: int = 6) -> str:
    return ", ".join(f"{R(e, digits)} AS {n}" for n, e in sql_cols.items())


LIT = "CASE WHEN value >= 15 THEN value END"
A1 = {
    "flow_mean_avg": f"avg({LIT})", "flow_mean_std": f"stddev_samp({LIT})", "flow_mean_min": f"min({LIT})", "flow_mean_max": f"max({LIT})",
    "flow_var_avg": f"avg(CASE WHEN value >= 15 THEN value * value / 101 END)", "occupancy_avg": "avg(CASE WHEN value >= 15 THEN k / 100 END)",
    "occupancy_std": "stddev_samp(CASE WHEN value >= 15 THEN k / 100 END)", "occupancy_p50": "quantile_cont(CASE WHEN value >= 15 THEN k / 100 END, 0.5)",
    "occupancy_p90": "quantile_cont(CASE WHEN value >= 15 THEN k / 100 END, 0.9)", "dark_fraction": "avg(CAST(value < 15 AS INTEGER))",
}


def video_frames(t: Tables):
    """All events as video frames; the user plays the file."""
    return t.ev.select(
        "entity", "hr", F.col("value").alias("flow_mean"), (F.col("value") * F.col("value") / 101).alias("flow_var"),
        (F.from_json("props", "k int")["k"] / 100).alias("occupancy"), (F.col("value") < 15).alias("is_dark"), F.col("user_id").alias("filepath"),
    )


@query(
    "a01_hourly_video",
    f"""WITH {EV}, f AS (SELECT entity, hr, user_id, value, CAST(CAST(props->>'k' AS INTEGER) AS DOUBLE) AS k FROM ev)
    SELECT entity, hr, {selected(A1)}, nullif(count({LIT}), 0) AS n_frames_lit, count(DISTINCT user_id) AS file_count,
    {', '.join(f'NULL::DOUBLE AS {c}' for c in ag.PLACEHOLDERS)} FROM f GROUP BY ALL""",
)
def hourly_video(t):
    return rounded(ag.hourly_video(video_frames(t), ["entity", "hr"]))


@query(
    "a02_hourly_rich_video",
    f"""WITH {EV}, h AS (SELECT entity, hr, value, greatest(0, least(31, CAST(floor(value / 10) AS INTEGER))) AS bin FROM ev),
    s AS (SELECT entity, hr, count(*) AS n, count(*) FILTER (value >= 15) AS n_pairs FROM ev GROUP BY ALL)
    SELECT s.entity, s.hr, n_pairs, {R('1 - n_pairs / n')} AS dark_fraction,
      {', '.join(f"{R(f'CASE WHEN n_pairs > 0 THEN count(bin) FILTER (value >= 15 AND bin = {i}) / n_pairs END')} AS flowhist{i:02d}" for i in range(32))}
    FROM s JOIN h ON h.entity = s.entity AND h.hr = s.hr GROUP BY s.entity, s.hr, n, n_pairs""",
)
def rich_video(t):
    """Each lit frame carries a one-hot histogram vector; dark frames carry NULL."""
    pos = F.greatest(F.lit(0), F.least(F.lit(31), F.floor(F.col("value") / 10).cast("int")))
    vec = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (i == pos).cast("double"))
    d = t.ev.select("entity", "hr", F.when(F.col("value") >= 15, vec).alias("hist"))
    keys = ["entity", "hr"]
    base = d.groupBy(*keys).agg(F.count("hist").alias("n_pairs"), F.avg(F.col("hist").isNull().cast("double")).alias("dark_fraction"))
    wide = ag.widen(ag.vector_stats(d, keys, "hist"), keys, ["mean"], 32, "flowhist{:02d}")
    d = base.join(wide, keys, "left").withColumnsRenamed({f"flowhist{i:02d}_mean": f"flowhist{i:02d}" for i in range(32)})
    return rounded(d)


def grid_sql(i: int) -> str:
    return f"CASE WHEN value >= 15 THEN value * {i % 4 + 1} / {i // 4 + 1} END"


@query(
    "a02_rich_video_table",
    f"""WITH {EV}, f AS (SELECT entity, hr, value, CAST(CAST(props->>'k' AS INTEGER) AS DOUBLE) AS k, least(31, CAST(floor(value / 10) AS INTEGER)) AS bin FROM ev)
    SELECT entity, hr, count(*) FILTER (value >= 15) AS n_pairs, {R('avg(CAST(value < 15 AS INTEGER))')} AS dark_fraction,
      {R('avg(CASE WHEN value >= 15 THEN value END)')} AS flow_mean_avg, {R('avg(CASE WHEN value >= 15 THEN k / 100 END)')} AS moving_frac_avg,
      {', '.join(f"{R(f'avg(CASE WHEN value >= 15 THEN CAST(bin = {i} AS INTEGER) END)')} AS flowhist{i:02d}" for i in range(32))},
      {', '.join(f"{R(f'avg({grid_sql(i)})')} AS gridmean{i:02d}, {R(f'stddev_pop({grid_sql(i)})')} AS gridstd{i:02d}" for i in range(16))}
    FROM f GROUP BY ALL""",
)
def rich_video_table(t):
    """All hourly columns of rich video: flow, moving share, histogram and the 4 x 4 grid, from the frames in one aggregation."""
    lit_row, value = F.col("value") >= 15, F.col("value")
    k = F.get_json_object("props", "$.k").cast("double")
    bin_ = F.least(F.lit(31), F.floor(value / 10).cast("int"))
    lit = lambda c: F.when(lit_row, c)
    aggs = [F.count_if(lit_row).alias("n_pairs"), F.avg((~lit_row).cast("double")).alias("dark_fraction"), F.avg(lit(value)).alias("flow_mean_avg"), F.avg(lit(k / 100)).alias("moving_frac_avg")]
    aggs += [F.avg(lit((bin_ == i).cast("double"))).alias(f"flowhist{i:02d}") for i in range(32)]
    for i in range(16):
        cell = lit(value * (i % 4 + 1) / (i // 4 + 1))
        aggs += [F.avg(cell).alias(f"gridmean{i:02d}"), F.stddev_pop(cell).alias(f"gridstd{i:02d}")]
    return rounded(t.ev.groupBy("entity", "hr").agg(*aggs))


A3 = {f"{c}_{n}": e.format(c) for c in ("level", "k") for n, e in (("mean", "avg({})"), ("std", "stddev_samp({})"), ("p10", "quantile_cont({}, 0.1)"), ("p90", "quantile_cont({}, 0.9)"))}


@query(
    "a03_audio_bin_stats",
    f"""WITH {EV}, f AS (SELECT entity, hr, value AS level, CAST(CAST(props->>'k' AS INTEGER) AS DOUBLE) AS k FROM ev WHERE event_type IN ('view', 'click'))
    SELECT entity, hr, {selected(A3)}, {R('avg(CAST(k > 50 AS INTEGER))')} AS voc_activity_frac, {R('avg(CAST(level > 100 AS INTEGER))')} AS transient_rate, count(level) AS n_frames
    FROM f GROUP BY ALL""",
)
def audio_stats(t):
    d = t.ev.filter(F.col("event_type").isin("view", "click"))
    d = d.select("entity", "hr", F.col("value").alias("level"), F.from_json("props", "k int")["k"].cast("double").alias("k"))
    d = d.withColumns({"voc_active": F.col("k") > 50, "transient": F.col("level") > 100})
    return rounded(ag.descriptor_stats(d, ["entity", "hr"], ["level", "k"]))


@query(
    "a04_mergeable_vector_stats",
    f"""WITH x AS (SELECT label, CAST(unnest(range(0, 64)) AS INTEGER) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
    SELECT label, dim, {R('avg(x)')} AS mean, {R('stddev_pop(x)')} AS std, count(*) AS n FROM x GROUP BY ALL""",
)
def mergeable(t):
    """States per label and file (vector id modulo three), merged over files."""
    d = t.embeddings.withColumn("file", F.col("vec_id") % 3)
    return rounded(ag.merge_partials(ag.vector_partials(d, ["label", "file"], "embedding"), ["label"]))


A4V = {"price_mean": "avg(l_extendedprice)", "price_std": "stddev_pop(l_extendedprice)", "qty_mean": "avg(l_quantity)"}


@query(
    "a04_partial_final_volume",
    f"""SELECT l_returnflag, l_linestatus, {selected(A4V, 4)}, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def partial_final(t):
    price = F.col("l_extendedprice")
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        rnd(F.avg(price), 4).alias("price_mean"), rnd(F.stddev_pop(price), 4).alias("price_std"),
        rnd(F.avg("l_quantity"), 4).alias("qty_mean"), F.count("*").alias("n"),
    )


def tier_sql(expected: int) -> str:
    return ", ".join(
        f"{R(e)} AS {n}"
        for n, e in {
            "vid_flow_mag_mean": "avg(value)", "vid_flow_mag_std": "stddev_pop(value)", "vid_flow_mag_max": "max(value)",
            "vid_flow_mag_p95": "quantile_cont(value, 0.95)", "vid_flow_mag_p05": "quantile_cont(value, 0.05)",
            "vid_activity_frac": "avg(CAST(value > 2 AS INTEGER))", "vid_coverage": f"least(count(*) / {expected}, 1.0)",
        }.items()
    )


@query(
    "a05_quarter_hour_tier",
    f"WITH {EV} SELECT entity, us // 900000000 AS quarter, {tier_sql(12)}, count(*) AS vid_n_frames FROM ev GROUP BY ALL",
)
def quarter_tier(t):
    d = t.ev.select("entity", F.expr("us div 900000000").alias("quarter"), "value")
    return rounded(ag.motion_tier(d, ["entity", "quarter"], "value", 2.0, 12))


@query(
    "a06_daily_tier_from_raw",
    f"WITH {EV} SELECT entity, dy, {tier_sql(100)}, count(*) AS vid_n_frames, count(DISTINCT us // 900000000) AS vid_n_bins FROM ev GROUP BY ALL",
)
def daily_tier(t):
    d = t.ev.select("entity", "dy", F.expr("us div 900000000").alias("quarter"), "value")
    tier = ag.motion_tier(d, ["entity", "dy"], "value", 2.0, 100)
    bins = d.select("entity", "dy", "quarter").distinct().groupBy("entity", "dy").agg(F.count("*").alias("vid_n_bins"))
    return rounded(tier.join(bins, ["entity", "dy"], "left"))


@query(
    "a07_thermal_daily",
    """SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n_frames, {0}, {1}, {2} AS minus_ambient FROM orders GROUP BY 1""".format(
        R("avg(o_totalprice / 9973)") + " AS warm_mean", R("stddev_samp(o_totalprice / 9973)") + " AS warm_std", R("avg(o_totalprice / 9973) - avg(o_custkey)")
    ),
)
def thermal_daily(t):
    warm = F.col("o_totalprice") / 9973
    return t.orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(
        F.count("*").alias("n_frames"), rnd(F.avg(warm)).alias("warm_mean"), rnd(F.stddev_samp(warm)).alias("warm_std"),
        rnd(F.avg(warm) - F.avg("o_custkey")).alias("minus_ambient"),
    )


@query(
    "a08_daily_embedding",
    f"""WITH x AS (SELECT label, vec_id, CAST(unnest(range(0, 64)) AS INTEGER) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    c AS (SELECT label, count(*) AS n_windows, count(DISTINCT vec_id % 7) AS n_files FROM embeddings GROUP BY label)
    SELECT label, n_windows, n_files, dim, {R('avg(x)')} AS emb_mean, {R('stddev_pop(x)')} AS emb_std FROM x JOIN c USING (label) GROUP BY ALL""",
)
def daily_embedding(t):
    d = t.embeddings
    n = d.groupBy("label").agg(F.count("*").alias("n_windows"), F.count_distinct(F.col("vec_id") % 7).alias("n_files"))
    arrays = ag.ordered_array(ag.vector_stats(d, ["label"], "embedding"), ["label"], ["mean", "std"])
    flat = n.join(arrays, "label").select("label", "n_windows", "n_files", F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "z"))
    return flat.select("label", "n_windows", "n_files", "dim", rnd("z.mean").alias("emb_mean"), rnd("z.std").alias("emb_std"))


@query(
    "a09_minute_coverage",
    f"""WITH {MERGED}, m AS (SELECT entity, hr, us // 60000000 AS mi, count(*) AS n_frames FROM ev GROUP BY ALL), c AS (SELECT entity, hr, count(*) / 60 AS f FROM m WHERE n_frames > 0 GROUP BY ALL)
    SELECT s.entity, s.hr, {R('coalesce(f, 0)')} AS minute_coverage_frac FROM spine s LEFT JOIN c ON c.entity = s.entity AND c.hr = s.hr""",
)
def minute_coverage(t):
    minutes = t.ev.groupBy("entity", "hr", F.expr("us div 60000000").alias("mi")).agg(F.count("*").alias("n_frames"))
    d = ag.minute_coverage(minutes, t.merged.select("entity", "hr"), ["entity"], "hr", "n_frames")
    return d.select("entity", "hr", rnd("minute_coverage_frac").alias("minute_coverage_frac"))


@query(
    "a10_room_modality_coverage",
    """WITH s AS (SELECT o_orderpriority AS room, o_orderstatus AS modality, CASE WHEN o_orderkey % 10 > 0 THEN CAST(o_orderdate AS DATE) END AS d0,
      CASE WHEN o_orderkey % 10 > 0 THEN CAST(o_orderdate AS DATE) + CAST(o_custkey % 4 AS INTEGER) END AS d1, o_custkey AS files, o_totalprice AS size_mb FROM orders),
    d AS (SELECT room, modality, count(DISTINCT x) AS days_covered FROM (SELECT room, modality, unnest(generate_series(d0::TIMESTAMP, d1::TIMESTAMP, INTERVAL 1 DAY)) AS x FROM s WHERE d0 IS NOT NULL) GROUP BY ALL)
    SELECT room, modality, min(d0) AS earliest, max(d1) AS latest, any_value(days_covered) AS days_covered, count(*) AS sessions, CAST(sum(files) AS BIGINT) AS files,
      round(sum(size_mb) / 1024, 2) AS size_gb, count(*) - count(d0) AS undated_sessions FROM s JOIN d USING (room, modality) GROUP BY ALL""",
)
def room_coverage(t):
    dated = F.col("o_orderkey") % 10 > 0
    day = F.col("o_orderdate").cast("date")
    s = t.orders.select(
        F.col("o_orderpriority").alias("room"), F.col("o_orderstatus").alias("modality"), F.when(dated, day).alias("d0"),
        F.when(dated, F.date_add(day, (F.col("o_custkey") % 4).cast("int"))).alias("d1"), F.col("o_custkey").alias("files"), F.col("o_totalprice").alias("size_mb"),
    )
    return ag.day_coverage(s, ["room", "modality"], "d0", "d1", "files", "size_mb")


SPANS = f"""{MERGED}, pl AS (SELECT entity, hr, unnest(list_filter(['video_all', 'video_lit', 'video_dark', 'audio', 'env', 'fused'], lambda x:
    CASE x WHEN 'video_all' THEN vid_n IS NOT NULL WHEN 'video_lit' THEN vid_flow IS NOT NULL WHEN 'video_dark' THEN vid_n IS NOT NULL AND vid_flow IS NULL
      WHEN 'audio' THEN aud_level IS NOT NULL WHEN 'env' THEN env_temp IS NOT NULL ELSE vid_flow IS NOT NULL AND aud_level IS NOT NULL AND env_temp IS NOT NULL END)) AS modality FROM merged)"""


@query(
    "a11_span_statistics",
    f"""WITH {SPANS}, s AS (SELECT entity, modality, min(hr) AS first_hour, max(hr) AS last_hour, count(DISTINCT hr) AS hours_present FROM pl GROUP BY ALL),
    f AS (SELECT entity, hours_present AS nf FROM s WHERE modality = 'fused')
    SELECT s.entity, modality, first_hour, last_hour, hours_present, (last_hour - first_hour) // 24 AS duration_days, last_hour - first_hour + 1 AS hours_expected,
      {R('(1 - hours_present / (last_hour - first_hour + 1)) * 100', 1)} AS missing_pct,
      CASE WHEN modality = 'fused' THEN 100.0::DOUBLE ELSE {R('hours_present / greatest(coalesce(nf, 0), 1) * 100', 1)} END AS share_of_fused_pct
    FROM s LEFT JOIN f ON f.entity = s.entity""",
)
def span_statistics(t):
    lit, audio, env = F.col("vid_flow").isNotNull(), F.col("aud_level").isNotNull(), F.col("env_temp").isNotNull()
    rec = F.col("vid_n").isNotNull()
    flags = {"video_all": rec, "video_lit": lit, "video_dark": rec & ~lit, "audio": audio, "env": env, "fused": lit & audio & env}
    p = ag.presence_long(t.merged, ["entity"], "hr", flags)
    return rounded(ag.span_statistics(p, ["entity"], "hr", "fused"), 1)


@query("a12_value_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def value_counts(t):
    return ag.value_counts(t.documents, ["lang", "source"])


@query(
    "a13_pivot_mean",
    f"""SELECT l_shipdate AS day, {R("avg(l_quantity) FILTER (l_returnflag = 'A')")} AS qty_a, {R("avg(l_quantity) FILTER (l_returnflag = 'N')")} AS qty_n,
      {R("avg(l_quantity) FILTER (l_returnflag = 'R')")} AS qty_r FROM lineitem GROUP BY 1""",
)
def pivot(t):
    d = t.lineitem.groupBy(F.col("l_shipdate").alias("day")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_quantity"))
    return d.select("day", *[rnd(c).alias(f"qty_{c.lower()}") for c in "ANR"])


@query(
    "a13_unpivot",
    f"""WITH {MERGED} SELECT entity, hr, 'aud_level' AS feature, {R('aud_level', 8)} AS value FROM merged UNION ALL
      SELECT entity, hr, 'vid_flow', {R('vid_flow', 8)} FROM merged UNION ALL SELECT entity, hr, 'env_temp', {R('env_temp', 8)} FROM merged""",
)
def unpivot(t):
    d = t.merged.unpivot(["entity", "hr"], ["aud_level", "vid_flow", "env_temp"], "feature", "value")
    return d.withColumn("value", rnd("value", 8))


@query(
    "a15_segment_summary",
    f"""WITH {MODAL}, g AS (SELECT entity, hr, vid_n, hr - lag(hr) OVER (PARTITION BY entity ORDER BY hr) AS gap FROM vid),
    s AS (SELECT entity, hr, vid_n, CAST(sum(CASE WHEN gap > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY hr) AS BIGINT) AS segment_id FROM g),
    l AS (SELECT entity, segment_id, min(hr) AS first_hour, max(hr) AS last_hour, count(*) AS n_hours_observed, avg(vid_n) AS mean_coverage, max(hr) - min(hr) + 1 AS span_hours FROM s GROUP BY ALL)
    SELECT entity, segment_id, first_hour, last_hour, n_hours_observed, {R('mean_coverage')} AS mean_coverage, span_hours, {R('n_hours_observed / span_hours')} AS density,
      span_hours >= 72 AND n_hours_observed / span_hours >= 0.4 AS eligible,
      CASE WHEN span_hours < 72 THEN 'too_short' WHEN n_hours_observed / span_hours < 0.4 THEN 'too_sparse' ELSE 'ok' END AS reason FROM l""",
)
def segment_summary(t):
    from sensorgate.operators.timeseries import segments

    d = segments(t.vid, ["entity"], "hr", 6)
    return rounded(ag.segment_summary(d, ["entity", "segment_id"], "hr", "vid_n", 72, 0.4))


@query(
    "a16_paired_correlation",
    f"WITH {MERGED} SELECT entity, CASE WHEN count(*) >= 3 THEN {R('corr(aud_level, vid_flow)')} END AS r, count(*) AS n FROM merged WHERE aud_level IS NOT NULL AND vid_flow IS NOT NULL GROUP BY entity",
)
def paired_corr(t):
    return rounded(nz.paired_corr(t.merged, ["entity"], "aud_level", "vid_flow"))


LCOLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "a17_correlation_matrix",
    "WITH x AS (SELECT l_quantity AS c0, l_extendedprice AS c1, nullif(l_discount, 0) AS c2, nullif(l_tax, 0) AS c3 FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT {i}::INTEGER AS i, {j}::INTEGER AS j, {R(f'corr(c{i}, c{j})', 5)} AS r, count(*) FILTER (c{i} IS NOT NULL AND c{j} IS NOT NULL) AS n FROM x"
        for i in range(4) for j in range(4)
    ),
)
def corr_matrix(t):
    """Zero discount and tax stand for missing, so pairs have different row counts."""
    d = t.lineitem.select("l_quantity", "l_extendedprice", *[F.when(F.col(c) != 0, F.col(c)).alias(c) for c in LCOLS[2:]])
    return rounded(nz.corr_long(nz.pair_sums(d, LCOLS, shift=[25.0, 50000.0, 0.05, 0.04])), 5)


@query(
    "a18_core_covariance",
    f"""WITH {MERGED}, b AS (SELECT aud_level - 50 AS x, vid_flow - 50 AS y FROM merged WHERE aud_level IS NOT NULL AND vid_flow IS NOT NULL),
    c AS (SELECT x, y FROM b WHERE sqrt(x * x + y * y) < (SELECT quantile_cont(sqrt(x * x + y * y), 0.9) FROM b)),
    v AS (SELECT covar_samp(x, x) AS sxx, covar_samp(x, y) AS sxy, covar_samp(y, y) AS syy FROM c)
    SELECT {R('sxx', 4)} AS sxx, {R('sxy', 4)} AS sxy, {R('syy', 4)} AS syy, {R('syy / (sxx * syy - sxy * sxy)')} AS ixx, {R('-sxy / (sxx * syy - sxy * sxy)')} AS ixy,
      {R('sxx / (sxx * syy - sxy * sxy)')} AS iyy FROM v""",
)
def core_covariance(t):
    d = t.merged.dropna(subset=["aud_level", "vid_flow"]).select((F.col("aud_level") - 50).alias("x"), (F.col("vid_flow") - 50).alias("y"))
    d = d.withColumn("rad", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    cut = exact_quantiles(d, [], {"rad": F.col("rad")}, [0.9])
    core = d.filter(F.col("rad") < cut.select("rad_p90").scalar())
    c = core.agg(F.covar_samp("x", "x").alias("sxx"), F.covar_samp("x", "y").alias("sxy"), F.covar_samp("y", "y").alias("syy"))
    det = F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy")
    return c.select(
        rnd("sxx", 4).alias("sxx"), rnd("sxy", 4).alias("sxy"), rnd("syy", 4).alias("syy"), rnd(F.col("syy") / det).alias("ixx"),
        rnd(-F.col("sxy") / det).alias("ixy"), rnd(F.col("sxx") / det).alias("iyy"),
    )


QS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


@query(
    "a19_quantile_report",
    "SELECT event_type, " + ", ".join(f"{R(f'quantile_cont(value, {q})')} AS value_p{round(q * 100):02d}" for q in QS) + " FROM events GROUP BY ALL",
)
def quantile_report(t):
    return rounded(exact_quantiles(t.events, ["event_type"], {"value": F.col("value")}, QS))


@query(
    "a20_embedding_qa",
    f"""WITH x AS (SELECT vec_id, label, unnest(range(0, 64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    r AS (SELECT vec_id, count(*) FILTER (x IS NULL) > 0 AS has_null, count(*) FILTER (x <> 0) = 0 AS all_zero FROM x GROUP BY vec_id),
    m AS (SELECT label, dim, avg(x) AS m FROM x GROUP BY ALL), s AS (SELECT dim, stddev_samp(m) AS s FROM m GROUP BY dim)
    SELECT {R('(SELECT min(x) FROM x)')} AS lowest, {R('(SELECT max(x) FROM x)')} AS highest, (SELECT count(*) FROM r WHERE has_null) AS n_null, (SELECT count(*) FROM r WHERE all_zero) AS n_zero,
      {R('(SELECT avg(s) FROM s)')} AS mean_std""",
)
def embedding_qa(t):
    e = F.col("embedding")
    rows = t.embeddings.agg(
        rnd(F.min(F.array_min(e)).cast("double")).alias("lowest"), rnd(F.max(F.array_max(e)).cast("double")).alias("highest"), F.count_if(F.exists(e, lambda x: x.isNull())).alias("n_null"),
        F.count_if(F.forall(e, lambda x: x == 0)).alias("n_zero"),
    )
    spread = ag.vector_stats(t.embeddings, ["label"], "embedding").groupBy("dim").agg(F.stddev_samp("mean").alias("s")).agg(F.avg("s").alias("m"))
    return rows.withColumn("mean_std", rnd(spread.select("m").scalar()))


# Orders play a folder of video files: the customer is the folder, order key the file order, priority the creation stamp.
FILES_SQL = """fl AS (SELECT o_custkey AS folder, o_orderkey AS seq, o_orderkey % 23 <> 0 AS readable,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(DATE '2024-03-01' + CAST(o_orderkey // 4000 AS INTEGER) AS DATE) END AS created,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST((o_orderkey * 37) % 1440 * 60 AS DOUBLE) END AS tod FROM orders)"""


def video_files(t: Tables):
    k = F.col("o_orderkey")
    created = F.date_add(F.lit("2024-03-01").cast("date"), F.expr("o_orderkey div 4000").cast("int"))
    return t.orders.select(
        F.col("o_custkey").alias("folder"), k.alias("seq"), (k % 23 != 0).alias("readable"), F.when(k % 19 != 0, created).alias("created"),
        F.when(k % 29 != 0, (k * 37 % 1440 * 60).cast("double")).alias("tod"),
    )


@query(
    "a21_metadata_audit",
    f"""WITH {FILES_SQL} SELECT count(*) AS n_files, count(*) FILTER (NOT readable) AS unreadable, count(*) FILTER (readable AND tod IS NULL) AS no_start, count(*) FILTER (readable) AS n_readable,
      count(DISTINCT created) FILTER (readable) AS n_creation_times, count(DISTINCT created) FILTER (readable) = 1 AND count(*) FILTER (readable) > 1 AS frozen_clock FROM fl""",
)
def metadata_audit(t):
    return ag.metadata_audit(video_files(t), "readable", "tod", "created")
