"""Clock recovery, labels and scalar expressions."""

from pyspark.sql import functions as F

from sensorgate.functions import arrays as ar
from sensorgate.functions import exprs as ex
from sensorgate.functions import parse
from sensorgate.functions.exprs import rnd
from sensorgate.operators import timeseries as ts
from sensorgate.plans.common import EV, FLOW, MERGED, R, Tables, query

# Recordings named after the event clock in the layouts of several recorders; one layout holds an impossible date.
REC_SQL = """rec AS (SELECT event_id, ts, user_id, event_type, value,
  CASE event_id % 6 WHEN 0 THEN 'S4A27290_' || strftime(ts, '%Y%m%d_%H%M%S') || '.wav'
    WHEN 1 THEN 'cam_' || strftime(ts, '%Y%m%dT%H%M%S') || '.mp4' WHEN 2 THEN strftime(ts, '%y%m%d_%H%M%S') || '.mp4'
    WHEN 3 THEN strftime(ts, '%y%m%d') || '_001_0029.WAV' WHEN 4 THEN 'ZOOM0001.wav' ELSE '20241399_250000.jpg' END AS fname,
  CASE event_id % 4 WHEN 0 THEN 'RIFF ZOOM F6    ' || strftime(ts, '%Y%m%d%H%M%S') || 'x'
    WHEN 1 THEN 'bext ' || strftime(ts, '%Y-%m-%d') || strftime(ts, '%H:%M:%S') || ' A=PCM' ELSE 'RIFF' END AS header,
  '/data/Room ' || (user_id % 4 + 1) || '/' || (CASE WHEN event_id % 9 = 0 THEN 'misc' ELSE strftime(ts, '%B %Y') END) || '/' ||
  (CASE event_id % 5 WHEN 0 THEN strftime(ts, '%-d %b') WHEN 1 THEN strftime(ts, '%b %-d') WHEN 2 THEN strftime(ts, '%-d%B')
    WHEN 3 THEN 'take 3' ELSE lower(strftime(ts, '%-d %b')) END) || '/' ||
  (CASE event_type WHEN 'view' THEN 'Audio' WHEN 'click' THEN 'video' WHEN 'signup' THEN 'thermal video' WHEN 'error' THEN 'Thermal' ELSE 'x' END)
  AS folder FROM events)"""


def recordings(t: Tables):
    e = F.col("event_id")
    fmt = lambda p: F.date_format("ts", p)
    fname = (
        F.when(e % 6 == 0, F.concat(F.lit("S4A27290_"), fmt("yyyyMMdd_HHmmss"), F.lit(".wav")))
        .when(e % 6 == 1, F.concat(F.lit("cam_"), fmt("yyyyMMdd'T'HHmmss"), F.lit(".mp4")))
        .when(e % 6 == 2, F.concat(fmt("yyMMdd_HHmmss"), F.lit(".mp4")))
        .when(e % 6 == 3, F.concat(fmt("yyMMdd"), F.lit("_001_0029.WAV")))
        .when(e % 6 == 4, F.lit("ZOOM0001.wav"))
        .otherwise(F.lit("20241399_250000.jpg"))
    )
    header = (
        F.when(e % 4 == 0, F.concat(F.lit("RIFF ZOOM F6    "), fmt("yyyyMMddHHmmss"), F.lit("x")))
        .when(e % 4 == 1, F.concat(F.lit("bext "), fmt("yyyy-MM-dd"), fmt("HH:mm:ss"), F.lit(" A=PCM")))
        .otherwise(F.lit("RIFF"))
    )
    month = F.when(e % 9 == 0, F.lit("misc")).otherwise(fmt("MMMM yyyy"))
    day = (
        F.when(e % 5 == 0, fmt("d MMM")).when(e % 5 == 1, fmt("MMM d")).when(e % 5 == 2, fmt("dMMMM"))
        .when(e % 5 == 3, F.lit("take 3")).otherwise(F.lower(fmt("d MMM")))
    )
    kind = F.col("event_type")
    leaf = (
        F.when(kind == "view", F.lit("Audio")).when(kind == "click", F.lit("video")).when(kind == "signup", F.lit("thermal video"))
        .when(kind == "error", F.lit("Thermal")).otherwise(F.lit("x"))
    )
    folder = F.concat_ws("/", F.lit("/data"), F.concat(F.lit("Room "), F.col("user_id") % 4 + 1), month, day, leaf)
    return t.events.select("*", fname.alias("fname"), header.alias("header"), folder.alias("folder"))


def ntz(c):
    return c.cast("timestamp_ntz")


@query(
    "p01_filename_timestamp",
    f"""WITH {REC_SQL}, x AS (SELECT event_id, ts, try_strptime(regexp_extract(fname, '(\\d{{8}}_\\d{{6}})', 1), '%Y%m%d_%H%M%S') AS s FROM rec)
    SELECT event_id, coalesce(s, date_trunc('minute', ts)) AS start, CASE WHEN s IS NULL THEN 'mtime' ELSE 'filename' END AS ts_source FROM x""",
)
def filename_timestamp(t):
    d = recordings(t).select("event_id", "ts", parse.filename_start("fname").alias("s"))
    source = F.when(F.col("s").isNull(), F.lit("mtime")).otherwise(F.lit("filename"))
    return d.select("event_id", ntz(F.coalesce("s", F.date_trunc("minute", "ts"))).alias("start"), source.alias("ts_source"))


STEM = "regexp_replace(fname, '\\.[^.]*$', '')"


@query(
    "p02_multi_pattern_datetime",
    f"""WITH {REC_SQL} SELECT event_id, coalesce(try_strptime(regexp_extract({STEM}, '(\\d{{8}}_\\d{{6}})', 1), '%Y%m%d_%H%M%S'),
      try_strptime(regexp_extract({STEM}, '(\\d{{8}}T\\d{{6}})', 1), '%Y%m%dT%H%M%S'),
      try_strptime(regexp_extract({STEM}, '(\\d{{6}}_\\d{{6}})', 1), '%y%m%d_%H%M%S')) AS start FROM rec""",
)
def multi_pattern_datetime(t):
    return recordings(t).select("event_id", ntz(parse.filename_datetime("fname")).alias("start"))


@query(
    "p03_multi_pattern_date",
    f"""WITH {REC_SQL} SELECT event_id, CAST(coalesce(try_strptime(regexp_extract({STEM}, '(\\d{{8}})_\\d{{6}}', 1), '%Y%m%d'),
      try_strptime(regexp_extract({STEM}, '(\\d{{6}})_\\d{{3}}', 1), '%y%m%d'),
      try_strptime(regexp_extract({STEM}, '(\\d{{6}})', 1), '%y%m%d')) AS DATE) AS day FROM rec""",
)
def multi_pattern_date(t):
    return recordings(t).select("event_id", parse.filename_date("fname").alias("day"))


@query(
    "p04_timestamp_fallback_chain",
    f"""WITH {REC_SQL}, x AS (SELECT event_id, ts, try_strptime(regexp_extract(fname, '(\\d{{8}}_\\d{{6}})', 1), '%Y%m%d_%H%M%S') AS a,
      coalesce(try_strptime(regexp_extract(header, 'ZOOM\\s*F6\\s+(\\d{{14}})', 1), '%Y%m%d%H%M%S'),
        try_strptime(regexp_extract(header, '(\\d{{4}}-\\d{{2}}-\\d{{2}})[ T]?(\\d{{2}}:\\d{{2}}:\\d{{2}})', 1) || ' ' ||
          regexp_extract(header, '(\\d{{4}}-\\d{{2}}-\\d{{2}})[ T]?(\\d{{2}}:\\d{{2}}:\\d{{2}})', 2), '%Y-%m-%d %H:%M:%S')) AS b,
      try_strptime(regexp_extract(fname, '^(\\d{{6}})[_\\-]', 1), '%y%m%d') AS c FROM rec)
    SELECT event_id, coalesce(a, b, c, ts) AS start, CASE WHEN a IS NOT NULL THEN 'filename' WHEN b IS NOT NULL THEN 'metadata'
      WHEN c IS NOT NULL THEN 'filedate' ELSE 'mtime' END AS ts_source FROM x""",
)
def fallback_chain(t):
    d = recordings(t).select("event_id", parse.recording_start("fname", "header", "ts").alias("r"))
    return d.select("event_id", ntz(F.col("r.start")).alias("start"), "r.ts_source")


TC_SQL = """tc AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'bad' WHEN event_id % 17 = 0 THEN '25:' || strftime(ts, '%M:%S') || ':10'
  ELSE strftime(ts, '%H:%M:%S') || ';' || lpad(CAST(event_id % 30 AS VARCHAR), 2, '0') END AS timecode,
  CASE WHEN event_id % 7 = 0 THEN '25/0' ELSE '30000/1001' END AS ratio FROM events)"""


def timecodes(t: Tables):
    e = F.col("event_id")
    code = (
        F.when(e % 13 == 0, F.lit("bad"))
        .when(e % 17 == 0, F.concat(F.lit("25:"), F.date_format("ts", "mm:ss"), F.lit(":10")))
        .otherwise(F.concat(F.date_format("ts", "HH:mm:ss"), F.lit(";"), F.lpad((e % 30).cast("string"), 2, "0")))
    )
    ratio = F.when(e % 7 == 0, F.lit("25/0")).otherwise(F.lit("30000/1001"))
    return t.events.select("event_id", code.alias("timecode"), ratio.alias("ratio"))


FPS = "(CAST(split_part(ratio, '/', 1) AS DOUBLE) / CASE WHEN CAST(split_part(ratio, '/', 2) AS DOUBLE) = 0 THEN 1.0 ELSE CAST(split_part(ratio, '/', 2) AS DOUBLE) END)"


@query(
    "p05_smpte_timecode",
    f"""WITH {TC_SQL}, p AS (SELECT event_id, string_split(replace(timecode, ';', ':'), ':') AS s, {FPS} AS fps FROM tc)
    SELECT event_id, CASE WHEN len(s) = 4 AND round(CAST(s[4] AS INTEGER) / fps * 1e6) <= 999999 THEN
      {R('(CAST(s[1] AS INTEGER) % 24) * 3600.0 + CAST(s[2] AS INTEGER) * 60.0 + CAST(s[3] AS INTEGER) + round(CAST(s[4] AS INTEGER) / fps * 1e6) / 1e6')} END AS seconds FROM p""",
)
def smpte(t):
    d = timecodes(t).withColumn("fps", parse.frame_rate("ratio"))
    return d.select("event_id", rnd(parse.timecode_seconds("timecode", "fps")).alias("seconds"))


@query("p06_rational_frame_rate", f"WITH {TC_SQL} SELECT event_id, {R(FPS)} AS fps FROM tc")
def rational_rate(t):
    return timecodes(t).select("event_id", rnd(parse.frame_rate("ratio")).alias("fps"))


@query(
    "p07_month_resolver",
    """WITH x AS (SELECT o_orderkey, o_orderdate, CASE o_orderkey % 3 WHEN 0 THEN upper(strftime(o_orderdate, '%B'))
      WHEN 1 THEN strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m') ELSE 'Brumaire' END AS label FROM orders),
    y AS (SELECT o_orderkey, o_orderdate, label, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '2025-%m')
      WHEN 1 THEN label END AS month_iso FROM x)
    SELECT o_orderkey, CAST(right(month_iso, 2) AS INTEGER) AS month, month_iso,
      month(o_orderdate) <> CAST(right(month_iso, 2) AS INTEGER) AS mismatch FROM y""",
)
def month_resolver(t):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    label = (
        F.when(k % 3 == 0, F.upper(F.date_format(d, "MMMM")))
        .when(k % 3 == 1, F.date_format(F.date_add(d.cast("date"), 40), "yyyy-MM"))
        .otherwise(F.lit("Brumaire"))
    )
    x = t.orders.select(k, d, parse.month_of(label).alias("m"))
    return x.select("o_orderkey", "m.month", "m.month_iso", (F.month("o_orderdate") != F.col("m.month")).alias("mismatch"))


@query(
    "p08_folder_date",
    f"""WITH {REC_SQL} SELECT event_id, CASE WHEN event_id % 5 <> 3 THEN
      make_date(CASE WHEN event_id % 9 = 0 THEN 2025 ELSE 2024 END, month(ts), day(ts)) END AS day FROM rec""",
)
def folder_date(t):
    path = F.concat_ws("/", "folder", "fname")
    return recordings(t).select("event_id", parse.folder_date(path).alias("day"))


DATE_LABEL_SQL = """lab AS (SELECT o_orderkey AS k, year(o_orderdate) AS y, CASE o_orderkey % 5
  WHEN 0 THEN 'Room 8 ' || strftime(o_orderdate, '%b%d') || '-' || strftime(o_orderdate + INTERVAL 3 DAY, '%d')
  WHEN 1 THEN '29, 30, 31 ' || strftime(o_orderdate, '%B') || ' audio'
  WHEN 2 THEN strftime(o_orderdate, '%-d %B') || ' - ' || strftime(o_orderdate + INTERVAL 9 DAY, '%-d %b') || ' data'
  WHEN 3 THEN 'video room10 take 4' ELSE strftime(o_orderdate, '%b%d-') || strftime(o_orderdate + INTERVAL 20 DAY, '%b%d') || ' ' || o_orderpriority END AS s
  FROM orders)"""
MONTHS_SQL = "mon AS (SELECT unnest(['january','february','march','april','may','june','july','august','september','october','november','december']) AS w, unnest(range(1, 13)) AS m), mo AS (SELECT w, m FROM mon UNION SELECT left(w, 3), m FROM mon)"


@query(
    "p09_dates_from_text",
    f"""WITH {DATE_LABEL_SQL}, {MONTHS_SQL},
    st AS (SELECT k, y, regexp_replace(regexp_replace(lower(s), 'room\\s*\\d+', ' ', 'g'), '\\b(audio|video|thermal|data)\\b', ' ', 'g') AS s FROM lab),
    tk AS (SELECT k, y, regexp_extract_all(s, '[a-z]+|[0-9]+|[^a-z0-9]+') AS a FROM st),
    pos AS (SELECT k, y, i, a[i] AS w, len(array_to_string(a[1:i-1], '')) AS ap FROM (SELECT k, y, a, unnest(range(1, len(a) + 1)) AS i FROM tk)),
    mp AS (SELECT k, ap, m FROM pos JOIN mo ON pos.w = mo.w),
    np AS (SELECT k, y, ap, TRY_CAST(w AS INTEGER) AS d FROM pos WHERE TRY_CAST(w AS INTEGER) BETWEEN 1 AND 31),
    best AS (SELECT np.k, np.y, np.ap, np.d, arg_min(mp.m, abs(mp.ap - np.ap) * 100000 + mp.ap) AS m FROM np JOIN mp ON mp.k = np.k GROUP BY ALL)
    SELECT k AS o_orderkey, CAST(try_strptime(y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0'), '%Y-%m-%d') AS DATE) AS date
    FROM best WHERE try_strptime(y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0'), '%Y-%m-%d') IS NOT NULL""",
)
def dates_from_text(t):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    after = lambda n, p: F.date_format(F.date_add(d.cast("date"), n), p)
    now = lambda p: F.date_format(d, p)
    label = (
        F.when(k % 5 == 0, F.concat(F.lit("Room 8 "), now("MMMdd"), F.lit("-"), after(3, "dd")))
        .when(k % 5 == 1, F.concat(F.lit("29, 30, 31 "), now("MMMM"), F.lit(" audio")))
        .when(k % 5 == 2, F.concat(now("d MMMM"), F.lit(" - "), after(9, "d MMM"), F.lit(" data")))
        .when(k % 5 == 3, F.lit("video room10 take 4"))
        .otherwise(F.concat(now("MMMdd-"), after(20, "MMMdd"), F.lit(" "), "o_orderpriority"))
    )
    x = t.orders.select(k, F.year(d).alias("y"), label.alias("label"))
    return parse.dates_in_text(x, ["o_orderkey"], "label", "y")


@query(
    "p10_path_classification",
    f"""WITH {REC_SQL}, x AS (SELECT event_id, lower(folder || '/' || fname) AS p, lower(regexp_extract(fname, '\\.([^.]+)$', 1)) AS e FROM rec)
    SELECT event_id, 'Room' || CAST(regexp_extract(p, 'room\\s*(\\d+)', 1) AS INTEGER) AS room,
      CASE WHEN contains(p, 'video') THEN 'video' WHEN contains(p, 'thermal') THEN 'thermal' WHEN contains(p, 'audio') THEN 'audio' ELSE 'other' END AS modality,
      CASE WHEN e = 'wav' THEN 'audio' WHEN e = 'mp4' THEN 'video' WHEN e = 'jpg' THEN 'thermal' END AS ext_kind FROM x""",
)
def path_classification(t):
    path = F.concat_ws("/", "folder", "fname")
    return recordings(t).select(
        "event_id", parse.room_label(path).alias("room"), parse.modality_label(path).alias("modality"), parse.extension_label(path).alias("ext_kind")
    )


@query(
    "p11_time_bucketing",
    """SELECT date_trunc('minute', ts) AS minute, time_bucket(INTERVAL 15 MINUTE, ts) AS quarter, date_trunc('hour', ts) AS hour, CAST(ts AS DATE) AS day,
      CAST(hour(ts) AS INTEGER) AS hour_of_day, count(*) AS n FROM events GROUP BY ALL""",
)
def time_bucketing(t):
    d = t.events.groupBy(
        ntz(F.date_trunc("minute", "ts")).alias("minute"),
        F.window("ts", "15 minutes").alias("w"),
        ntz(F.date_trunc("hour", "ts")).alias("hour"),
        F.col("ts").cast("date").alias("day"),
        F.hour("ts").alias("hour_of_day"),
    ).agg(F.count("*").alias("n"))
    return d.select("minute", ntz(F.col("w.start")).alias("quarter"), "hour", "day", "hour_of_day", "n")


@query(
    "p12_frame_clock",
    """WITH x AS (SELECT event_id, ts, unnest(range(0, CAST(user_id % 4 AS INTEGER) + 2)) AS i FROM events)
    SELECT event_id, CAST(i AS INTEGER) AS frame, make_timestamp(epoch_us(ts) + CAST(round(i * 1e6 / 29.97) AS BIGINT)) AS frame_ts FROM x""",
)
def frame_clock(t):
    frames = F.explode(F.sequence(F.lit(0), (F.col("user_id") % 4 + 1).cast("int"))).alias("frame")
    d = t.events.select("event_id", "ts", frames)
    return d.select("event_id", "frame", ntz(parse.frame_clock("ts", "frame", F.lit(29.97))).alias("frame_ts"))


@query(
    "p13_prefix_columns",
    "SELECT s_suppkey, s_name AS env_s_name, s_nationkey AS env_s_nationkey, s_acctbal AS env_s_acctbal FROM supplier",
)
def prefix(t):
    return ex.prefix_columns(t.supplier, "env_", ["s_suppkey"])


@query(
    "p14_scalar_math",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, {R('20 * log10(l_quantity + 1e-10)')} AS db_amp, {R('10 * log10(l_extendedprice + 1e-10)')} AS db_pow,
      {R('sqrt(greatest(l_discount, 0))')} AS root, {R('least(greatest(l_tax - l_discount, -0.02), 0.02)')} AS clipped, {R('abs(l_tax - l_discount)')} AS gap,
      {R('l_tax / (l_discount + 1e-9)', 3)} AS ratio FROM lineitem""",
)
def scalar_math(t):
    disc, tax = F.col("l_discount"), F.col("l_tax")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        rnd(ex.decibel_amplitude("l_quantity")).alias("db_amp"),
        rnd(ex.decibel_power("l_extendedprice")).alias("db_pow"),
        rnd(F.sqrt(F.greatest(disc, F.lit(0.0)))).alias("root"),
        rnd(ex.clip(tax - disc, -0.02, 0.02)).alias("clipped"),
        rnd(F.abs(tax - disc)).alias("gap"),
        rnd(tax / (disc + 1e-9), 3).alias("ratio"),
    )


@query(
    "p15_presence_flags",
    f"""WITH {MERGED} SELECT entity, hr, aud_level IS NOT NULL OR aud_n IS NOT NULL AS has_audio, coalesce(vid_n > 1, false) AS has_many,
      vid_flow IS NOT NULL AS has_video_lit FROM merged""",
)
def presence(t):
    return t.merged.select(
        "entity", "hr", ex.any_present(["aud_level", "aud_n"]).alias("has_audio"), ex.is_true(F.col("vid_n") > 1).alias("has_many"),
        ex.any_present(["vid_flow"]).alias("has_video_lit"),
    )


@query(
    "p16_coverage_state",
    f"""WITH {MERGED} SELECT entity, hr, CASE WHEN aud_level IS NOT NULL AND vid_flow IS NOT NULL THEN 'both_lit'
      WHEN aud_level IS NOT NULL THEN 'audio_only' WHEN vid_flow IS NOT NULL THEN 'video_only' ELSE 'gap' END AS coverage_state FROM merged""",
)
def coverage(t):
    state = ex.coverage_state(F.col("aud_level").isNotNull(), F.col("vid_flow").isNotNull())
    return t.merged.select("entity", "hr", state.alias("coverage_state"))


@query(
    "p17_row_mean",
    f"""WITH {MERGED} SELECT entity, hr, {R('list_avg(list_filter([aud_level, vid_flow, env_temp], lambda x: x IS NOT NULL))', 8)} AS composite FROM merged""",
)
def row_mean(t):
    return t.merged.select("entity", "hr", rnd(ex.row_mean(["aud_level", "vid_flow", "env_temp"]), 8).alias("composite"))


@query(
    "p18_block_norm",
    f"SELECT vec_id, {R('sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)))')} AS energy FROM embeddings",
)
def block_norm(t):
    return t.embeddings.select("vec_id", rnd(ar.l2_norm("embedding")).alias("energy"))


# Embedding positions play frequency bins 0, 125, 250 ... Hz; squared values play power.
SPEC_SQL = """sp AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x) AS p,
  list_transform(range(0, 64), lambda i: i * 125.0::DOUBLE) AS f,
  list_transform(range(0, 64), lambda i: CASE WHEN i * 125.0 BETWEEN 450 AND 550 OR i * 125.0 BETWEEN 950 AND 1050 THEN 0.0::DOUBLE
    WHEN i * 125.0 BETWEEN 1800 AND 2200 OR i * 125.0 BETWEEN 900 AND 1300 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END) AS g FROM embeddings)"""


def spectra(t: Tables):
    freqs = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i * 125.0)
    power = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    gain = ar.band_gain(freqs, [500, 1000], [2000, 1100], 50, 200, 0.3)
    return t.embeddings.select("vec_id", "label", power.alias("p"), freqs.alias("f"), gain.alias("g"))


@query("p19_band_gain_mask", f"WITH {SPEC_SQL} SELECT vec_id, unnest(range(0, 64)) AS bin, unnest(g) AS gain, {R('unnest(p) * unnest(g)')} AS power FROM sp")
def gain_mask(t):
    d = spectra(t).select("vec_id", F.posexplode(F.arrays_zip("p", "g")).alias("bin", "z"))
    return d.select("vec_id", F.col("bin").cast("long").alias("bin"), F.col("z.g").alias("gain"), rnd(F.col("z.p") * F.col("z.g")).alias("power"))


def _s(expr):
    return f"list_sum([{expr} for i in range(1, 65)])"


@query(
    "p20_spectrum_descriptors",
    f"""WITH {SPEC_SQL} SELECT vec_id, {R(_s('f[i] * sqrt(p[i])') + ' / (' + _s('sqrt(p[i])') + ' + 1e-10)', 4)} AS centroid,
      {R(_s('CASE WHEN f[i] >= 500 AND f[i] < 2000 THEN p[i] ELSE 0 END') + ' / (' + _s('p[i]') + ' + 1e-10)')} AS mid_frac,
      {R('10 * log10(' + _s('p[i]') + ' + 1e-10)')} AS energy_db,
      {R(_s('f[i] * sqrt(p[i] * g[i])') + ' / (' + _s('sqrt(p[i] * g[i])') + ' + 1e-10)', 4)} AS centroid_clean,
      {R('10 * log10(' + _s('p[i] * g[i]') + ' + 1e-10)')} AS energy_db_clean FROM sp""",
)
def descriptors(t):
    masked = F.zip_with("p", "g", lambda a, b: a * b)
    return spectra(t).select(
        "vec_id",
        rnd(ar.spectral_centroid("p", "f"), 4).alias("centroid"),
        rnd(ar.band_fraction("p", "f", 500, 2000)).alias("mid_frac"),
        rnd(ar.total_energy_db("p")).alias("energy_db"),
        rnd(ar.spectral_centroid("p", "f", "g"), 4).alias("centroid_clean"),
        rnd(ar.total_energy_db(masked)).alias("energy_db_clean"),
    )


@query(
    "p21_spectral_flux",
    f"""WITH x AS (SELECT vec_id, label, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS q FROM embeddings)
    SELECT vec_id, label, {R('coalesce(sqrt(' + _s('pow(greatest(abs(CAST(e[i] AS DOUBLE)) - abs(CAST(q[i] AS DOUBLE)), 0), 2)') + '), 0)')} AS flux FROM x""",
)
def flux(t):
    from sensorgate.operators.scan import previous_row

    d = t.embeddings.select("vec_id", "label", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("a"))
    d = previous_row(d, ["label"], ["vec_id"], ["a"], "q", F.floor(F.col("vec_id") / 65536).cast("long"))
    return d.select("vec_id", "label", rnd(ar.spectral_flux("a", "q.a")).alias("flux"))


@query(
    "p22_otsu_threshold_group",
    f"""WITH x AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    e AS (SELECT label, min(x) AS lo, (max(x) - min(x)) / 256 AS w FROM x GROUP BY label),
    b AS (SELECT label, lo + (least(floor((x - lo) / w), 255) + 0.5) * w AS c, count(*) AS n FROM x JOIN e USING (label) GROUP BY ALL),
    m AS (SELECT label, c, sum(n) OVER a / sum(n) OVER g AS w, sum(n * c) OVER a / sum(n) OVER g AS m, sum(n * c) OVER g / sum(n) OVER g AS mt
      FROM b WINDOW a AS (PARTITION BY label ORDER BY c), g AS (PARTITION BY label)),
    s AS (SELECT label, c, pow(mt * w - m, 2) / CASE WHEN w * (1 - w) = 0 THEN 1e-12 ELSE w * (1 - w) END AS s FROM m),
    t AS (SELECT label, c, row_number() OVER (PARTITION BY label ORDER BY s DESC, c) AS rk FROM s)
    SELECT label, {R('c')} AS threshold, (SELECT count(*) FROM x WHERE x.label = t.label) AS n_values FROM t WHERE rk = 1""",
)
def otsu_group(t):
    values = t.embeddings.select("label", F.explode("embedding").alias("x"))
    return ar.grouped_otsu(values, ["label"], "x").withColumn("threshold", rnd("threshold"))


OTSU_ROW = """px AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) * 10 + 30 AS x FROM embeddings),
  e AS (SELECT vec_id, min(x) AS lo, (max(x) - min(x)) / 256 AS w FROM px GROUP BY vec_id),
  b AS (SELECT vec_id, lo + (least(floor((x - lo) / w), 255) + 0.5) * w AS c, count(*) AS n FROM px JOIN e USING (vec_id) GROUP BY ALL),
  m AS (SELECT vec_id, c, sum(n) OVER a / sum(n) OVER g AS w, sum(n * c) OVER a / sum(n) OVER g AS m, sum(n * c) OVER g / sum(n) OVER g AS mt
    FROM b WINDOW a AS (PARTITION BY vec_id ORDER BY c), g AS (PARTITION BY vec_id)),
  s AS (SELECT vec_id, c, round(pow(mt * w - m, 2) / CASE WHEN w * (1 - w) = 0 THEN 1e-12 ELSE w * (1 - w) END, 12) AS s FROM m),
  cut AS (SELECT vec_id, c FROM (SELECT vec_id, c, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c) AS rk FROM s) WHERE rk = 1)"""


def warm_frames(t: Tables):
    return t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 10 + 30).alias("frame"))


@query("p22_otsu_threshold_row", f"WITH {OTSU_ROW} SELECT vec_id, {R('c')} AS threshold FROM cut")
def otsu_row(t):
    return warm_frames(t).select("vec_id", rnd(ar.otsu_cut("frame")).alias("threshold"))


@query(
    "p23_masked_frame_features",
    f"""WITH {OTSU_ROW}, k AS (SELECT vec_id, c, count(*) FILTER (x > c) AS n_mask, count(*) AS n, avg(x) FILTER (x > c) AS t_mean,
      quantile_cont(x, 0.1) FILTER (x > c) AS t_p10, quantile_cont(x, 0.9) FILTER (x > c) AS t_p90, max(x) FILTER (x > c) AS t_max,
      stddev_pop(x) FILTER (x > c) AS t_std, count(*) FILTER (x > c AND x > 31) AS n_hot, median(x) FILTER (x <= c) AS rest_median
      FROM px JOIN cut USING (vec_id) GROUP BY ALL)
    SELECT vec_id, {R('c')} AS otsu, {R('n_mask / n')} AS mask_frac, CAST(n_mask AS INTEGER) AS n_mask, CASE WHEN n_mask >= 10 THEN {R('t_mean')} END AS t_mean,
      CASE WHEN n_mask >= 10 THEN {R('t_p10')} END AS t_p10, CASE WHEN n_mask >= 10 THEN {R('t_p90')} END AS t_p90, CASE WHEN n_mask >= 10 THEN {R('t_max')} END AS t_max,
      CASE WHEN n_mask >= 10 THEN {R('t_std')} END AS t_std, CASE WHEN n_mask >= 10 THEN {R('n_hot / n_mask')} END AS hot_frac, {R('rest_median')} AS rest_median,
      n_mask / n > 0.02 AND n_mask / n < 0.95 AS mask_ok FROM k""",
)
def masked_features(t):
    d = warm_frames(t).withColumn("m", ar.masked_features(hot=31.0)("frame")).select("vec_id", "m.*")
    return d.withColumns({c: rnd(c) for c, k in d.dtypes if k == "double"})


@query(
    "p24_array_histogram",
    f"""WITH x AS (SELECT vec_id, abs(CAST(unnest(embedding) AS DOUBLE)) * 60 AS x FROM embeddings),
    b AS (SELECT vec_id, least(CAST(floor(least(greatest(x, 0), 20) * 32 / 20) AS INTEGER), 31) AS bin FROM x),
    g AS (SELECT vec_id, unnest(range(0, 32)) AS bin FROM embeddings)
    SELECT g.vec_id, CAST(g.bin AS INTEGER) AS bin, count(b.bin) / 64 AS share FROM g LEFT JOIN b ON b.vec_id = g.vec_id AND b.bin = g.bin GROUP BY ALL""",
)
def histogram(t):
    mag = F.transform("embedding", lambda x: F.abs(x.cast("double")) * 60)
    d = t.embeddings.select("vec_id", F.posexplode_outer(ar.value_histogram(mag, 32, 20.0)).alias("bin", "share"))
    return d


@query(
    "p24_grid_cells",
    f"""WITH x AS (SELECT vec_id, unnest(range(0, 64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
    SELECT vec_id, CAST(((i // 10) // 2) * 3 + (i % 10) // 3 AS INTEGER) AS cell, {R('avg(x)')} AS mean, {R('stddev_pop(x)')} AS std FROM x
    WHERE i // 10 < 6 AND i % 10 < 9 GROUP BY ALL""",
)
def grid(t):
    """Width 10 and a 3 x 3 grid: the trailing row and column belong to no cell."""
    d = t.embeddings.select("vec_id", F.posexplode_outer(ar.grid_cells("embedding", 10, 3)).alias("cell", "c"))
    return d.select("vec_id", "cell", rnd("c.mean").alias("mean"), rnd("c.std").alias("std"))


@query(
    "p25_clip_flag",
    f"SELECT vec_id, {R('len(list_filter(embedding, lambda x: abs(x) > 0.2)) / 64')} AS clip_share, len(list_filter(embedding, lambda x: abs(x) > 0.2)) / 64 > 0.15 AS clipped FROM embeddings",
)
def clip_share(t):
    share = ar.fraction_where("embedding", lambda x: F.abs(x) > F.lit(0.2).cast("float"))
    return t.embeddings.select("vec_id", rnd(share).alias("clip_share"), ar.clip_flag("embedding", F.lit(0.2).cast("float"), 0.15).alias("clipped"))


@query(
    "p26_activity_flags",
    f"""WITH {FLOW}, x AS (SELECT entity, hr, n, 20 * log10(v + 1e-10) AS db FROM flow),
    y AS (SELECT entity, hr, n, db, CASE WHEN count(db) OVER a >= 10 THEN quantile_cont(db, 0.5) OVER a END AS base,
      CASE WHEN count(db) OVER b >= 5 THEN quantile_cont(db, 0.5) OVER b END AS base50 FROM x
      WINDOW a AS (PARTITION BY entity ORDER BY hr ROWS BETWEEN 100 PRECEDING AND 99 FOLLOWING),
        b AS (PARTITION BY entity ORDER BY hr ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING))
    SELECT entity, hr, {R('db - base')} AS rel_db, n > 2 AND db - base > 2 AS voc_active, db - base50 > 12 AS transient FROM y""",
)
def activity_flags(t):
    d = t.flow.withColumn("db", ex.decibel_amplitude("v"))
    d = ts.rolling_median_rows(d, ["entity"], ["hr"], "db", "base", 200, 10)
    d = ts.rolling_median_rows(d, ["entity"], ["hr"], "db", "base50", 50, 5)
    rel = F.col("db") - F.col("base")
    return d.select(
        "entity", "hr", rnd(rel).alias("rel_db"), ((F.col("n") > 2) & (rel > 2)).alias("voc_active"),
        (F.col("db") - F.col("base50") > 12).alias("transient"),
    )
