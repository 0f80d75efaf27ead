"""Scans, sources and sinks."""

from pyspark.sql import functions as F

from sensorgate.functions.exprs import rnd
from sensorgate.plans.common import EV, R, Tables, query
from sensorgate.session import scratch_path
from sensorgate.sources import readers as io

EVENT_CSV = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"


def _event_csv(t: Tables, name: str, rows) -> str:
    path = scratch_path(t.spark, name)
    io.write_csv(rows.select("event_id", "ts", "user_id", "event_type", "value"), path)
    return path


@query("s01_csv_multi_file_scan", "SELECT event_id, ts, user_id, event_type, value FROM events")
def csv_scan(t):
    early = F.dayofmonth("ts") <= 15
    paths = [_event_csv(t, "first", t.events.filter(early)), _event_csv(t, "second", t.events.filter(~early))]
    return io.read_csv(t.spark, paths, EVENT_CSV)


@query(
    "s02_tolerant_tagged_scan",
    f"""SELECT CASE WHEN event_type = 'purchase' THEN 'video' ELSE 'other' END AS source, count(*) AS n, {R('sum(value)', 3)} AS total
    FROM events GROUP BY 1""",
)
def tolerant_scan(t):
    video = F.col("event_type") == "purchase"
    paths = [_event_csv(t, "video", t.events.filter(video)), _event_csv(t, "other", t.events.filter(~video))]
    d = io.read_existing(t.spark, [*paths, scratch_path(t.spark, "absent")], EVENT_CSV)
    source = F.regexp_extract("source_path", r"/(video|other)-[0-9a-f]+/", 1)
    return d.groupBy(source.alias("source")).agg(F.count("*").alias("n"), rnd(F.sum("value"), 3).alias("total"))


@query(
    "s03_time_column_discovery",
    "SELECT o_orderkey, o_orderdate AS time, CAST(o_orderdate AS DATE) AS day FROM orders",
)
def time_discovery(t):
    text = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"))
    d = io.with_time(text, "time")
    return d.select("o_orderkey", F.col("time").cast("timestamp_ntz").alias("time"), F.col("time").cast("date").alias("day"))


@query(
    "s04_keyword_column_resolver",
    f"""SELECT l_shipdate AS day, {R('avg(l_extendedprice)')} AS env_price, {R('max(l_discount)', 4)} AS env_disc
    FROM lineitem GROUP BY 1""",
)
def column_resolver(t):
    daily = t.lineitem.groupBy(F.col("l_shipdate").alias("ship_date")).agg(
        F.max("l_extendedprice").alias("price_max"),
        F.avg("l_extendedprice").alias("price_day_mean"),
        F.max("l_discount").alias("disc_max"),
        F.min("l_discount").alias("disc_min"),
    )
    price, disc = (io.find_value_column(daily.columns, k) for k in (["price"], ["rebate", "disc"]))
    clock = io.find_time_column(daily.columns)
    return daily.select(F.col(clock).alias("day"), rnd(price).alias("env_price"), rnd(disc, 4).alias("env_disc"))


@query(
    "s05_parquet_partitioned_sink",
    f"""WITH {EV} SELECT CAST(entity AS INTEGER) AS entity, CAST(dy - 19723 AS INTEGER) AS day, event_type, count(*) AS n, {R('sum(value)', 3)} AS total
    FROM ev GROUP BY ALL""",
)
def parquet_sink(t):
    path = scratch_path(t.spark, "tier")
    d = t.ev.select("entity", (F.col("dy") - 19723).alias("day"), "event_type", "value").repartition("entity", "day")
    io.write_parquet(d, path, ["entity", "day"])
    back = t.spark.read.parquet(path)
    return back.groupBy("entity", "day", "event_type").agg(F.count("*").alias("n"), rnd(F.sum("value"), 3).alias("total"))


@query(
    "s06_csv_result_sink",
    f"WITH {EV} SELECT entity, hr, count(*) AS n, max(value) AS top FROM ev GROUP BY ALL",
)
def csv_sink(t):
    path = scratch_path(t.spark, "result")
    io.write_csv(t.ev.groupBy("entity", "hr").agg(F.count("*").alias("n"), F.max("value").alias("top")), path)
    return io.read_csv(t.spark, path, "entity bigint, hr bigint, n bigint, top double")


PROBE_DOC = (
    "concat('{\"format\":{\"duration\":\"', value, '\",\"tags\":{\"creation_time\":\"', %s, '\"}},\"streams\":[{\"codec_type\":\"audio\"}',"
    " CASE WHEN event_type <> 'error' THEN concat(',{\"codec_type\":\"video\",\"avg_frame_rate\":\"', 30000 + user_id, '/',"
    " user_id %% 3 * 1001, '\",\"width\":', 640 + user_id, ',\"tags\":{\"timecode\":\"', %s, '\"}}') ELSE '' END, ']}')"
)
PROBE_SPARK = PROBE_DOC % ("date_format(ts, 'yyyy-MM-dd')", "date_format(ts, 'HH:mm:ss;')||lpad(cast(event_id % 30 as string),2,'0')")
PROBE_SQL = PROBE_DOC % ("strftime(ts, '%Y-%m-%d')", "strftime(ts, '%H:%M:%S;')||lpad(cast(event_id % 30 as varchar),2,'0')")


@query(
    "s07_json_metadata",
    f"""WITH doc AS (SELECT event_id, CAST({PROBE_SQL} AS JSON) AS j, CAST(props->>'k' AS INTEGER) AS k FROM events)
    SELECT event_id, j->'format'->'tags'->>'creation_time' AS creation_time, CAST(j->'format'->>'duration' AS DOUBLE) AS duration_s,
      j->'streams'->1->>'avg_frame_rate' AS avg_frame_rate, j->'streams'->1->'tags'->>'timecode' AS timecode,
      CAST(j->'streams'->1->>'width' AS INTEGER) AS width, k FROM doc""",
)
def json_metadata(t):
    d = t.events.select("event_id", io.parse_probe(F.expr(PROBE_SPARK)).alias("p"), F.from_json("props", "k int").alias("q"))
    return d.select("event_id", "p.*", "q.k")


PATH_SQL = """SELECT event_id, '/data/Room ' || (user_id % 4 + 1) || '/' || event_type || '/' || (CASE WHEN event_id % 5 = 0 THEN '._' ELSE '' END)
  || 'REC_' || strftime(ts, '%Y%m%d_%H') || (CASE event_id % 3 WHEN 0 THEN '.WAV' WHEN 1 THEN '.flac' ELSE '.txt' END) AS path FROM events"""


def event_paths(t: Tables):
    shadow = F.when(F.col("event_id") % 5 == 0, F.lit("._")).otherwise(F.lit(""))
    ext = F.when(F.col("event_id") % 3 == 0, F.lit(".WAV")).when(F.col("event_id") % 3 == 1, F.lit(".flac")).otherwise(F.lit(".txt"))
    return t.events.select(
        "event_id",
        F.concat(
            F.lit("/data/Room "), F.col("user_id") % 4 + 1, F.lit("/"), "event_type", F.lit("/"), shadow,
            F.lit("REC_"), F.date_format("ts", "yyyyMMdd_HH"), ext,
        ).alias("path"),
    )


@query(
    "s08_file_catalogue",
    f"""WITH p AS ({PATH_SQL}) SELECT DISTINCT path FROM p WHERE regexp_matches(lower(path), '\\.(wav|flac)$')
    AND NOT regexp_matches(path, '/\\._[^/]*$')""",
)
def file_catalogue(t):
    return io.media_files(event_paths(t), ["wav", "flac"])


@query(
    "s09_quarantine",
    f"""WITH {EV}, x AS (SELECT entity, CASE WHEN event_type = 'error' AND value < 10 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS txt FROM ev),
    y AS (SELECT entity, TRY_CAST(txt AS DOUBLE) AS v FROM x),
    z AS (SELECT entity, CASE WHEN v IS NULL THEN 'not_a_number' WHEN v > 300 THEN 'out_of_range' END AS reason FROM y)
    SELECT entity, count(*) AS n_rows, count(reason) AS n_rejected, {R('count(reason)/count(*)')} AS share,
      count(reason)/count(*) > 0.05 AS warn FROM z GROUP BY entity""",
)
def quarantine(t):
    bad = (F.col("event_type") == "error") & (F.col("value") < 10)
    d = t.ev.withColumn("txt", F.when(bad, F.lit("n/a")).otherwise(F.col("value").cast("string")))
    d = d.withColumn("v", F.col("txt").try_cast("double"))
    rules = {"not_a_number": F.col("v").isNull(), "out_of_range": F.col("v") > 300}
    return io.reject_share(d, rules, ["entity"]).withColumn("share", rnd("share"))


@query(
    "s09_two_sinks",
    f"""WITH {EV}, x AS (SELECT event_id, CASE WHEN event_type = 'error' AND value < 10 THEN NULL ELSE value END AS v FROM ev),
    z AS (SELECT event_id, v, CASE WHEN v IS NULL THEN 'not_a_number' WHEN v > 300 THEN 'out_of_range' END AS reason FROM x)
    SELECT event_id, CASE WHEN reason IS NULL THEN 'good' ELSE 'reject' END AS sink, reason, {R('v')} AS v FROM z""",
)
def two_sinks(t):
    """Good rows and rejects with their reason are written to two tables; both are read back."""
    bad = (F.col("event_type") == "error") & (F.col("value") < 10)
    d = t.ev.select("event_id", F.when(bad, F.lit("n/a")).otherwise(F.col("value").cast("string")).try_cast("double").alias("v"))
    good, rejects = io.split_rejects(d, {"not_a_number": F.col("v").isNull(), "out_of_range": F.col("v") > 300})
    parts = []
    for name, part in (("good", good.withColumn("reason", F.lit(None).cast("string"))), ("reject", rejects)):
        path = scratch_path(t.spark, name)
        part.write.parquet(path)
        parts.append(t.spark.read.parquet(path).select("event_id", F.lit(name).alias("sink"), "reason", rnd("v").alias("v")))
    return parts[0].unionByName(parts[1])


DAILY_TEXT = """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'n.d.' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS date_text,
  CASE WHEN o_orderkey % 7 = 0 THEN '--' ELSE CAST(o_totalprice AS VARCHAR) END AS temp_text FROM orders"""


@query(
    "s10_messy_daily_readings",
    f"""WITH x AS ({DAILY_TEXT}) SELECT o_orderkey, CAST(try_strptime(date_text, '%d/%m/%Y') AS DATE) AS date, TRY_CAST(temp_text AS DOUBLE) AS temp
    FROM x WHERE try_strptime(date_text, '%d/%m/%Y') IS NOT NULL""",
)
def messy_readings(t):
    k = F.col("o_orderkey")
    text = t.orders.select(
        k,
        F.when(k % 11 == 0, F.lit("n.d.")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("date_text"),
        F.when(k % 7 == 0, F.lit("--")).otherwise(F.col("o_totalprice").cast("string")).alias("temp_text"),
    )
    path = scratch_path(t.spark, "sheet")
    io.write_csv(text, path)
    d = io.read_csv(t.spark, path, "o_orderkey bigint, date_text string, temp_text string")
    d = d.select(
        "o_orderkey",
        F.try_to_timestamp("date_text", F.lit("dd/MM/yyyy")).cast("date").alias("date"),
        F.col("temp_text").try_cast("double").alias("temp"),
    )
    return d.dropna(subset=["date"])
