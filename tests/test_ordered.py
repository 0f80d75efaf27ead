"""Ordered scans in one exchange against plain loops: hot keys, keys over many ranges and batches, NULLs, empty tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sensorgate.operators import align
from sensorgate.operators.ordered import Changes, Count, Last, Sum, ordered_scan, row_index

SCHEMA = "k int, s string, t long, v double, c string, at timestamp, _part int"


def rows_of(n, hot, seed):
    r = random.Random(seed)
    out = []
    for t in r.sample(range(5 * n), n):
        k = None if r.random() < 0.05 else 0 if r.random() < hot else r.randint(1, 6)
        v = None if r.random() < 0.4 else float(round(r.gauss(0, 2)))
        c = r.choice([None, "a", "a", "b"])
        out.append((k, "x" if k == 3 else None, t, v, c, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t) if v else None, 9))
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[2]))


def plain(rows, keys):
    """The same by a loop over the sorted rows: position, sum, last value, last time before, runs and falls."""
    out, key = [], object()
    for row in rows:
        now = tuple(row[i] for i in keys)
        if now != key:
            key, i, total, last, last_at, runs, previous, falls, fell = now, 0, 0.0, None, None, 0, object(), 0, None
        _, _, t, v, c, at, _ = row
        before = last_at
        total += v or 0.0
        last = v if v is not None else last
        last_at = at if at is not None else last_at
        runs += c != previous
        falls += v is not None and (fell is None or v < fell)
        previous, fell = c, v if v is not None else fell
        out.append((t, i, total, last, before, runs, falls))
        i += 1
    return sorted(out)


STEPS = [Count("i"), Sum("total", "v"), Last("last", "v"), Last("before", "at", inclusive=False), Changes("runs", "c", first=1), Changes("falls", "v", falls=True, first=1, skip_null=True)]


@pytest.mark.parametrize("hot", [0.0, 0.7, 1.0])
@pytest.mark.parametrize("batch", [3, 10_000])
def test_ordered_scan(spark, hot, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = rows_of(400, hot, batch)
        d = ordered_scan(spark.createDataFrame(rows, SCHEMA).drop("_part").repartition(3), ["k", "s"], ["t"], STEPS)
        got = sorted(tuple(r) for r in d.select("t", "i", "total", "last", "before", "runs", "falls").collect())
        assert got == plain(rows, (0, 1))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_key_and_no_rows(spark):
    rows = spark.createDataFrame(rows_of(300, 0.5, 1), SCHEMA).drop("_part")
    got = row_index(rows, [], ["t"], "i").select("t", "i").collect()
    assert [r.i for r in sorted(got)] == list(range(300))
    assert ordered_scan(rows.where("false"), ["k"], ["t"], STEPS).count() == 0
    assert ordered_scan(rows.limit(1), ["k"], ["t"], STEPS).select("i", "runs").collect()[0][:] == (0, 1)


def test_rows_of_a_hot_key_are_spread(spark):
    d = spark.range(40_000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    files = row_index(d, ["k"], ["t"], "i").groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 7 and max(r["count"] for r in files) < 12_000


def test_input_is_read_once(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows_of(300, 0.5, 2), SCHEMA).drop("_part").write.parquet(path)
    d = align.asof_within(spark.read.parquet(path), F.col("c") == "b", ["k"], "t", "v", "near", backfill=True)
    plan = d._jdf.queryExecution().toString()
    assert path not in plan


@pytest.mark.parametrize("backfill", [False, True])
def test_asof(spark, backfill):
    r = random.Random(4)
    left = [(r.choice([0, 0, 0, 1, 2]), r.randint(0, 200), n) for n in range(150)]
    right = [(r.choice([0, 0, 0, 1]), r.randint(20, 200), r.choice([None, 1.0, 2.0, 3.0])) for _ in range(80)]
    d = align.asof(spark.createDataFrame(left, "k int, t long, n int"), spark.createDataFrame(right, "k int, t long, v double"), ["k"], "t", "v", backfill)
    got = {x.n: x.v for x in d.collect()}
    for k, t, n in left:
        known = sorted((rt, v) for rk, rt, v in right if rk == k and v is not None)
        before = [v for rt, v in known if rt <= t]
        want = before[-1] if before else known[0][1] if backfill and known else None
        assert got[n] == want


def test_session_checks_counts_apart_only_where_needed(spark):
    """Distinct starts and creation times as plain sets, and no step that multiplies the rows for them."""
    from sensorgate.operators import timeseries

    r = random.Random(5)
    rows = [(r.choice([None, 1, 2]), r.randint(1, 30), i, r.random() < 0.8, r.choice([None, "a", "a", "b"]), r.choice([None, 10, 20, 30])) for i in range(300)]
    d = spark.createDataFrame(rows, "k int, run int, seq long, readable boolean, created string, sec int")
    d = d.withColumn("start", F.timestamp_seconds("sec")).drop("sec")
    got = timeseries.session_checks(d, ["k"], ["seq"], "run", "start", "created", "readable")
    plan = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "Expand" not in plan and "SortAggregate" not in plan
    want = {}
    for k, run, seq, ok, created, sec in rows:
        want.setdefault((k, run), []).append((seq, ok, created, None if sec is None or not ok else sec * 1_000_000))
    seen = 0
    for x in got.collect():
        own = want[x["k"], x["run"]]
        starts = [t for *_, t in own if t is not None]
        assert x["n_files"] == len(own) and x["unique_creation_time"] == len({c for _, ok, c, _ in own if ok and c})
        assert x["duplicates"] == (len(set(starts)) < len(starts))
        assert (x["session_start_us"], x["session_end_us"]) == ((starts[0], starts[-1]) if starts else (None, None))
        seen += 1
    assert seen == len(want)


@pytest.mark.parametrize("hot", [0.0, 0.7, 1.0])
@pytest.mark.parametrize("batch", [3, 10_000])
def test_first_known_value(spark, hot, batch):
    """A base known late in its key, over many ranges and batches."""
    from sensorgate.operators.ordered import First

    rows = [(k, s, t, v if t > 900 or t % 7 == 0 else None, at) for k, s, t, v, _, at, _ in rows_of(400, hot, batch + 1)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        d = ordered_scan(spark.createDataFrame(rows, "k int, s string, t long, v double, at timestamp").repartition(3), ["k", "s"], ["t"], [First("base", "v"), First("since", "at")])
        got = sorted((r.t, r.base, r.since) for r in d.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, seen = [], {}
    for k, s, t, v, at in rows:
        base, since = seen.get((k, s), (None, None))
        seen[k, s] = base, since = base if base is not None else v, since if since is not None else at
        want.append((t, base, since))
    assert got == sorted(want)


@pytest.mark.parametrize("hot", [0.0, 1.0])
def test_tasks_of_sessions_keep_their_size(spark, monkeypatch, hot):
    """Ranges and tasks of sums grow with the rows, and no session is dealt out whole that lies in several ranges."""
    from sensorgate.operators import ordered, timeseries

    monkeypatch.setattr(ordered, "RANGE_ROWS", 20, raising=False)
    r = random.Random(6)
    rows = [(0 if r.random() < hot else r.randint(1, 40), 1, i, True, "a", 60 * i) for i in range(600)]
    d = spark.createDataFrame(rows, "k int, run int, seq long, readable boolean, created string, sec int")
    d = d.withColumn("start", F.timestamp_seconds("sec")).drop("sec")
    scanned = ordered_scan(d, ["k", "run"], ["seq"], [Count("i")])
    assert len(scanned.inputFiles()) > 20
    assert max(x["count"] for x in scanned.groupBy(F.input_file_name()).count().collect()) <= 60
    dealt, real = [], type(d).repartition

    def repartition(frame, n, *columns):
        dealt.append((n, [x["n"] for x in frame.groupBy("k", "run").agg(F.count("*").alias("n")).collect()]))
        return real(frame, n, *columns)

    monkeypatch.setattr(type(d), "repartition", repartition)
    got = {x["k"]: (x["n_files"], x["session_start_us"], x["session_end_us"]) for x in timeseries.session_checks(d, ["k"], ["seq"], "run", "start", "created", "readable").collect()}
    (n, sizes), *_ = dealt
    assert n == 30 and max(sizes, default=0) <= 60
    own = {}
    for k, _, _, _, _, sec in rows:
        own.setdefault(k, []).append(sec * 1_000_000)
    assert got == {k: (len(v), v[0], v[-1]) for k, v in own.items()}


@pytest.mark.parametrize("hot", [0.0, 0.7, 1.0])
def test_midnight_rollover(spark, monkeypatch, hot):
    """Against a plain loop: the base may be known late in the key, or never."""
    from sensorgate.operators import ordered, timeseries

    monkeypatch.setattr(ordered, "RANGE_ROWS", 20, raising=False)
    r = random.Random(7)
    rows = [(0 if r.random() < hot else r.choice([None, 1, 2, 3]), i, r.choice([None, 100.0, 200.0, 300.0]), None if i < 250 or r.random() < 0.9 else dt.date(2024, 1, r.randint(1, 9))) for i in range(400)]
    d = spark.createDataFrame(rows + [(9, 0, 5.0, None)], "k int, seq long, tod double, created date")
    got = timeseries.midnight_rollover(d, ["k"], ["seq"], "tod", "created", "start", run="run")
    assert set(got.columns) == {"k", "seq", "tod", "created", "run", "start"}
    got = {(x.k, x.seq): x.us for x in got.select("k", "seq", F.unix_micros("start").alias("us")).collect()}
    base, day, before = {}, {}, {}
    for k, _, _, created in rows:
        if created is not None:
            base.setdefault(k, created)
    want = {(9, 0): None}
    for k, i, tod, _ in rows:
        if tod is not None:
            day[k] = day.get(k, 0) + (tod < before.get(k, tod))
            before[k] = tod
        want[k, i] = None if tod is None or k not in base else ((base[k] - dt.date(1970, 1, 1)).days + day[k]) * 86_400_000_000 + int(tod * 1e6)
    assert got == want
