import datetime as dt
import random

from corpuskit.streaming import folds as T

T0 = dt.datetime(2024, 1, 1)


def _events(spark, n=400, users=5, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((rnd.randrange(users), T0 + dt.timedelta(seconds=rnd.randrange(0, 4000)), i))
    return rows, spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long")


def python_sliding_log(events, limit: int, window_us: int):
    """Reference-style sequential simulation, for tests on small fixtures."""
    logs, out = {}, {}
    for key, t, seq in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        log = [x for x in logs.get(key, []) if x > t - window_us]
        ok = len(log) < limit
        if ok:
            log.append(t)
        logs[key] = log
        out[(key, seq)] = ok
    return out


def _us(t):
    return int((t - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def test_sliding_log_matches_sequential(spark):
    rows, df = _events(spark)
    got = {(int(r.key), r.seq): r.allowed for r in T.sliding_log_limit(df, "user_id", "ts", "event_id", 3, 600).collect()}
    exp = python_sliding_log([(u, _us(t), s) for u, t, s in rows], 3, 600 * 1_000_000)
    assert got == exp


def test_multi_limit_matches_sequential(spark):
    rows, df = _events(spark, seed=2)
    rules = [("a", 2, 60.0), ("b", 5, 900.0)]
    got = {(int(r.key), r.seq): r.failing_category for r in T.multi_limit(df, "user_id", "ts", "event_id", rules).collect()}
    logs, exp = {}, {}
    for u, t, s in sorted(rows, key=lambda e: (e[0], e[1], e[2])):
        now, bad = _us(t), None
        for cat, lim, win in rules:
            log = [x for x in logs.get((u, cat), []) if x > now - win * 1_000_000]
            if len(log) < lim:
                log.append(now)
                logs[(u, cat)] = log
            else:
                logs[(u, cat)] = log
                bad = cat
                break
        exp[(u, s)] = bad
    assert got == exp


def test_anchored_quota(spark):
    rows = [(1, T0, 0), (1, T0 + dt.timedelta(seconds=10), 1), (1, T0 + dt.timedelta(seconds=61), 2),
            (1, T0 + dt.timedelta(seconds=62), 3), (1, T0 + dt.timedelta(seconds=200), 4)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long")
    r = {x.seq: (x.allowed, x.reason) for x in T.anchored_quota(df, "user_id", "ts", "event_id", 1, 3).collect()}
    # minute window anchors at 0; 10s denied; 61s opens a new minute; 62s denied; 200s denied by the day quota? no: 2 used
    assert r == {0: (True, None), 1: (False, "per_minute"), 2: (True, None), 3: (False, "per_minute"), 4: (True, None)}
    r2 = {x.seq: x.reason for x in T.anchored_quota(df, "user_id", "ts", "event_id", 5, 2).collect()}
    assert r2[2] == "per_day" and r2[4] == "per_day"


def _landed(spark, df, path, files, jitter_s):
    """``df`` in ``files`` files, each out of order by up to ``jitter_s``; then a row without key that
    moves the watermark past all."""
    import random
    rows = df.collect()
    r = random.Random(1)
    moved = sorted(rows, key=lambda x: x.ts + dt.timedelta(seconds=r.random() * jitter_s))
    size = -(-len(moved) // files)
    for i in range(files):
        part = moved[i * size:(i + 1) * size]
        r.shuffle(part)
        if part:
            spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
    last = max(x.ts for x in rows) + dt.timedelta(days=30)
    spark.createDataFrame([tuple(last if c == "ts" else None for c in df.columns)], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streaming_limiter_equals_batch(spark, tmp_path):
    """However the events fall into micro-batches, while they arrive within the watermark."""
    from corpuskit.streaming import stream as S
    rows, df = _events(spark, n=200, seed=4)
    batch = {(int(r.key), r.seq): r.allowed for r in T.sliding_log_limit(df, "user_id", "ts", "event_id", 2, 300).collect()}
    for files in (1, 5):
        st = _landed(spark, df, str(tmp_path / f"ev{files}"), files, 3600)
        out = S.run_to_table(S.streaming_sliding_log(st, "user_id", "ts", "event_id", 2, 300, "2 hours"), name="t")
        got = {(int(r.key), r.seq): r.allowed for r in out.filter("key is not null").collect()}
        assert got == batch


def test_streaming_quota_equals_batch(spark, tmp_path):
    from corpuskit.streaming import stream as S
    rows, df = _events(spark, n=300, seed=9)
    st = _landed(spark, df, str(tmp_path / "ev"), 5, 3600)
    out = S.run_to_table(S.streaming_anchored_quota(st, "user_id", "ts", "event_id", 2, 7, "2 hours"), name="q")
    got = {(int(r.key), r.seq): (r.allowed, r.reason) for r in out.filter("key is not null").collect()}
    batch = {(int(r.key), r.seq): (r.allowed, r.reason)
             for r in T.anchored_quota(df, "user_id", "ts", "event_id", 2, 7).collect()}
    assert got == batch


def test_stream_steps_equal_batch_folds():
    """The steps of the stream against the definition, event by event."""
    import random
    from corpuskit.streaming import stream as S
    r = random.Random(2)
    times = sorted(r.randrange(0, 3 * 86400) * 1_000_000 for _ in range(400))
    m, log = S.SlidingLog([], 3, 600_000_000), []
    for t in times:
        live = [x for x in log if x > t - 600_000_000]
        m = S.SlidingLog(m.memo(), 3, 600_000_000)  # as read back from the state
        assert m.step(t)[0] == (len(live) < 3)
        log = live + [t] * (len(live) < 3)
    q, minute, day = S.AnchoredQuota([], 2, 40), None, None
    for t in times:
        q = S.AnchoredQuota(q.memo(), 2, 40)
        why = ("per_minute" if minute and t - minute[0] < 60_000_000 and minute[1] >= 2 else
               "per_day" if day and t - day[0] < 86_400_000_000 and day[1] >= 40 else None)
        assert q.step(t)[:2] == (why is None, why)
        if why is None:
            minute = (t, 1) if not minute or t - minute[0] >= 60_000_000 else (minute[0], minute[1] + 1)
            day = (t, 1) if not day or t - day[0] >= 86_400_000_000 else (day[0], day[1] + 1)


def test_streaming_multi_limit_equals_batch(spark, tmp_path):
    from corpuskit.streaming import stream as S
    rows, df = _events(spark, n=300, seed=6)
    rules = [("a", 2, 60.0), ("b", 5, 900.0)]
    batch = {(int(r.key), r.seq): r.failing_category for r in T.multi_limit(df, "user_id", "ts", "event_id", rules).collect()}
    for files in (1, 5):
        st = _landed(spark, df, str(tmp_path / f"ev{files}"), files, 3600)
        out = S.run_to_table(S.streaming_multi_limit(st, "user_id", "ts", "event_id", rules, "2 hours"), name="m", settings=S.ROCKSDB)
        got = [((int(r.key), r.seq), r.failing_category) for r in out.filter("key is not null").collect()]
        assert dict(got) == batch and len(got) == len(batch)


# ------------------------------------------------------------------ segments

def _bursts(spark, n=900, seed=3):
    """One key with a third of the rows and pauses of all lengths, exactly the window's among them."""
    r, rows, t = random.Random(seed), [], 0
    for i in range(n):
        t += r.choice([0, 1, 5, 30, 59, 60, 61, 599, 600, 601, 4000])
        rows.append((None if i % 9 == 8 else 0 if i % 3 == 0 else r.randrange(1, 6), T0 + dt.timedelta(seconds=t), i))
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long").repartition(4)


def test_segments_fold_like_the_whole_key(spark):
    rows, df = _bursts(spark)
    events = [(-1 if u is None else u, _us(t), s) for u, t, s in rows]
    for limit, window in ((1, 600), (3, 600), (2, 60)):
        got = {(-1 if r.key in ("None", None) else int(r.key), r.seq): r.allowed
               for r in T.sliding_log_limit(df, "user_id", "ts", "event_id", limit, window).collect()}
        assert got == python_sliding_log(events, limit, window * 1_000_000)


def test_quota_and_several_limits_over_segments(spark, monkeypatch):
    rows, df = _bursts(spark, seed=5)
    for call in (lambda: T.multi_limit(df, "user_id", "ts", "event_id", [("a", 2, 60.0), ("b", 3, 600.0)]),
                 lambda: T.anchored_quota(df, "user_id", "ts", "event_id", 1, 40)):
        cut = sorted(map(str, call().collect()))
        with monkeypatch.context() as m:  # the whole timeline of a key as one segment
            m.setattr(T, "segments", lambda d, pause: d.withColumn("segment", T.F.lit(0).cast("long")))
            assert sorted(map(str, call().collect())) == cut


def test_hot_key_is_dealt(spark):
    rows, df = _bursts(spark)
    d = T._prep(df, "user_id", "ts", "event_id", 8, 600 * 1_000_000)
    hot = d.filter("key = '0'").withColumn("p", T.F.spark_partition_id()).groupBy("p").count().collect()
    times = sorted(_us(t) for u, t, _ in rows if u == 0)
    pauses = sum(b - a >= 600 * 1_000_000 for a, b in zip(times, times[1:]))
    assert d.filter("key = '0'").select("segment").distinct().count() == pauses + 1 > 20
    assert len(hot) >= 6 and max(r["count"] for r in hot) < len(times) / 2


def test_variant_moments_of_large_latencies(spark):
    """A spread of 1 around 10^9: squares would cancel."""
    import statistics

    from corpuskit.streaming import stream as S
    r = random.Random(2)
    rows = [("e", v, True, 1e9 + (v == "b") + r.gauss(0, 1)) for v in "ab" for _ in range(200)]
    d = spark.createDataFrame(rows, "experiment_id string, variant_id string, success boolean, latency_ms double").repartition(8)
    m = S.variant_moments_stream(d)
    for x in m.collect():
        own = [row[3] for row in rows if row[1] == x.variant_id]
        assert abs(x["var"] - statistics.variance(own)) < 1e-3 and abs(x["mean"] - statistics.mean(own)) < 1e-6
    v = spark.createDataFrame([("e", "a", True), ("e", "b", False)], "experiment_id string, variant_id string, is_control boolean")
    assert S.auto_stop_status(m, v, 100).first().status == "stopped" and S.auto_stop_status(m, v, 500).first().status == "running"


def test_streams_over_a_table_of_several_files(spark, tmp_path, monkeypatch):
    """Landings have several files; a micro-batch takes whole landings, or the watermark passes rows of the rest."""
    from corpuskit.plans import limits as L
    from corpuskit.streaming import stream as S
    r = random.Random(8)
    rows = [(i, T0 + dt.timedelta(seconds=r.randrange(30 * 86400)), r.randrange(40)) for i in range(4000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").repartition(8).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(L, "FILE_ROWS", 100, raising=False)
    batches, run = [], S.run_to_table

    def counted(stream, *a, **k):
        out = run(stream, *a, **k)
        batches.append(stream.sparkSession.read.parquet(out.inputFiles()[0].split("/_batch=")[0]).select("_batch").distinct().count())
        return out

    monkeypatch.setattr(S, "run_to_table", counted)
    for stream, batch in ((L.stream_rate_limit_decisions, L.rate_limit_decisions), (L.stream_tenant_quota_decisions, L.tenant_quota_decisions),
                          (L.stream_multi_limit_decisions, L.multi_limit_decisions)):
        got, own = (sorted(map(str, f(spark, str(tmp_path)).collect())) for f in (stream, batch))
        assert got == own and len(got) == len(rows)
    assert max(batches) <= 8


def test_keys_share_a_call(spark, tmp_path, monkeypatch):
    """Many keys in a few groups, NULL among them, decide as alone; the calls do not grow with the keys."""
    from corpuskit.streaming import stream as S
    r = random.Random(3)
    rows = [(None if i % 50 == 0 else r.randrange(200), T0 + dt.timedelta(seconds=r.randrange(40_000)), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long")
    st = _landed(spark, df, str(tmp_path / "ev"), 4, 3600)
    out = S._settled(st, "user_id", "ts", "event_id", "2 hours", "key string, seq long, t_us long, allowed boolean, remaining int, current int",
                     lambda memo: S.SlidingLog(memo, 2, 900_000_000), groups=3)
    got = {(-1 if x.key is None else int(x.key), x.seq): x.allowed for x in S.run_to_table(out, name="g").filter("seq >= 0").collect()}
    assert got == python_sliding_log([(-1 if u is None else u, _us(t), s) for u, t, s in rows], 2, 900_000_000)
