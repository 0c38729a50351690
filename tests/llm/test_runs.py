import random

from pyspark.sql import functions as F

from tracewright.llm import runs

SAME = [
    ("Lost connection to proxy, retry 24", "LOST CONNECTION TO PROXY, RETRY 73"), ("Saving players", "Saving playres"), ("Saving players.", "saving\tplayers ..."), ("Reading region at 1, -2, 3", "Reading region at 9, 1…"),
    ("Duplicate UUID 5f65f43d-7b7b-4f49-ab0c-66685deaaff4 found", "Duplicate UUID 0065f43d-7b7b-4f49-ab0c-66685deaaff4 found"), ("Key 0x81d8 took 26ms", "Key 0xaf took 3ms"), ("Retrying with session 674cb0c1-0c0f-4870-ab12-f68a1237e66c", "Retrying with session 674cb0c1-0c…"),
    ("Watchdog pinged after 12.11 s", "Watchdog pinged after 29..."),
]
OTHER = [
    ("Reading region at 1, 2, 3", "Writing region at 1, 2, 3"), ("X spawned near 1, 2, 3", "X despawned near 1, 2, 3"), ("oddlantern moved", "oddyak moved"), ("LuckyCactus2 moved too quickly", "LuckyCactus3 moved too quickly"),
    ("Failed to load tag a:b/c", "Failed to load recipe a:b/c"), ("Missing texture a:b/c", "Missing texture a:b/d"), ("Suppressed java.lang.NoSuchFieldError in a.b", "Suppressed java.lang.NoSuchMethodError in a.b"), ("RustyYak moved", "rustyyak moved"),
]


def test_same_happening():
    for a, b in SAME:
        assert runs.same_happening(a, b) and runs.same_happening(b, a), (a, b)
    for a, b in OTHER:
        assert not runs.same_happening(a, b) and not runs.same_happening(b, a), (a, b)


def _events(n=300, seed=1):
    r, out, t = random.Random(seed), [], "Saving players"
    for i in range(n):
        if r.random() < 0.4:
            t = r.choice(["Saving players", "Server tick took {} ms", "Lost {} packets", "neonyak left"])
        out.append((7, i, t.format(r.randint(1, 99)), i * 1.0, "clash", 1))
    return out


SCHEMA = "log_id long, line_idx int, normalized string, s double, first string, text int"


def test_chunks_make_no_difference_and_brute_force(spark):
    rows = _events()
    df = spark.createDataFrame(rows + rows[5:9], SCHEMA).withColumn("ts", F.timestamp_seconds("s"))
    starts = runs.run_starts([x[2] for x in rows]) + [len(rows)]
    want = [(a, b - 1, b - a, float(b - 1 - a)) for a, b in zip(starts, starts[1:])]
    for chunk in (3, 7, 20_000):
        out = runs.collapse_runs(df, "log_id", "line_idx", "line_idx", "normalized", "ts", "ts", chunk=chunk).orderBy("first_idx").collect()
        assert [(r.first_idx, r.last_idx, r["count"], r.duration_s) for r in out] == want


def test_groups_prefix_note_and_counts(spark):
    rows = [(1, 0, 2, "[WARN]: Thread pool has 28 stuck jobs (重复 3 次)", 3), (1, 3, 3, "[08:52:59/WARN]: Thread pool has 34 stuck jobs", None), (1, 6, 6, "[WARN]: THREAD POOL HAS 1 STUCK JOBS (连续重复 2 次)", 0), (1, 9, 9, "[INFO]: Saving players", 1), (1, 9, 9, "[INFO]: Saving players", 1), (None, 1, 1, "x", 1), (2, 0, 0, None, None)]
    df = spark.createDataFrame(rows, "log_id long, start_idx int, end_idx int, text string, n int").withColumn("t", F.lit(None).cast("timestamp"))
    out = runs.collapse_runs(df, "log_id", "start_idx", "end_idx", "text", "t", "t", F.col("n"), grouped=True).orderBy("log", "first_idx").collect()
    assert [(r.log, r.first_idx, r.last_idx, r.events, r["count"], r.duration_s) for r in out] == [(1, 0, 6, 3, 5, None), (1, 9, 9, 1, 1, None), (2, 0, 0, 1, 1, None)]
    assert runs.collapse_runs(df.limit(0), "log_id", "start_idx", "end_idx", "text", "t", "t").count() == 0


def _near_equal(r: random.Random) -> str:
    t = r.choice(["failed player loading joined failed", "failed player", "failed player loading", "player joined", "faileed player loading joined", "Failed player loading joined {}", "other thing happened", "other", "{} failed", "failed"]).format(r.randint(1, 99))
    if r.random() < 0.3:
        k = r.randrange(len(t))
        t = t[:k] + r.choice(["", t[k] * 2]) + t[k + 1 :]
    return r.choice([t, t, t + "...", t.upper(), t[: r.randint(3, len(t))] + "...", t + "."])


def test_chunks_make_no_difference_to_near_equal_messages(spark):
    """3000 random sequences of near-equal messages: all sizes of chunks give the runs of the plain rule."""
    r = random.Random(11)
    sequences = [[_near_equal(r) for _ in range(r.randint(1, 14))] for _ in range(3000)]
    df = spark.createDataFrame([(k, i, t) for k, q in enumerate(sequences) for i, t in enumerate(q)], "log_id long, line_idx int, normalized string").withColumn("ts", F.lit(None).cast("timestamp")).cache()
    want = {(k, i) for k, q in enumerate(sequences) for i in runs.run_starts(q)}
    for chunk in (3, 4, 7, 20_000):
        got = {(x.log, x.first_idx) for x in runs.collapse_runs(df, "log_id", "line_idx", "line_idx", "normalized", "ts", "ts", chunk=chunk).collect()}
        assert got == want, (chunk, sorted(got ^ want)[:5])


def test_native_masks_are_those_of_the_plain_rule(spark):
    r = random.Random(3)
    pieces = ["Tick", " took ", "12ms", "-3.5", "0xAF", "x12", "12x", "10:11:12", "2025-01-02 03:04", "5f65f43d-7b7b-4f49-ab0c-66685deaaff4", "...", "…", " ", "\t", "\u00a0", ",", "!", "ÄÖ", "ß", "мир", "(", ")", ":", "1,2", "a.b.C", "%", "9%", "٣"]
    texts = [t for p in (*SAME, *OTHER) for t in p] + ["".join(r.choice(pieces) for _ in range(r.randint(0, 9))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[c.alias(k) for k, c in runs.masked_columns(F.col("t")).items()]).collect()
    assert [(x.t, runs.mask(x.t), (x.masked, x.caps, x.cut)) for x in rows if runs.mask(x.t) != (x.masked, x.caps, x.cut)] == []


def test_certain_boundaries_are_boundaries_whatever_came_before():
    r = random.Random(7)
    for _ in range(20_000):
        rep, a, b = (runs.mask(_near_equal(r)) for _ in range(3))
        if runs.certain_boundary(a, b) and runs.same_masked(rep, a):
            rep = a if runs._fuller(a, rep) else rep
            assert not runs.same_masked(rep, b), (rep, a, b)


def test_long_runs_over_many_chunks_and_batches(spark):
    n = 30_000
    df = spark.range(n).selectExpr("1L log_id", "id line_idx", "concat('Server tick took ', id, ' ms') normalized", "timestamp_seconds(id) ts")
    out = runs.collapse_runs(df, "log_id", "line_idx", "line_idx", "normalized", "ts", "ts", chunk=700).collect()
    assert [(x.first_idx, x.last_idx, x.events, x.duration_s) for x in out] == [(0, n - 1, n, float(n - 1))]
