import random

from pyspark.sql import functions as F

from tracewright.operators import compose, selection


def test_block_runs_against_a_walk(spark):
    r = random.Random(1)
    rows = [(f, i, r.random() < 0.2, r.random() < 0.6) for f in range(20) for i in range(60)]
    df = spark.createDataFrame(rows, "file int, idx int, seed boolean, cont boolean")
    want = set()
    for f, i, s, _ in rows:
        if s:
            want.add((f, i))
            j = i + 1
            while j < 60 and rows[f * 60 + j][3]:
                want.add((f, j))
                j += 1
    for chunk in (20, 33, 8192):
        got = {(x.file, x.idx) for x in selection.block_runs(df, F.col("seed"), F.col("cont"), "b", chunk).where("b").collect()}
        assert got == want, chunk


def _log(body):
    head = [f"[00:00:{i % 60:02d}] [main/INFO]: heartbeat {i}" for i in range(220)]
    tail = [f"[01:00:{i % 60:02d}] [main/INFO]: idle {i}" for i in range(220)]
    return head + body + tail


def _records(spark, lines):
    return selection.records(spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file string, idx int, text string"))


BODY = ["[00:10:00] [main/WARN]: Reloading resources", "[00:10:01] [main/INFO]: Stitching texture atlas x"] + ["[00:10:02] [main/INFO]: Loaded sprite y"] * 40 + [
    "[00:11:00] [main/ERROR]: boom", "java.lang.NoSuchMethodError: gone", "\tat a.b.C.d(C.java:1)", "Caused by: java.lang.IllegalStateException: x", "\tat e.f.G.h(G.java:2)"] + ["[00:12:00] [main/INFO]: quiet"] * 60


def test_selection_keeps_evidence_and_drops_noise(spark):
    recs = _records(spark, _log(BODY))
    rows = {r.raw: r for r in selection.select_lines(recs).collect()}
    assert rows["java.lang.NoSuchMethodError: gone"].selected and rows["\tat e.f.G.h(G.java:2)"].selected
    assert not rows["[00:10:02] [main/INFO]: Loaded sprite y"].selected and rows["java.lang.NoSuchMethodError: gone"].score >= 9
    out = compose.extract_c(recs).first()
    assert not out.over_budget and not out.fallback and "NoSuchMethodError" in out.extract and out.extract.startswith("[termination] type=无声中断")
    assert compose.T.GAP in out.extract


def test_budget_cascade(spark):
    recs = _records(spark, _log(BODY))
    for limit in (2600, 900, 400):
        out = compose.extract_c(recs, limit=limit).first()
        assert out.over_budget and len(out.extract) <= limit
        assert limit < 900 or "NoSuchMethodError" in out.extract
    full = compose.extract_c(recs).first().extract
    assert compose.extract_c(recs, limit=len(full)).first().extract == full


def test_native_fold_equals_plain_fold(spark):
    r = random.Random(2)
    rows = []
    for f in range(30):
        idx = sorted(r.sample(range(60), 40))
        rows += [(f, i, r.choice(["tail", "body"]), r.choice("ab"), r.choice("xy")) for i in idx]
    df = spark.createDataFrame(rows, "file int, idx int, mode string, key string, out string")
    want = {f: compose._fold([t[1:] for t in rows if t[0] == f]) for f in range(30)}
    for chunk in (1, 7, 8192):
        assert {x.file: x.body for x in compose.compose(compose.fold_groups(df, chunk)).collect()} == want, chunk


def test_endings_and_sections(spark):
    end = selection.termination(_records(spark, ["[00:00:00] [main/INFO]: java.lang.OutOfMemoryError: Java heap space", "x", ""])).first()
    assert end.category == "OOM" and end.last_line == "x"
    recs = _records(spark, ["a", "Description: d", "b", "Caused by: c", "System Details"])
    out = compose.sections_a(recs, "crash", 2).orderBy("section").collect()
    assert [(x.label, x.text) for x in out] == [("header/description", "[header/description]\nDescription: d\nb"), ("caused by chain", "[caused by chain]\nCaused by: c\nSystem Details"), ("system details", "[system details]\nSystem Details")]
    assert compose.extract_c(recs.limit(0)).count() == 0


def test_must_keep_budget(spark):
    df = spark.createDataFrame([("b" * 100, "m" * 20), ("b" * 10, None)], "base string, must string")
    a, b = (r[0] for r in df.select(compose.with_must_keep(F.col("base"), F.col("must"), 120)).collect())
    assert len(a) <= 120 and a.startswith("【MustKeep Evidence】") and b == "b" * 10


def test_chunks_make_no_difference(spark):
    recs = _records(spark, _log(BODY)).cache()
    want = None
    for chunk in (37, 8192):
        d = selection.select_lines(recs, chunk=chunk)
        got = [tuple(r) for r in d.select("idx", "s_score", "s_must", "s_priority", "s_noise", "s_focus", "p_keep", "p_anchor", "n_lines", "key_hits", "fallback", "selected").orderBy("idx").collect()]
        want = want or got
        assert got == want, chunk
    near = lambda c: [r.near_error for r in selection.error_windows(recs, 8, 3, chunk=c).orderBy("idx").collect()]
    assert near(20) == near(8192) and sum(near(20)) > 8
