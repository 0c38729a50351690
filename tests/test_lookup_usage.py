import random

from pyspark.sql import functions as F

from tracewright.operators import evaluate, lookup, usage


def test_greedy_dedupe(spark):
    items = [("q", 0, 0, "A", "u1", "t1"), ("q", 0, 1, "A", "u2", "t2"), ("q", 1, 0, "B", "u1", "t9"), ("q", 1, 1, "B", "u5", "t2"), ("q", 2, 0, "C", "u5", "t9"), ("q", 2, 1, "C", "u1", "")]
    df = spark.createDataFrame(items, "query_id string, source_rank int, pos int, source string, url_key string, title_key string")
    out = {(r.source, r.pos): r.also_seen_in for r in lookup.greedy_dedupe(df).collect()}
    # The dropped items of B register no keys, so the first of C is kept.
    assert out == {("A", 0): ["B", "C"], ("A", 1): ["B"], ("C", 0): []}


def test_paths(spark):
    f = spark.createDataFrame([("z", "a/x.log"), ("z", "b/X.log"), ("z", "c/y.log"), ("z", "d/e/w.txt")], "archive string, path string")
    r = spark.createDataFrame([("z", "a/x.log"), ("z", "A/X.LOG"), ("z", "x.log"), ("z", "Y.log"), ("z", "no")], "archive string, requested string")
    out = {x.requested: (x.path, x.status) for x in lookup.resolve_paths(r, f).collect()}
    assert out == {"a/x.log": ("a/x.log", "found"), "A/X.LOG": ("a/x.log", "found"), "x.log": (None, "ambiguous"), "Y.log": ("c/y.log", "found"), "no": (None, "missing")}


def test_rate_limit_is_greedy(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["a", "b", "", None]), float(r.randint(0, 40))) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, u string, t double")
    got = {x.id: x.accepted for x in usage.accept_rate(df.select("t", "id", "u"), "u", "t", 5).collect()}
    last: dict = {}
    want = {}
    for i, u, t in sorted(rows, key=lambda x: (x[2], x[0])):
        ok = not u or u not in last or t - last[u] >= 5
        want[i] = ok
        if ok and u:
            last[u] = t
    assert got == want


def test_usage(spark):
    now = 1_000_000_000.0
    rows = [(now, "u", "s", 1, 2, ""), (now - 7 * 3600, "u", "s", 10, 0, ""), (now - 40 * 86400, "v", "", 100, None, ""), (None, "", None, 1, 1, "")]
    df = spark.createDataFrame(rows, "ts double, uid string, session_id string, input bigint, output bigint, source string")
    t = usage.usage_totals(df, now).first()
    assert (t.total_input, t.month_input, t.six_hour_input, t.six_hour_output, t.record_count) == (112, 11, 1, 2, 4)
    assert [(x.uid, x["sum"]) for x in usage.usage_by(df, "uid").collect()] == [("v", 100), ("u", 13)]
    assert usage.retained(df, now).count() == 3
    e = usage.live_entries(df.where("ts is not null"), "uid", "ts", now, 86400, 1)
    assert [(x.uid, x.input) for x in e.collect()] == [("u", 1)]


def test_sessions(spark):
    e = spark.createDataFrame([(1, ["a"]), (2, ["b", "c"]), (3, None)], "id int, c array<string>")
    s = spark.createDataFrame([("c",)], "session string")
    ids = lambda mode, x: sorted(r.id for r in usage.filter_sessions(e, "c", x, mode).collect())
    assert ids("blacklist", s) == [1, 3] and ids("whitelist", s) == [2] and ids("whitelist", s.limit(0)) == [1, 2, 3]


def test_newer_and_priority(spark):
    o = spark.createDataFrame([("p", i, f"2024-01-0{i}") for i in range(1, 8)], "k string, id int, at string")
    a = spark.createDataFrame([("p", 3, "2024-01-03")], "k string, id int, at string")
    assert [r.id for r in lookup.newer_than(o, a, "k", "at", "id", 2).orderBy("rank").collect()] == [7, 6]
    f = spark.createDataFrame([("z", "latest.log", 200, 0), ("z", "crash-1.log", 20, 1), ("z", "other.txt", 9, 2)], "archive string, name string, chars int, ord int")
    assert lookup.priority_file(f).first().name == "crash-1.log"


def test_evaluation(spark):
    c = spark.createDataFrame([("n", "fabric", "k", "Foo\nBar", ["^bar$"], [], ["FOO"], ["zzz"], None), ("m", None, "k", "x", ["y"], ["x"], [], ["x"], [])],
                              "name string, loader string, kind string, text string, gold_root_regexes array<string>, gold_support_regexes array<string>, culprit_ids array<string>, forbidden_noise_regexes array<string>, gold_signature_regexes array<string>")
    r = evaluate.evaluate(c, F.col("text"))
    assert [x.success for x in r.orderBy("name", ascending=False).collect()] == [True, False]
    s = {(x.scope, x.value): x.success_rate for x in evaluate.summarize(r).collect()}
    assert s[("all", None)] == 0.5 and s[("loader", "fabric")] == 1.0 and s[("kind", "k")] == 0.5
