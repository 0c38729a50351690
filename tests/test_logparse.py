from tracewright.operators.logparse import canonical_level, log_entries, mine_templates, text_lines
from pyspark.sql import functions as F

LOG = [
    "lost beginning",
    "[10:00:00] [main/INFO]: one",
    "\tat a.b.C.d(C.java:1)",
    "> [10:00:00] [main/ERROR]: quoted",
    "  [11:19] file rewritten",
    "Apr 09, 2025 11:27:47 PM io.x.Y render",
    "WARNING: two",
    "mc-a-1  | [10:00:01 ERROR]: [Mod] three",
    "mc-a-1  | detail",
    "\x1b[31m[10:00:02] [IO-Worker-1/FATAL]\x1b[0m: four",
    '{"@t": "2025-01-01T00:00:00.1Z", "lvl": "Trace", "logger": "l", "thread": "t", "msg": "five"}',
    "1748812327370|WARN|main|a.B|six",
    "02-02 00:05:44.652  8806  8042 V Tag: seven",
    "2025-01-11 17:56:00,260 DEBUG [Worker] a.B - eight",
    "time=2025-01-01T00:00:00Z level=fatal component=a.B msg=\"nine\"",
    "[12:00:00] [Core] [CRIT] [a.py:1]: ten",
    "[11Mar2025 01:17:35.207] [main/INFO] [a.B/CORE]: eleven",
    "Mar  1 08:09:50 node-a mc[1]: Loaded twelve",
    "Mar  1 08:09:50 node-a mc[1]: <warn> thirteen",
    "[82026.489s][warning][gc] fourteen",
]
WANT = [(1, 4, "INFO"), (5, 6, "WARN"), (7, 8, "ERROR"), (9, 9, "FATAL"), (10, 10, "TRACE"), (11, 11, "WARN"), (12, 12, "TRACE"), (13, 13, "DEBUG"), (14, 14, "FATAL"), (15, 15, "FATAL"), (16, 16, "INFO"), (17, 17, ""), (18, 18, "WARN"), (19, 19, "WARN")]


def _df(spark, rows):
    return spark.createDataFrame(rows, "log_id long, line_idx int, raw string, head string, start int, message string")


def test_layouts_and_chunks(spark):
    rows = [(1, i, t, "x", 0, "y") for i, t in enumerate(LOG)] + [(1, 3, LOG[3], "x", 0, "y")]
    df = _df(spark, rows)
    for chunk in (2, 3, 1000):
        for mined in (None, mine_templates(df, "raw", 0.01)):
            out = log_entries(df, "log_id", "line_idx", "raw", mined, chunk).orderBy("first_line").collect()
            assert [(r.first_line, r.last_line, r.severity) for r in out] == WANT
    first, second, third = out[0], out[1], out[2]
    assert first.thread == "main" and first.message.startswith("one\n\tat a.b") and first.timestamp == "10:00:00"
    assert second.message == "two" and second.component == "io.x.Y" and third.component == "Mod"


def test_mining_finds_prefixes_and_layouts(spark):
    df = _df(spark, [(1, i, f"mc-a-1  | [10:00:{i:02d}] [main/INFO]: x", "", 0, "") for i in range(40)])
    m = mine_templates(df, "raw", 0.05)
    assert m.prefixes and dict(m.layouts).get("clock_thread_level") == 40


def test_mined_headers_of_unknown_programs(spark):
    a = [f"2025/01/02 10:00:{i:02d} <{'WARN' if i % 3 else 'INFO'}> {{worker-{i}}} net.io :: message {chr(97 + i)}" for i in range(20)]
    b = [f"(10:00:{i:02d}.5) [ERROR] [a.B] - other {chr(97 + i)}" for i in range(20)]
    df = _df(spark, [(1, i, t, "", 0, "") for i, t in enumerate([*a, *b, "\tat a.b.C.d(C.java:1)", "2025/01/03 00:00:00 <FATAL> {x} net.io :: late"])])
    out = log_entries(df, "log_id", "line_idx", "raw", mine_templates(df, "raw", 0.1)).orderBy("first_line").collect()
    assert len(out) == 41 and out[39].last_line == 40 and not log_entries(df, "log_id", "line_idx", "raw").count()
    x, y, z = out[1], out[21], out[40]
    assert (x.severity, x.timestamp, x.thread, x.component, x.message) == ("WARN", "2025/01/02 10:00:01", "worker-1", "net.io", "message b")
    assert (y.severity, y.timestamp, y.component, y.message) == ("ERROR", "10:00:01.5", "a.B", "other b") and (z.severity, z.message) == ("FATAL", "late")


def test_nulls_empty_long(spark):
    df = _df(spark, [(None, 0, LOG[1], "", 0, ""), (2, None, LOG[1], "", 0, ""), (3, 0, None, None, None, None), (3, 1, "", "", 0, ""), (4, 0, LOG[1] + "x" * 200_000, "", 0, ""), (5, 0, LOG[5], "", 0, "")])
    out = {r.log: r for r in log_entries(df, "log_id", "line_idx", "raw").collect()}
    assert set(out) == {4, 5} and len(out[4].message) > 200_000 and out[5].severity == ""
    assert log_entries(df.limit(0), "log_id", "line_idx", "raw", mine_templates(df.limit(0), "raw")).count() == 0


def test_text_lines(spark):
    df = spark.createDataFrame([(1, "a\r\nb\n"), (1, "a\r\nb\n"), (2, None), (3, ""), (4, "\n\nx")], "case_id long, text string")
    out = sorted((r.case_id, r.line_idx, r.raw) for r in text_lines(df, "case_id", "text").collect())
    assert out == [(1, 0, "a"), (1, 1, "b"), (4, 0, ""), (4, 1, ""), (4, 2, "x")]


def test_levels(spark):
    df = spark.createDataFrame([("verbose",), ("FINER",), ("FINE",), ("severe",), ("Crit",), (None,), ("hello",)], "w string")
    assert [r[0] for r in df.select(canonical_level(F.col("w"))).collect()] == ["TRACE", "TRACE", "DEBUG", "ERROR", "FATAL", "", ""]
