import gzip
import zipfile

from pyspark.sql import functions as F

from tracewright.functions import report
from tracewright.operators import usage
from tracewright.sources import files
from tracewright.streaming.state import accept_rate_stream


def test_decoding(spark):
    text = "[12:00:00] [main/INFO]: 游戏崩溃 ok"
    df = spark.createDataFrame([(k, bytearray(text.encode(k))) for k in ("utf-8", "gb18030", "utf-16", "utf-16-le", "utf-8-sig")] + [("bad", bytearray(b"\xff\xff\xff\xff")), ("null", None)], "k string, content binary")
    out = {r.k: r.d for r in df.select("k", files.decode(F.col("content")).alias("d")).collect()}
    assert all(out[k].text == text for k in ("utf-8", "gb18030", "utf-16", "utf-16-le", "utf-8-sig"))
    assert out["utf-16-le"].utf16_hint and out["utf-8-sig"].bom == "utf-8" and out["bad"].used_replace and out["null"].char_count == 0


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "log.zip", "w") as z:
        for n in ("../evil.log", "/abs.log", "C:/x.log", "a/../b.log", "good/latest.log", "dir/"):
            z.writestr(n, "hello")
    (tmp_path / "server.log.gz").write_bytes(gzip.compress(b"zipped"))
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    out = files.expand_archives(files.read_files(spark, str(tmp_path))).collect()
    assert {(r.member, bytes(r.content)) for r in out if not r.error} == {("good/latest.log", b"hello"), ("server.log", b"zipped")}
    assert [r.error for r in out if r.error] == ["BadZipFile"]


def test_routing_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("m", 0, "x.png"), ("m", 1, "Crash.ZIP"), ("m", 2, "latest.log"), ("n", 0, "a.txt")], "msg string, pos int, name string")
    assert [(r.msg, r.name, r.route) for r in files.pick_file(df, "msg", "name", "pos").collect()] == [("m", "Crash.ZIP", "archive")]
    files.write_metrics(spark.createDataFrame([("mail a@b.cd", 1)], "t string, n int"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().t == "mail <EMAIL>"
    rec = spark.createDataFrame([(1.7e9, "u", "s", 1, 2, "x")], "ts double, uid string, session_id string, input bigint, output bigint, source string")
    files.write_usage(rec, str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "u")).first().input == 1
    (tmp_path / "s.json").write_text('{"records": [{"ts": 1.0, "uid": "u", "input": 3}]}')
    assert files.read_usage(spark, str(tmp_path / "s.json")).first().input == 3


def test_report_sections_and_payloads(spark):
    text = "intro\n## 核心问题\nA\nB\n**关键证据**：e1\ne2\n\ne3\ne4\ne5\n免责声明：no\nlost\n解决步骤：\n1. x\n来自网络搜索，仅供参考"
    df = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "report_id int, text string")
    out = {r.report_id: r.report for r in report.normalize_report(df).collect()}
    assert out[1].startswith("核心问题：\nA\n\n关键证据：\ne1\ne2\ne3\ne4\n\n解决步骤：\n1. x\n\n补充确认：") and out[1].endswith(report.NOTICE_TEXT)
    assert out[2] == "nothing" and out[3] == ""
    p = spark.createDataFrame([("q", '{"items":[{"html_url":"https://G.com/a/","title":"T"},{"html_url":"https://g.com/a","title":"U"},{"html_url":"https://g.com/b","title":"V","pull_request":{"url":"x"}}]}')], "query_id string, payload string")
    assert [(r.title, r.url_key) for r in report.issue_items(p).collect()] == [("T", "https://g.com/a")]
    j = spark.createDataFrame([("q", '{"hits":[{"title":"M","slug":"m","display_categories":["fabric","magic"],"versions":["1.20"]},{"title":"P","slug":"p","project_type":"modpack"}]}')], "query_id string, payload string")
    assert [(r.title, r.loaders) for r in report.project_items(j).collect()] == [("M", ["fabric"])]
    h = spark.createDataFrame([("q", '<a href="/forums/x/y/12-z">Great <b>topic</b></a><a href="/forums/x/13">Help</a>')], "query_id string, html string")
    assert [r.title for r in report.forum_items(h).collect()] == ["Great topic"]
    r = spark.createDataFrame([('{"candidates":[{"content":{"parts":[{"text":"a"},{"text":"b"}]}}]}',), ('{"text":" t "}',)], "p string")
    assert [x[0] for x in r.select(report.response_text(F.col("p"))).collect()] == ["a\nb", "t"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a" if i % 3 else "b", float(i * 2 % 37), i) for i in range(60)]
    df = spark.createDataFrame(rows, "user string, ts double, event_id long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = accept_rate_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 6.0)
    q = s.writeStream.format("memory").queryName("rate").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.event_id: r.accepted for r in spark.table("rate").collect()}
    want = {r.event_id: r.accepted for r in usage.accept_rate(df.select("ts", "event_id", "user"), "user", "ts", 6.0).collect()}
    assert got == want
