"""Transforms of reports and of payloads that come as JSON or HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text as T

# A report's sections in their order, how many lines each keeps, and the notice.
SECTIONS = {"核心问题": 1, "关键证据": 4, "解决步骤": 4, "补充确认": 4}
EXTRA = r"^(?:免责声明|额外说明|补充说明|注意事项|更多建议|总结|结论|分析过程|补充约束)\s*[:：]"
NOTICE = "网络搜索"
NOTICE_MARK = "仅供参考"
NOTICE_TEXT = "请注意，以下部分信息来源于网络搜索，仅供参考，请谨慎判断其准确性。"


def normalize_report(reports: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    """``key, report``: the four sections in their order, each cut to its
    lines; preamble, foreign headings and fences left out.  A report without any
    section stays as it is; null is an empty report."""
    raw = reports.select(F.col(key).alias("k"), T.strip(F.coalesce(F.col(text), F.lit(""))).alias("raw"))
    line = raw.select("k", F.posexplode(F.split(F.regexp_replace("raw", "\r\n?", "\n"), "\n")).alias("pos", "line"))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(T.strip(F.col("line")), r"^#{1,6}\s*", ""), r"\*\*", ""), "^[`_ \t]+|[`_ \t]+$", "")
    head = r"^(" + "|".join(SECTIONS) + r")\s*(?:[:：]\s*(.*))?$"
    hit = bare.rlike(head)
    plain = F.regexp_replace(F.regexp_replace(T.strip(F.col("line")), r"\*\*", ""), "^[`_ \t]+|[`_ \t]+$", "")
    foreign = ~hit & (F.col("line").rlike(r"^\s*#{1,6}\s+\S+") | plain.rlike(r"^[一-鿿A-Za-z][一-鿿A-Za-z0-9 _/（）()【】\-]{1,24}\s*[:：]\s*$") | plain.rlike(EXTRA))
    notice = F.contains("line", F.lit(NOTICE)) & F.contains("line", F.lit(NOTICE_MARK))
    line = line.where(~F.startswith(T.strip(F.col("line")), F.lit("```"))).withColumns({"hit": hit, "title": F.when(hit, F.regexp_extract(bare, head, 1)).when(foreign, ""), "inline": T.strip(F.regexp_extract(bare, head, 2)), "foreign": foreign, "notice": notice})
    w = Window.partitionBy("k").orderBy("pos")
    line = line.withColumn("section", F.last("title", True).over(w))
    body = line.where("section <> '' and not foreign and not (notice and not hit)").withColumn("content", T.strip(F.when(F.col("hit"), F.col("inline")).otherwise(F.col("line")))).where("content <> ''")
    n = F.row_number().over(Window.partitionBy("k", "section").orderBy("pos"))
    cap = F.try_element_at(F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv]), F.col("section"))
    body = body.withColumn("n", n).where(F.col("n") <= cap)
    g = body.groupBy("k", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n").alias("part"))
    m = g.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("section", "part"))).alias("m"))
    found = line.groupBy("k").agg(F.bool_or("hit").alias("any"), F.bool_or("notice").alias("notice"))
    out = raw.join(found, "k", "left").join(m, "k", "left")
    blocks = [F.concat(F.lit(f"{t}："), F.coalesce(F.concat(F.lit("\n"), F.try_element_at("m", F.lit(t))), F.lit("")), F.lit("\n")) for t in SECTIONS]
    whole = T.strip(F.concat(F.concat_ws("\n", *blocks), F.when(F.col("notice"), "\n" + NOTICE_TEXT).otherwise("")))
    return out.select(F.col("k").alias(key), F.when(F.coalesce("any", F.lit(False)), whole).otherwise(F.col("raw")).alias("report"))


def code_message(blocks: Column, limit: int = 16_000) -> Column:
    """The code blocks one after the other, as far as they fit."""
    head = "以下是分析结果中的代码块（便于复制）："
    start = F.struct(F.lit(head).alias("t"), F.lit(0).alias("i"), F.lit(False).alias("full"))

    def step(acc: Column, b: Column) -> Column:
        piece = F.concat(F.lit("\n\n[代码块 "), (acc["i"] + 1).cast("string"), F.lit("]\n```"), F.when(b["lang"] == "", "text").otherwise(b["lang"]), F.lit("\n"), b["code"], F.lit("\n```"))
        fits = ~acc["full"] & (F.length(acc["t"]) + F.length(piece) <= limit - 2)
        return F.struct(F.when(fits, F.concat(acc["t"], piece)).otherwise(acc["t"]).alias("t"), (acc["i"] + 1).alias("i"), (acc["full"] | ~fits).alias("full"))

    return F.when(F.size(blocks) == 0, "").otherwise(F.aggregate(blocks, start, step)["t"])


ISSUES = "struct<items:array<struct<html_url:string,title:string,body:string,repository_url:string,number:int,state:string,pull_request:struct<url:string>>>>"
PROJECTS = "struct<hits:array<struct<title:string,slug:string,project_id:string,project_type:string,description:string,display_categories:array<string>,categories:array<string>,versions:array<string>>>>"
KNOWN_LOADERS = ("fabric", "forge", "neoforge", "quilt")


def _first_per_url(items: DataFrame, query: str) -> DataFrame:
    w = Window.partitionBy(query, "url_key").orderBy("pos")
    return items.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def issue_items(payloads: DataFrame, query: str = "query_id", payload: str = "payload") -> DataFrame:
    """Issues of a search payload: no pull requests, address and title
    needed, the first of each address."""
    i = payloads.select(query, F.posexplode(F.from_json(payload, ISSUES)["items"]).alias("pos", "i")).where("i.pull_request is null")
    s = lambda c: T.strip(F.coalesce(F.col(f"i.{c}"), F.lit("")))
    i = i.where((s("html_url") != "") & (s("title") != ""))
    repo = F.regexp_extract(F.regexp_replace(s("repository_url"), "/+$", ""), r".*/repos/(.*)$", 1)
    i = i.select(query, "pos", s("title").alias("title"), s("html_url").alias("url"), T.canonical_url(s("html_url")).alias("url_key"), T.title_signature(s("title")).alias("title_key"), T.summarize(F.col("i.body")).alias("summary"), repo.alias("repo"), F.coalesce("i.number", F.lit(0)).alias("number"), F.coalesce(F.nullif(F.lower(s("state")), F.lit("")), F.lit("unknown")).alias("state"))
    return _first_per_url(i, query)


def project_items(payloads: DataFrame, query: str = "query_id", payload: str = "payload") -> DataFrame:
    """Projects of a search payload: mods with title and slug, at most three known loaders and versions."""
    i = payloads.select(query, F.posexplode(F.from_json(payload, PROJECTS)["hits"]).alias("pos", "i"))
    s = lambda c: T.strip(F.coalesce(F.col(f"i.{c}"), F.lit("")))
    slug = F.when(s("slug") != "", s("slug")).otherwise(s("project_id"))
    kind = F.lower(F.when(s("project_type") == "", "mod").otherwise(s("project_type")))
    url = F.concat(F.lit("https://modrinth.com/mod/"), slug)
    loaders = F.slice(F.filter(F.transform(F.coalesce("i.display_categories", "i.categories", F.array().cast("array<string>")), T.strip), lambda c: F.lower(c).isin(*KNOWN_LOADERS)), 1, 3)
    i = i.where((s("title") != "") & (slug != "") & (kind == "mod")).select(query, "pos", s("title").alias("title"), url.alias("url"), T.canonical_url(url).alias("url_key"), T.title_signature(s("title")).alias("title_key"), T.summarize(F.col("i.description")).alias("summary"), loaders.alias("loaders"), F.slice(F.filter(F.coalesce("i.versions", F.array().cast("array<string>")), lambda v: T.strip(v) != ""), 1, 3).alias("versions"))
    return _first_per_url(i, query)


def forum_items(pages: DataFrame, query: str = "query_id", page: str = "html", host: str = "https://www.minecraftforum.net") -> DataFrame:
    """Threads linked from a forum's result page; navigation and short titles left out."""
    anchor = r'(?is)<a[^>]*href="((?:https?://www\.minecraftforum\.net)?/forums/(?:[^"/]+/)+\d+(?:-[^"#?<>]+)?)"[^>]*>(.*?)</a>'
    i = pages.select(query, F.posexplode(F.regexp_extract_all(F.col(page), F.lit(anchor), F.lit(0))).alias("pos", "a"))
    href, title = F.regexp_extract("a", anchor, 1), T.strip_html(F.regexp_extract("a", anchor, 2))
    i = i.select(query, "pos", title.alias("title"), F.when(F.startswith(href, F.lit("http")), href).otherwise(F.concat(F.lit(host), href)).alias("url"), href.alias("href"))
    i = i.where((F.length("title") >= 4) & ~F.lower("title").isin("help", "sign in", "register", "next thread", "previous thread") & ~F.lower("href").rlike("/search|/latest|/new-post")).drop("href")
    i = i.withColumns({"url_key": T.canonical_url(F.col("url")), "title_key": T.title_signature(F.col("title")), "summary": F.lit("")})
    return _first_per_url(i, query)


RESPONSE = "struct<completion_text:string,candidates:array<struct<content:struct<parts:array<struct<text:string>>>,text:string>>,text:string,output_text:string>"


def response_text(payload: Column) -> Column:
    """The text of an answer: completion text, else the first four candidates' parts or texts, else text, else output text."""
    r = F.from_json(payload, RESPONSE)
    some = lambda c: F.nullif(T.strip(c), F.lit(""))
    none = F.array().cast("array<string>")
    parts = F.flatten(F.transform(F.slice(F.coalesce(r["candidates"], F.array().cast("array<struct<content:struct<parts:array<struct<text:string>>>,text:string>>")), 1, 4), lambda c: F.concat(F.coalesce(F.transform(c["content"]["parts"], lambda p: p["text"]), none), F.array(c["text"]))))
    return F.coalesce(some(r["completion_text"]), some(F.array_join(F.filter(parts, lambda p: F.coalesce(T.strip(p), F.lit("")) != ""), "\n")), some(r["text"]), some(r["output_text"]), F.lit(""))


def usage_text(by_user: DataFrame, key: str = "uid") -> DataFrame:
    """K7: a usage table as text lines in order."""
    line = F.format_string("%s: %d in / %d out / %d", F.col(key), F.col("input"), F.col("output"), F.col("sum"))
    g = by_user.agg(F.array_sort(F.collect_list(F.struct((-F.col("sum")).alias("o"), "first_seen", F.col(key).alias("k"), line.alias("line")))).alias("l"))
    return g.select(F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
