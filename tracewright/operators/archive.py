"""Compositions over files of an archive and cached results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text as T
from tracewright.operators.lookup import resolve_paths
from tracewright.operators.usage import within_quota


def dispatch(names: DataFrame, run_logs: DataFrame, key: str = "file", name: str = "name") -> DataFrame:
    """F1 and F2 together: the strategy of each file: what its name calls for;
    a file whose name calls for B is read as C if its first lines look like a run log.
    ``run_logs`` has ``file, is_run_log``; files it doesn't know are no run logs.

    Result: ``file, strategy``."""
    n = names.select(F.col(key).alias("file"), T.name_strategy(F.col(name)).alias("named"))
    j = n.join(run_logs.select("file", "is_run_log"), "file", "left")
    return j.select("file", F.when((F.col("named") == "B") & F.coalesce("is_run_log", F.lit(False)), "C").otherwise(F.col("named")).alias("strategy"))


def read_archive(requests: DataFrame, files: DataFrame, quota: int = 1, limit: int = 8000) -> DataFrame:
    """What each request for a file of an archive is answered.

    ``requests``: (archive, ord, requested); ``files``: (archive, path, content,
    strategy, extract), the extract being what the strategy made of the text.  A
    request is answered in steps, the first that applies: several paths at once,
    no or several such files, no calls left of the ``quota`` of its archive (only
    calls that mean a file use it up), a binary file, else the extract, redacted,
    cut to ``limit`` characters and cleaned.  Result: ``archive, ord, requested,
    status, path, strategy, text``; a request with a null archive or path is invalid."""
    r = requests.select("archive", "ord", F.trim(F.regexp_replace(F.coalesce("requested", F.lit("")), r"\\", "/")).alias("requested"))
    r = r.withColumn("asked", F.regexp_replace(F.regexp_replace("requested", "/+", "/"), "^/|/$", ""))
    several = T.names_several_paths(F.col("asked"))
    found = resolve_paths(r.where((F.col("asked") != "") & ~several).select("archive", F.col("asked").alias("requested")).distinct(), files.select("archive", "path"))
    j = r.join(found.select("archive", F.col("requested").alias("asked"), "path", F.col("status").alias("found")), ["archive", "asked"], "left")
    j = j.withColumn("found", F.when((F.col("asked") == "") | F.col("archive").isNull(), "invalid").when(several, "several").otherwise(F.coalesce("found", F.lit("missing"))))
    calls = within_quota(j.where("found = 'found'"), "archive", "ord", quota).select("archive", "ord", "granted")
    j = j.join(calls, ["archive", "ord"], "left").join(files, ["archive", "path"], "left")
    status = F.when(F.col("found") != "found", F.col("found")).when(~F.col("granted"), "no_calls_left").when(T.is_binary(F.col("content")), "binary").otherwise("read")
    cut = T.redact(F.col("extract"))
    cut = F.when(F.length(cut) > limit, F.concat(F.substring(cut, 1, limit), F.lit("\n...[内容已截断]..."))).otherwise(cut)
    text = F.concat(F.lit("归档文件 `"), "path", F.lit("` 内容（提取策略："), "strategy", F.lit("）:\n"), T.sanitize_response(cut, limit + 100))
    j = j.withColumn("status", status)
    return j.select("archive", "ord", "requested", "status", F.when(F.col("status") == "read", F.col("path")).alias("path"), F.when(F.col("status") == "read", F.col("strategy")).alias("strategy"), F.when(F.col("status") == "read", text).alias("text"))


def file_list(files: DataFrame, most: int = 120) -> DataFrame:
    """``archive, listing``: the sorted names of each archive's files, one a line;
    of more than ``most`` (the listing's length) the number of the others."""
    w = Window.partitionBy("archive")
    f = files.select("archive", "name").where("name is not null").distinct()
    f = f.withColumns({"n": F.row_number().over(w.orderBy("name")), "of": F.count(F.lit(1)).over(w)}).where(F.col("n") <= most)
    g = f.groupBy("archive").agg(F.max("of").alias("of"), F.array_sort(F.collect_list("name")).alias("names"))
    lines = F.array_join(F.transform("names", lambda x: F.concat(F.lit("- "), x)), "\n")
    rest = F.when(F.col("of") > most, F.concat(F.lit("\n- ...(其余 "), (F.col("of") - most).cast("string"), F.lit(" 个文件已省略)"))).otherwise("")
    return g.select("archive", F.concat(lines, rest).alias("listing"))


def numbered(entries: DataFrame, key: str, rank: str, text: Column) -> DataFrame:
    """U4: ``key, entries, text``: the entries of each key (a bounded number, as
    ``live_entries`` gives) numbered in their order under a headline."""
    e = entries.select(F.col(key), F.col(rank).alias("r"), F.coalesce(text, F.lit("")).alias("t"))
    g = e.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("r", "t"))).alias("p"))
    line = F.transform("p", lambda x, i: F.concat(F.lit("--- 结果 "), (i + 1).cast("string"), F.lit(" ---\n"), x["t"]))
    head = F.concat(F.lit("uid="), F.col(key), F.lit(" 共有 "), F.size("p").cast("string"), F.lit(" 条缓存的日志分析结果：\n"))
    return g.select(key, F.size("p").alias("entries"), F.concat(head, F.array_join(line, "\n")).alias("text"))


def search_listing(kept: DataFrame, stats: DataFrame, sources: list[tuple[str, str]]) -> DataFrame:
    """``query_id, text``: the kept items of a search under one headline for each
    source in the order of ``sources`` (key, label).  ``kept``: (query_id, source, pos,
    title, url, also_seen_in, summary); ``stats`` as ``dedupe_stats`` gives; a source
    without rows has no results."""
    n = F.row_number().over(Window.partitionBy("query_id", "source").orderBy("pos"))
    also = F.when(F.size("also_seen_in") > 0, F.concat(F.lit(" (also seen in: "), F.array_join("also_seen_in", ", "), F.lit(")"))).otherwise("")
    note = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("\n摘要: "), "summary")).otherwise("")
    k = kept.withColumn("n", n).select("query_id", "source", "n", F.concat(F.col("n").cast("string"), F.lit(". "), "title", F.lit(" - "), "url", also, note).alias("line"))
    k = k.groupBy("query_id", "source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("items"))
    s = stats.join(k, ["query_id", "source"], "left")
    total = s.groupBy("query_id").agg(F.sum("raw_count").alias("raw"), F.sum("kept_count").alias("kept"), F.map_from_entries(F.collect_list(F.struct("source", F.struct("raw_count", "kept_count", "items")))).alias("m"))
    blocks = []
    for source, label in sources:
        x = F.try_element_at("m", F.lit(source))
        shown = F.concat(F.lit(f"【{label}】成功：原始 "), x["raw_count"].cast("string"), F.lit(" 条，去重后 "), x["kept_count"].cast("string"), F.lit(" 条\n"), F.coalesce(x["items"], F.lit("该站点结果已被更高优先级来源去重。")))
        blocks.append(F.when(x.isNull(), f"【{label}】无结果").otherwise(shown))
    head = F.concat(F.lit("【去重统计】原始结果 "), F.col("raw").cast("string"), F.lit(" 条，去重后 "), F.col("kept").cast("string"), F.lit(" 条，移除重复 "), (F.col("raw") - F.col("kept")).cast("string"), F.lit(" 条。"))
    return total.select("query_id", F.concat_ws("\n", head, *blocks).alias("text"))
