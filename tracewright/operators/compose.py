"""Selected lines folded, put together and cut to a budget of characters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text as T
from tracewright.functions.profile import GAME_PROFILE, SignalProfile
from tracewright.operators.selection import CHUNK, around, chunked, error_windows, head_tail, located, select_lines, termination
from tracewright.session import stage_table

TAIL, BODY = "连续重复", "重复"


def fold_keys(sel: DataFrame, profile: SignalProfile = GAME_PROFILE, size: int | None = None) -> DataFrame:
    """The mode and the key by which lines fold, and their output form.  ``n_lines`` is the number of the file's lines."""
    size = profile.head_tail if size is None else size
    tail = F.col("idx") >= F.col("n_lines") - size
    mode = F.when(tail, "tail").when(F.col("score") >= profile.strong, "body_exact").otherwise("body")
    s = sel.withColumn("mode", mode)
    key = F.when(F.col("mode") == "tail", T.tail_fold_key(F.col("raw"))).when(F.col("mode") == "body_exact", F.col("body")).otherwise(T.body_fold_key(F.col("body")))
    return s.withColumns({"key": key, "out": T.format_line(F.struct("raw", "body", "severity", "thread", "logger", "timestamp"))})


def fold_groups(keyed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Runs of equal keys among the rows given: ``file, start, end, text,
    repeat_count, repeat_label``.  Tail lines must also follow each other
    without a gap; the first line's text stands for the run.

    Chunks fold by themselves; a chunk's first row is held against the last row
    of the chunk before it, and runs over chunk ends are joined by the place where
    they began, through one row a chunk."""
    k = chunked(keyed, chunk)
    here = Window.partitionBy("file", "chunk").orderBy("idx")
    row = F.struct("idx", "mode", "key")
    ends = k.groupBy("file", "chunk").agg(F.max(row).alias("last"))
    ends = ends.select("file", "chunk", F.lag("last").over(Window.partitionBy("file").orderBy("chunk")).alias("before"))
    k = k.join(ends, ["file", "chunk"])
    prev = F.coalesce(F.lag(row).over(here), F.col("before"))
    k = k.withColumn("prev", prev)
    same = (F.col("prev.key") == F.col("key")) & (F.col("prev.mode") == F.col("mode")) & ((F.col("mode") != "tail") | (F.col("prev.idx") == F.col("idx") - 1))
    k = k.withColumn("new", ~F.coalesce(same, F.lit(False)))
    g = located(k, lasts={"begin": F.col("new")})
    return g.groupBy("file", F.col("begin_upto").alias("start")).agg(
        F.max("idx").alias("end"), F.min_by("out", "idx").alias("text"), F.count(F.lit(1)).alias("repeat_count"), F.when(F.min_by("mode", "idx") == "tail", TAIL).otherwise(BODY).alias("repeat_label")
    ).select("file", "start", "end", "text", "repeat_count", "repeat_label")


def compose(groups: DataFrame) -> DataFrame:
    """One text a file: the groups in order, a marker where lines are left
    out (also before the first group), repeats with their number."""
    gap = F.coalesce(F.lag("end").over(Window.partitionBy("file").orderBy("start")), F.lit(-2)) != F.col("start") - 1
    note = F.when(F.col("repeat_count") > 1, F.concat(F.lit(" ("), "repeat_label", F.lit(" "), F.col("repeat_count").cast("string"), F.lit(" 次)"))).otherwise("")
    line = F.concat(F.when(gap, T.GAP + "\n").otherwise(""), "text", note)
    g = groups.select("file", "start", line.alias("line")).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "line"))).alias("parts"))
    return g.select("file", T.strip(F.array_join(F.transform("parts", lambda p: p["line"]), "\n")).alias("body"))


def _fold(rows: list[tuple]) -> str:
    """Fold and compose rows (idx, mode, key, out) of one file."""
    out, prev, count, start = [], None, 0, -2
    end = -2

    def close() -> None:
        if prev is not None:
            label = TAIL if prev[1] == "tail" else BODY
            out.append(first + (f" ({label} {count} 次)" if count > 1 else ""))

    first = ""
    for r in rows:
        if prev is not None and r[1] == prev[1] and r[2] == prev[2] and (r[1] != "tail" or r[0] == end + 1):
            count += 1
        else:
            close()
            if r[0] != end + 1:
                out.append(T.GAP)
            first, count, start = r[3], 1, r[0]
        prev, end = r, r[0]
    close()
    del start
    return "\n".join(out).strip()


def cascade(rows: list[tuple], note: str, limit: int, head: int, n_lines: int, strong: int) -> str:
    """The first of the tiers that fits: everything; head, strong middle,
    tail and priority; priority and tail; priority; its longest prefix; head and
    tail; the longest prefix of the head with the tail; the longest rest of the
    tail; the cut note.  Rows: (idx, mode, key, out, score, selected, priority)."""
    text = lambda rs: "\n".join(x for x in (note, _fold(rs)) if x)
    sel = [r for r in rows if r[5]]
    if len(full := text(sel)) <= limit:
        return full
    pri = [r for r in rows if r[6]]
    at = max(0, n_lines - head)
    heads, tails = [r for r in sel if r[0] < head], [r for r in sel if r[0] >= at]
    middle = [r for r in sel if head <= r[0] < at and r[4] >= strong]

    def union(*parts: list[tuple]) -> list[tuple]:
        return sorted({r[0]: r for p in parts for r in p}.values())

    def longest(take, n: int) -> str | None:
        lo, hi, best = 0, n, None
        while lo <= hi:
            mid = (lo + hi) // 2
            if len(t := text(take(mid))) <= limit:
                best, lo = (t if mid else best), mid + 1
            else:
                hi = mid - 1
        return best

    tiers = [union(heads, middle, tails, pri)] + ([union(pri, tails), pri] if pri else [])
    for t in tiers:
        if len(out := text(t)) <= limit:
            return out
    if pri and (best := longest(lambda k: pri[:k], len(pri))):
        return best
    if len(out := text(union(heads, tails))) <= limit:
        return out
    if len(base := text(tails)) <= limit:
        return longest(lambda k: union(heads[:k], tails), len(heads)) or base
    return longest(lambda k: tails[len(tails) - k :], len(tails)) or note[:limit]


def extract_c(recs: DataFrame, limit: int = 140_000, profile: SignalProfile = GAME_PROFILE, window: int = 12, head: int | None = None) -> DataFrame:
    """The evidence extract of each file: ``file, extract, over_budget, fallback``.

    Files within the budget are composed natively; only the others go through
    the cascade, one file a time (a file is bounded by the input cap)."""
    size = profile.head_tail if head is None else head
    # The selection has several readers; its narrow rows are written once.
    need = ["file", "idx", "raw", "body", "severity", "thread", "logger", "timestamp", "score", "is_noise", "f_ending", "f_actionable", "selected", "s_priority", "n_lines", "fallback"]
    sel = stage_table(select_lines(recs, profile, window, head).select(*need), "selection")
    end = termination(sel, profile).select("file", "note")
    keyed = fold_keys(sel, profile, size).where("selected or s_priority").select("file", "idx", "mode", "key", "out", "score", "selected", "s_priority", "n_lines", "fallback")
    body = compose(fold_groups(keyed.where("selected")))
    flag = sel.groupBy("file").agg(F.first("fallback").alias("fallback"))
    whole = flag.join(end, "file", "left").join(body, "file", "left")
    whole = whole.withColumn("full", F.concat_ws("\n", F.nullif("note", F.lit("")), F.nullif("body", F.lit(""))))
    fits = F.length("full") <= limit
    small = whole.where(fits).select("file", F.col("full").alias("extract"), F.lit(False).alias("over_budget"), "fallback")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        rows = list(zip(pdf["idx"], pdf["mode"], pdf["key"], pdf["out"], pdf["score"], pdf["selected"], pdf["s_priority"], strict=True))
        t = cascade(rows, pdf["note"].iloc[0] or "", limit, size, int(pdf["n_lines"].iloc[0]), profile.strong)
        return pd.DataFrame({"file": [pdf["file"].iloc[0]], "extract": [t], "over_budget": [True], "fallback": [bool(pdf["fallback"].iloc[0])]})

    over = keyed.join(whole.where(~fits).select("file", "note"), "file")
    kind = dict(recs.dtypes)["file"]
    large = over.groupBy("file").applyInPandas(run, f"file {kind}, extract string, over_budget boolean, fallback boolean")
    return small.unionByName(large).withColumn("extract", T.redact_extract(F.col("extract")))


# The labelled sections of two kinds of reports.
SECTIONS = {
    "hs_err": (("fatal error", "fatal error|A fatal error has been detected"), ("problematic frame", "Problematic frame|siginfo"), ("java/native frames", "Java frames|Native frames"), ("vm arguments", "VM Arguments|Command Line"), ("system info", "OS:|CPU:|Memory:|Host:")),
    "crash": (("header/description", "Description:|---- Minecraft Crash Report ----"), ("stacktrace", "Stacktrace:|Exception Details:"), ("caused by chain", "Caused by:"), ("suspected mods", "Suspected Mods|Mod File|Mod List"), ("system details", "System Details|-- System Details --")),
}


def sections_a(recs: DataFrame, kind: str = "crash", length: int = 400) -> DataFrame:
    """For each label the ``length`` lines from its first match: ``file, section, label, text``.
    Sections may overlap; a line is given to all that hold it.  A section's lines come together, ``length`` at most."""
    found = located(chunked(recs.select("file", "idx", "raw")), ends={f"m{i}": (F.col("raw").rlike("(?i)" + p), "min") for i, (_, p) in enumerate(SECTIONS[kind])})
    inside = F.array(*[F.when(F.col("idx").between(F.col(f"m{i}"), F.col(f"m{i}") + length - 1), F.struct(F.lit(i).alias("section"), F.lit(label).alias("label"))) for i, (label, _) in enumerate(SECTIONS[kind])])
    rows = found.select("file", "idx", "raw", F.explode(F.array_compact(inside)).alias("s")).select("file", "idx", "raw", "s.*")
    g = rows.groupBy("file", "section", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "raw"))), lambda x: x["raw"]), "\n").alias("t"))
    return g.select("file", "section", "label", F.concat(F.lit("["), "label", F.lit("]\n"), "t").alias("text"))


def compose_lines(lines: DataFrame, flag: Column) -> DataFrame:
    """W11 without folding: the flagged lines in compact form with gap markers."""
    out = T.format_line(F.struct("raw", "body", "severity", "thread", "logger", "timestamp"))
    g = lines.withColumn("take", flag).where("take").select("file", F.col("idx").alias("start"), F.col("idx").alias("end"), out.alias("text"), F.lit(1).alias("repeat_count"), F.lit(BODY).alias("repeat_label"))
    return compose(g)


def error_focused(recs: DataFrame, size: int = 180) -> DataFrame:
    """Head, tail, error windows and the first timestamped lines of each file."""
    d = chunked(recs).withColumns({"f_error": GAME_PROFILE.hit(F.col("raw"), "error_line"), "f_stamp": GAME_PROFILE.hit(F.col("raw"), "timestamp")})
    d = located(d, {"line": F.lit(True), "errors": F.col("f_error"), "stamps": F.col("f_stamp")})
    d = around(d, {"near_error": (F.col("f_error") & (F.col("errors") <= 400), 8)})
    return compose_lines(d, head_tail(size) | F.col("near_error") | (F.col("f_stamp") & (F.col("stamps") <= 240)))


def extract_b(recs: DataFrame, ends: int = 500, short: int = 1000) -> DataFrame:
    """Strategy B: files up to ``short`` lines whole, longer ones as head, tail and error windows."""
    return compose_lines(error_windows(recs, 8, 300), (F.col("line_all") <= short) | head_tail(ends) | F.col("near_error"))


def with_must_keep(base: Column, must: Column, limit: int) -> Column:
    """The block of what must be kept before the selected text, cut to ``limit``; without such a block the text."""
    block = F.concat(F.lit("【MustKeep Evidence】\n\n[must_keep:deduped]\n"), must)
    merged = F.concat(block, F.lit("\n\n【Selected Evidence】\n\n"), base)
    rest = F.lit(limit) - F.length(block) - F.length(F.lit("\n\n【Selected Evidence】\n"))
    cut = F.concat(block, F.lit("\n\n【Selected Evidence】\n"), F.substr(base, F.lit(1), F.greatest(rest, F.lit(0))))
    return (
        F.when(F.coalesce(must, F.lit("")) == "", F.when(F.length(base) <= limit, base).otherwise(F.substring(base, 1, limit)))
        .when(F.length(merged) <= limit, merged)
        .when(F.length(block) >= limit, F.substring(block, 1, limit))
        .otherwise(cut)
    )
