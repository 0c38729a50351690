"""Which lines of a log are evidence, chunk by chunk.

A file of any length is cut into chunks of ``CHUNK`` line numbers.  What a line
needs of the rest of its file comes in two ways, neither of which gathers a file
in one place: running counts and last or first hits before a chunk are carried
in one row a chunk (``located``), and windows of some lines around a hit read
the ``HALO`` lines beyond both ends of their chunk (``around``).  What the
operators select is a boolean column, never a set of numbers.

Windows go by line numbers: "within 8 lines" are 8 numbers up and down.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text as T
from tracewright.functions.profile import GAME_PROFILE, SignalProfile, line_score
from tracewright.session import stage_table

CHUNK = 8192
#: The widest window around a line.
HALO = 20


def chunked(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Add the number of each line's chunk."""
    return lines.withColumn("chunk", F.floor(F.col("idx") / chunk).cast("long"))


def located(lines: DataFrame, counts: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, ends: dict[str, tuple[Column, str]] | None = None) -> DataFrame:
    """Add where each line stands in its file, for lines with a ``chunk``.

    ``counts``: name -> flag gives ``name``, the running number of hits up to the
    line, and ``name_all``, that of the file.  ``lasts``: name -> flag gives
    ``name_before`` and ``name_upto``, the last hit before the line and up to it.
    ``ends``: name -> (flag, "min" or "max") gives ``name``, the first or last hit
    of the file.  Chunks are added up first; only their rows, one a chunk, are
    ordered by file.
    """
    counts, lasts, ends = counts or {}, lasts or {}, ends or {}
    idx = F.col("idx")
    flags = {**counts, **lasts, **{k: c for k, (c, _) in ends.items()}}
    d = lines.withColumns({f"_{k}": F.coalesce(c, F.lit(False)) for k, c in flags.items()})
    hit = lambda k: F.when(F.col(f"_{k}"), idx)
    per = d.groupBy("file", "chunk").agg(
        *[F.count_if(F.col(f"_{k}")).alias(k) for k in counts], *[F.max(hit(k)).alias(k) for k in lasts], *[(F.min if end == "min" else F.max)(hit(k)).alias(k) for k, (_, end) in ends.items()], F.lit(1).alias("_one")
    )
    file = Window.partitionBy("file")
    earlier = file.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "file", "chunk", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"c_{k}") for k in counts], *[F.sum(k).over(file).alias(f"{k}_all") for k in counts],
        *[F.max(k).over(earlier).alias(f"c_{k}") for k in lasts], *[(F.min if end == "min" else F.max)(k).over(file).alias(k) for k, (_, end) in ends.items()],
    )
    d = d.join(per, ["file", "chunk"])
    w = Window.partitionBy("file", "chunk").orderBy("idx")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({k: F.col(f"c_{k}") + F.sum(F.col(f"_{k}").cast("long")).over(upto) for k in counts} | {f"{k}_before": F.greatest(f"c_{k}", F.max(hit(k)).over(before)) for k in lasts} | {f"{k}_upto": F.greatest(f"c_{k}", F.max(hit(k)).over(upto)) for k in lasts})
    return d.drop(*[f"_{k}" for k in flags], *[f"c_{k}" for k in (*counts, *lasts)])


def around(lines: DataFrame, flags: dict[str, tuple[Column, int]], chunk: int = CHUNK) -> DataFrame:
    """Name -> (flag, radius) gives ``name``: whether the flag holds within so many lines, for lines with a ``chunk``."""
    widest = max(r for _, r in flags.values())
    assert widest <= HALO <= chunk, widest
    at = F.pmod(F.col("idx"), F.lit(chunk))
    # Lines near an end also go to the neighbouring chunk.
    zones = F.array_compact(F.array(F.col("chunk"), F.when(at < widest, F.col("chunk") - 1), F.when(at >= chunk - widest, F.col("chunk") + 1)))
    d = lines.withColumns({f"_{k}": F.coalesce(c, F.lit(False)) for k, (c, _) in flags.items()}).withColumn("_zone", F.explode(zones))
    w = Window.partitionBy("file", "_zone").orderBy("idx")
    d = d.withColumns({k: F.max(f"_{k}").over(w.rangeBetween(-r, r)) for k, (_, r) in flags.items()})
    return d.where("_zone = chunk").drop("_zone", *[f"_{k}" for k in flags])


def in_block(seed: Column, continuation: Column, name: str) -> Column:
    """The seeds, and continuation lines that follow a seed without a gap; ``located`` gave the last seed as
    ``name`` and the last line that goes on with nothing as ``breaks``."""
    return seed | F.coalesce(continuation & (F.col(f"{name}_before") >= F.coalesce("breaks_upto", F.lit(-1))), F.lit(False))


def records(lines: DataFrame, file: str = "file", idx: str = "idx", text: str = "text", profile: SignalProfile = GAME_PROFILE) -> DataFrame:
    """W15, first part: ``file, idx, raw, body, severity, thread, logger,
    timestamp, score, is_noise`` for each line.  Rows without file or number
    are left out; a null line is an empty one."""
    p = lines.select(F.col(file).alias("file"), F.col(idx).alias("idx"), F.col(text).alias("t")).where("file is not null and idx is not null")
    p = p.select("file", "idx", T.parse_prefix(F.col("t")).alias("p")).select("file", "idx", "p.*")
    score = line_score(profile, F.col("raw"), F.col("body"), F.col("severity"))
    return p.withColumn("score", score).withColumn("is_noise", profile.hit(F.col("body"), "noise"))


def block_runs(lines: DataFrame, seed: Column, continuation: Column, name: str = "in_block", chunk: int = CHUNK) -> DataFrame:
    """Add ``name``: whether a line belongs to a block."""
    d = located(chunked(lines, chunk), lasts={"seed": seed, "breaks": ~F.coalesce(continuation, F.lit(False))})
    return d.withColumn(name, in_block(seed, continuation, "seed")).drop("chunk", "seed_before", "seed_upto", "breaks_before", "breaks_upto")


def head_tail(size: int) -> Column:
    """The first and the last ``size`` lines of a file; ``located`` counted the lines as ``line``."""
    return (F.col("line") <= size) | (F.col("line_all") - F.col("line") < size)


def line_windows(recs: DataFrame, near: dict[str, tuple[Column, int]], size: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Add ``ends``, the first and last ``size`` lines, and windows around flags."""
    d = chunked(recs, chunk)
    if size is not None:
        d = located(d, {"line": F.lit(True)}).withColumn("ends", head_tail(size)).drop("line", "line_all")
    return around(d, near, chunk).drop("chunk")


def error_windows(recs: DataFrame, radius: int = 8, most: int = 300, profile: SignalProfile = GAME_PROFILE, chunk: int = CHUNK) -> DataFrame:
    """Add ``near_error``: within ``radius`` lines of the first ``most`` error lines."""
    d = chunked(recs, chunk).withColumn("f_error", profile.hit(F.col("raw"), "error_line"))
    d = located(d, {"errors": F.col("f_error"), "line": F.lit(True)})
    return around(d, {"near_error": (F.col("f_error") & (F.col("errors") <= most), radius)}, chunk).drop("chunk", "f_error", "errors", "errors_all")


def flags(recs: DataFrame, profile: SignalProfile = GAME_PROFILE) -> DataFrame:
    """The families' flags of each record, worked out once before any window."""
    b, r, h = F.col("body"), F.col("raw"), profile.hit
    return recs.withColumns(
        {
            "f_seed": h(b, "block_seed"),
            "f_cont": (b != "") & h(b, "continuation", "class_loading", "dependency_detail", "datapack_failure", "shader_failure"),
            "f_evidence": h(b, "evidence") | h(r, "evidence"),
            "f_base": h(b, "base_frame"),
            "f_failure": h(b, "datapack_failure", "shader_failure"),
            "f_reload": h(b, "reload_noise"),
            "f_fatal": F.col("severity").isin("ERROR", "FATAL"),
            "f_cause": h(b, "cause"),
            "f_version": h(r, "version") | h(b, "version"),
            "f_saved": h(b, "crash_saved"),
            "f_actionable": h(b, "fatal", "class_loading", "diagnostic", "dependency_header", "dependency_detail", "evidence") | h(r, "fatal", "evidence"),
            "f_ending": F.when(h(r, "oom") | h(b, "oom"), "OOM").when(h(r, "watchdog") | h(b, "watchdog"), "watchdog卡死").when(h(r, "tick_stall") | h(b, "tick_stall"), "tick卡死").when(h(b, "ordered_stop"), "有序关闭"),
            "f_signature": T.throwable_signature(b),
            **{f"a_{k}": h(b, k) for k in ANCHORS},
        }
    )


ANCHORS = ("dependency_header", "diagnostic", "class_loading", "datapack_failure", "shader_failure", "oom", "watchdog", "tick_stall", "ordered_stop")


def first_signatures(flagged: DataFrame, most: int = 32) -> DataFrame:
    """``file, chunk, keep``: by chunk the numbers of the lines with the first appearance of each of a
    file's first ``most`` distinct throwables.  Equal ones are added up before they are ordered."""
    f = flagged.where("f_signature is not null").groupBy("file", "f_signature").agg(F.min(F.struct("idx", "chunk")).alias("x")).select("file", "x.*")
    f = f.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("idx"))).where(F.col("n") <= most)
    return f.groupBy("file", "chunk").agg(F.collect_set("idx").alias("keep"))


def pruned_noise(recs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """add ``pruned``: noise without points, unless a reload stands near a failure."""
    d = around(chunked(recs, chunk), {"near_failure": (F.col("f_failure"), 5)}, chunk)
    return d.withColumn("pruned", F.col("is_noise") & (F.col("score") <= 0) & ~(F.col("f_reload") & F.col("near_failure"))).drop("chunk", "near_failure")


def select_lines(recs: DataFrame, profile: SignalProfile = GAME_PROFILE, window: int = 12, head: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """All selections of a file's lines as boolean columns: ``s_score, s_must,
    s_priority, s_noise, selected`` and ``n_lines, key_hits, strong_hits, fallback``.

    W8, priority: evidence wherever it stands and the first lines of the first 32
    distinct throwables, with up to 4 lines around; frames of the base library for
    themselves alone.  W7, must: lines around the first error, the last cause, the
    first three version banners, the first saved report and the first line of each
    anchor family, and all priority.  W3, score: head, tail, windows whose radius
    grows with the score, blocks of scored seeds.  F5, noise: see ``pruned_noise``.
    ``fallback`` tells of files without (strong) hits; their ``selected`` lines
    are head, tail, error windows and the first 240 timestamped lines instead
    (W6, F8)."""
    size = profile.head_tail if head is None else head
    f = chunked(flags(recs, profile), chunk)
    f = f.withColumns({"f_error": profile.hit(F.col("raw"), "error_line"), "f_stamp": profile.hit(F.col("raw"), "timestamp")})
    # The flags have three readers; they are worked out once.
    f = stage_table(f, "flags")
    f = f.join(first_signatures(f), ["file", "chunk"], "left")
    f = f.withColumn("p_keep", F.coalesce(F.array_contains("keep", F.col("idx")), F.lit(False))).drop("keep")
    hit = F.col("f_evidence") | F.col("p_keep")
    alone = F.col("f_evidence") & F.col("f_base")
    seeds = {"scored_seed": F.col("f_seed") & (F.col("score") > 0), "hit_seed": hit & F.col("f_seed")}
    first = {"e_fatal": (F.col("f_fatal"), "min"), "e_cause": (F.col("f_cause"), "max"), "e_saved": (F.col("f_saved"), "min"), **{f"e_{k}": (F.col(f"a_{k}"), "min") for k in ANCHORS}}
    counts = {"line": F.lit(True), "key": F.col("score") > 0, "strong": F.col("score") >= profile.strong, "errors": F.col("f_error"), "stamps": F.col("f_stamp"), "versions": F.col("f_version")}
    d = located(f, counts, {**seeds, "breaks": ~F.col("f_cont")}, first)
    anchor = reduce(lambda x, y: x | y, [F.coalesce(F.col("idx") == F.col(k), F.lit(False)) for k in first], F.col("f_version") & (F.col("versions") <= 3))
    d = d.withColumns({"p_anchor": anchor, "ends": head_tail(size), "b_score": in_block(seeds["scored_seed"], F.col("f_cont"), "scored_seed"), "b_hit": in_block(seeds["hit_seed"], F.col("f_cont"), "hit_seed")})
    near = {f"near_{s}": (F.col("score") >= s, r) for s, r in profile.radii}
    near |= {"near_hit": (hit & ~alone, min(4, max(1, window))), "near_anchor": (F.col("p_anchor"), min(12, max(1, window))), "near_error": (F.col("f_error") & (F.col("errors") <= 400), 8), "near_failure": (F.col("f_failure"), 5)}
    d = around(d, near, chunk)
    d = d.withColumns(
        {
            "s_priority": F.col("near_hit") | (hit & alone) | F.col("b_hit"),
            "s_score": reduce(lambda x, y: x | y, [F.col(f"near_{s}") for s, _ in profile.radii], F.col("ends") | F.col("b_score")),
            "s_noise": F.col("is_noise") & (F.col("score") <= 0) & ~(F.col("f_reload") & F.col("near_failure")),
            "s_focus": F.col("ends") | F.col("near_error") | (F.col("f_stamp") & (F.col("stamps") <= 240)),
            "n_lines": F.col("line_all"), "key_hits": F.col("key_all"), "strong_hits": F.col("strong_all"),
            "fallback": (F.col("key_all") <= 0) | ((F.col("line_all") >= 300) & (F.col("strong_all") <= 0)),
        }
    )
    d = d.withColumn("s_must", F.col("near_anchor") | F.col("s_priority"))
    chosen = F.when(F.col("fallback"), F.col("s_focus") | F.col("s_priority")).otherwise(F.col("s_score") | F.col("s_must"))
    return d.withColumn("selected", chosen & ~F.col("s_noise"))


def noise_stats(recs: DataFrame) -> DataFrame:
    """Lines with points, strong ones and noise of each file."""
    return recs.groupBy("file").agg(
        F.count_if(F.col("score") > 0).alias("key_hits"), F.count_if(F.col("score") >= 4).alias("strong_hits"), F.count_if((F.col("score") <= 0) & F.col("is_noise")).alias("noise")
    )


def looks_like_run_log(lines: DataFrame, file: str, idx: str, text: str, profile: SignalProfile = GAME_PROFILE) -> DataFrame:
    """whether the first 80 lines of a file look like a run log (6 points)."""
    t = F.coalesce(F.col(text), F.lit(""))
    points = F.when(profile.hit(t, "timestamp", "event_prefix"), 1).otherwise(0) + F.when(profile.hit(t, "run_hint"), 2).otherwise(0)
    return lines.where(F.col(idx) < 80).groupBy(F.col(file).alias("file")).agg(F.sum(points).alias("points")).withColumn("is_run_log", F.col("points") >= 6)


def termination(recs: DataFrame, profile: SignalProfile = GAME_PROFILE) -> DataFrame:
    """How each file ended: ``file, category, hint, last_logger, last_line, note``.
    Within a line the memory error comes before watchdog, stall and stop; the
    last line with any of them decides.  Files without a line that is neither
    empty nor noise have an empty note."""
    f = flags(recs, profile) if "f_ending" not in recs.columns else recs
    p = F.struct("raw", "body", "severity", "thread", "logger", "timestamp")
    live = (F.col("body") != "") & ~F.col("is_noise")
    g = f.groupBy("file").agg(
        F.max_by(F.col("f_ending"), F.when(F.col("f_ending").isNotNull(), F.col("idx"))).alias("category"),
        F.bool_or("f_actionable").alias("actionable"),
        F.max_by(F.struct(F.coalesce(F.nullif("logger", F.lit("")), F.nullif("thread", F.lit("")), F.lit("unknown")).alias("who"), T.format_line(p).alias("line")), F.when(live, F.col("idx"))).alias("last"),
    )
    hint = F.when(F.col("category").isNotNull(), "").when(F.col("actionable"), "；尾部无异常块，但前文已有异常/初始化失败证据，优先分析已保留的根因片段").otherwise("；尾部无异常块/崩溃报告落点，真凶大概率在独立 hs_err_pid*.log 或启动器/系统日志")
    g = g.select("file", F.coalesce("category", F.lit("无声中断")).alias("category"), hint.alias("hint"), F.col("last.who").alias("last_logger"), F.col("last.line").alias("last_line"))
    note = F.concat(F.lit("[termination] type="), "category", F.lit("; last_logger="), "last_logger", F.lit("; last_non_noise="), "last_line", "hint")
    return g.withColumn("note", F.when(F.col("last_line").isNull(), "").otherwise(note))
