"""Queries of the log, lookup, usage and evaluation operators, with their SQL.

Every query runs over its whole tables.  ``NOW`` is a fixed moment, as no
operator reads the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import report as R
from tracewright.functions import text as T
from tracewright.functions.profile import GAME, GAME_PROFILE
from tracewright.operators import compose, evaluate, lookup, selection, usage
from tracewright.session import table
from tracewright.sources import files

NOW = 1746000000.0


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all logs; repeated deliveries once."""
    return table(spark, sf_dir, "parsed_log_line").select(F.col("log_id").alias("file"), F.col("line_idx").alias("idx"), F.col("raw").alias("text")).distinct()


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.records(_lines(spark, sf_dir))


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select_lines(_records(spark, sf_dir))


def log_parse_prefix(spark, sf_dir):
    """The fields of each line's bracket prefix."""
    return _lines(spark, sf_dir).select("file", "idx", T.parse_prefix(F.col("text")).alias("p")).select("file", "idx", "p.body", "p.severity", "p.thread", "p.logger", "p.timestamp")


def log_format(spark, sf_dir):
    """Each line with a compact prefix."""
    return _lines(spark, sf_dir).select("file", "idx", T.format_line(T.parse_prefix(F.col("text"))).alias("line"))


def log_fold_keys(spark, sf_dir):
    """Fold keys and throwable signatures of each line; of the two small sigmas one, as SQL knows no final one."""
    b = T.strip_prefix(F.col("text"))
    return _lines(spark, sf_dir).select("file", "idx", F.translate(T.body_fold_key(b), "ς", "σ").alias("body_key"), T.tail_fold_key(F.col("text")).alias("tail_key"), T.throwable_signature(b).alias("signature"))


def log_score_lines(spark, sf_dir):
    """points and noise of each line."""
    return _records(spark, sf_dir).select("file", "idx", "score", "is_noise")


def log_select_windows(spark, sf_dir):
    """Head, tail and the windows around scored lines."""
    r = _records(spark, sf_dir).select("file", "idx", "score")
    return selection.line_windows(r, {f"near_{n}": (F.col("score") >= s, n) for s, n in GAME_PROFILE.radii}, 180).drop("score")


def log_block_runs(spark, sf_dir):
    """Stack-trace blocks."""
    r = selection.flags(_records(spark, sf_dir)).select("file", "idx", "f_seed", "f_cont")
    return selection.block_runs(r, F.col("f_seed"), F.col("f_cont")).select("file", "idx", "in_block")


def log_error_windows_capped(spark, sf_dir):
    """Windows around the first 300 error lines."""
    return selection.error_windows(_records(spark, sf_dir).select("file", "idx", "raw"), 8, 300).select("file", "idx", "near_error")


def log_must_keep(spark, sf_dir):
    """Anchors with their windows, priority evidence, noise."""
    return _selected(spark, sf_dir).select("file", "idx", "p_anchor", "s_must", "s_priority", "s_noise")


def log_first_k_signatures(spark, sf_dir):
    """The lines of the first 32 distinct throwables of each log."""
    return _selected(spark, sf_dir).where("p_keep").select("file", "idx", "f_signature")


def log_select(spark, sf_dir):
    """The lines chosen for the extract."""
    return _selected(spark, sf_dir).select("file", "idx", "s_score", "s_focus", "fallback", "selected")


def log_noise_prune(spark, sf_dir):
    """noise lines without points and without a failure near a reload."""
    r = selection.flags(_records(spark, sf_dir)).select("file", "idx", "is_noise", "score", "f_reload", "f_failure")
    return selection.pruned_noise(r).select("file", "idx", "pruned")


def log_fold_groups(spark, sf_dir):
    """Runs of lines that differ in their timestamp only."""
    r = _records(spark, sf_dir)
    k = r.withColumns({"mode": F.lit("tail"), "key": T.tail_fold_key(F.col("raw")), "out": F.col("raw")})
    return compose.fold_groups(k)


def log_compose(spark, sf_dir):
    """Error windows with gap markers, one text a log."""
    return compose.compose_lines(selection.error_windows(_records(spark, sf_dir), 8, 300), F.col("near_error"))


def log_budget_extract(spark, sf_dir):
    """Evidence extracts of at most 6000 characters."""
    return compose.extract_c(_records(spark, sf_dir), limit=6000)


def log_extract(spark, sf_dir):
    """W15 with the usual budget."""
    return compose.extract_c(_records(spark, sf_dir))


def log_extract_b(spark, sf_dir):
    """Strategy B: whole short logs, ends and error windows of long ones."""
    return compose.extract_b(_records(spark, sf_dir))


def log_error_focused(spark, sf_dir):
    """The error-focused text of each log."""
    return compose.error_focused(_records(spark, sf_dir))


def log_sections_a(spark, sf_dir):
    """The labelled sections of crash reports, from the gold texts."""
    g = table(spark, sf_dir, "strategy_c_gold_cases").select("case_id", "text").distinct()
    lines = g.select(F.col("case_id").alias("file"), F.posexplode(T.lines_of(F.col("text"))).alias("idx", "raw"))
    return compose.sections_a(lines, "crash")


def log_termination(spark, sf_dir):
    """How each log ended."""
    return selection.termination(_records(spark, sf_dir))


def log_stats(spark, sf_dir):
    """Points and noise of each log."""
    return selection.noise_stats(_records(spark, sf_dir))


def log_fallback_flag(spark, sf_dir):
    """F8: logs whose extract falls back to the error focus."""
    s = selection.noise_stats(_records(spark, sf_dir)).join(_lines(spark, sf_dir).groupBy("file").agg(F.count(F.lit(1)).alias("n_lines")), "file")
    return s.select("file", ((F.col("key_hits") <= 0) | ((F.col("n_lines") >= 300) & (F.col("strong_hits") <= 0))).alias("fallback"))


def log_is_run_log(spark, sf_dir):
    """whether the first 80 lines look like a run log."""
    return selection.looks_like_run_log(_lines(spark, sf_dir), "file", "idx", "text")


def log_redact(spark, sf_dir):
    """Each line without paths, addresses and secrets."""
    return _lines(spark, sf_dir).select("file", "idx", T.redact(T.redact_extract(F.col("text"))).alias("line"))


def strategy_route(spark, sf_dir):
    """What each run's source name calls for."""
    r = table(spark, sf_dir, "run_report").select("run_id", "source_name").distinct()
    return r.select("run_id", T.name_strategy(F.col("source_name")).alias("strategy"), files.route(F.col("source_name")).alias("route"), T.sanitize_name(F.col("source_name")).alias("safe_name"))


def priority_file_pick(spark, sf_dir):
    """The file to read first among those of a session."""
    r = table(spark, sf_dir, "run_report").select(F.col("session_id").alias("archive"), F.col("source_name").alias("name"), F.col("log_id").alias("ord")).distinct()
    chars = _lines(spark, sf_dir).groupBy(F.col("file").alias("ord")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1).alias("chars"))
    r = r.join(chars, "ord", "left").withColumn("chars", F.coalesce("chars", F.lit(0)))
    return lookup.priority_file(r.where("archive is not null and name is not null")).select("archive", "name", "ord", "group")


def archive_display_names(spark, sf_dir):
    """Distinct display names of a session's files."""
    r = table(spark, sf_dir, "run_report").select(F.col("session_id").alias("archive"), F.col("source_name").alias("display"), F.col("log_id").alias("ord")).distinct()
    return lookup.display_names(r)


def doc_lines(spark, sf_dir):
    """The lines of each document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines_of(F.col("text"))).alias("pos", "line"))


def doc_report_metrics(spark, sf_dir):
    """Metrics of each report and what makes an answer suspect."""
    m = T.report_metrics(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", m["claim_type"].alias("claim"), m["needs_more_info"].alias("needs_more_info"), m["root_cause_stability_key"].alias("stability_key"), T.suspect_output(F.col("text")).alias("suspect"))


def doc_report_sections(spark, sf_dir):
    """Reports brought to their four sections."""
    return R.normalize_report(table(spark, sf_dir, "documents").where("text is not null"), "doc_id")


def doc_code_blocks(spark, sf_dir):
    """The fenced blocks of each document and their message."""
    b = T.code_blocks(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(b).alias("blocks"), F.length(R.code_message(b)).alias("message_chars")).where("blocks > 0")


def doc_instruction_lines(spark, sf_dir):
    """Lines that look like instructions."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.instruction_lines(F.col("text"))).alias("line")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def doc_exact_dedupe(spark, sf_dir):
    """The first document of each text."""
    d = table(spark, sf_dir, "documents").where("text is not null").withColumn("digest", F.sha2("text", 256))
    return lookup.first_per_key(d.select("doc_id", "digest"), "digest", "doc_id")


def changelog_keys(spark, sf_dir):
    """Canonical forms of each release note's fields."""
    c = table(spark, sf_dir, "changelog_item").select("item_id", "project_slug", "version_number", "name", "changelog", "loaders").distinct()
    return c.select(
        "item_id", T.title_signature(F.col("name")).alias("title_key"), T.slug(F.col("project_slug")).alias("slug"), F.array_join(F.array_sort(T.version_tokens(F.array("version_number"))), " ").alias("tokens"),
        F.array_join(F.transform(F.coalesce("loaders", F.array().cast("array<string>")), T.normalize_loader), " ").alias("loaders"), F.length(T.clean_text(F.col("changelog"), 3000)).alias("chars"), T.only_generic(F.col("changelog")).alias("generic"),
    )


def changelog_urls(spark, sf_dir):
    """Canonical addresses and repositories of release notes."""
    c = table(spark, sf_dir, "changelog_item").select("item_id", "url").distinct()
    return c.select("item_id", T.canonical_url(F.col("url")).alias("url_key"), T.repository_of(F.col("url")).alias("repository"))


def changelog_first_per_url(spark, sf_dir):
    """The first note of each address."""
    c = table(spark, sf_dir, "changelog_item").where("url is not null").select("item_id", "url").distinct()
    return lookup.first_per_key(c, "url", "item_id")


def search_greedy_dedupe(spark, sf_dir):
    """Notes of one version kept across sources."""
    c = table(spark, sf_dir, "changelog_item").select("item_id", "project_id", "version_number", "source", "url", "name").distinct().where("project_id is not null and version_number is not null")
    q = F.concat_ws("@", "project_id", "version_number")
    rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy("source"))
    items = c.select(q.alias("query_id"), F.coalesce("source", F.lit("")).alias("source"), F.col("item_id").alias("pos"), T.canonical_url(F.col("url")).alias("url_key"), T.title_signature(F.col("name")).alias("title_key")).withColumn("source_rank", rank)
    return lookup.dedupe_stats(items, lookup.greedy_dedupe(items))


def newest_changelogs(spark, sf_dir):
    """L2: the 8 newest notes with a text of each project, by version id where the date can't be read."""
    c = table(spark, sf_dir, "changelog_item").select("item_id", "project_id", "date_published", "changelog").distinct().where("trim(changelog) <> '' and project_id is not null")
    return lookup.top_per_key(c.withColumn("at", T.parse_time(F.col("date_published"))), "project_id", 8, F.desc("at"), "item_id").select("project_id", "item_id", "rank")


def newer_than_anchor_topk(spark, sf_dir):
    """Per customer the 8 newest orders after the first."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    first = lookup.first_per_key(o, "o_custkey", "o_orderdate", "o_orderkey")
    return lookup.newer_than(o, first, "o_custkey", "o_orderdate", "o_orderkey", 8)


def path_resolution_tiers(spark, sf_dir):
    """Requests by path, by path and by base name in other letters, by the end of a path and for absent files."""
    c = table(spark, sf_dir, "changelog_item").where("project_id is not null and version_number is not null and source is not null")
    f = c.select(F.col("project_id").alias("archive"), F.concat_ws("/", "source", F.concat("version_number", F.lit(".jar"))).alias("path")).distinct()
    f = f.select("archive", F.concat(F.lit("mods/"), "path").alias("path"))
    wishes = F.array("path", F.upper("path"), F.upper(F.regexp_extract("path", r"([^/]*)$", 1)), F.regexp_extract("path", r"^[^/]*/(.*)$", 1), F.concat("path", F.lit("x")))
    return lookup.resolve_paths(f.select("archive", F.explode(wishes).alias("requested")).distinct(), f)


def usage_windows(spark, sf_dir):
    """A1, T4: usage totals of the records kept for 90 days."""
    r = table(spark, sf_dir, "mc_log_token_stats").distinct()
    return usage.usage_totals(usage.retained(r, NOW), NOW)


def usage_by_user(spark, sf_dir):
    """A2: the 20 greatest users."""
    return usage.usage_by(table(spark, sf_dir, "mc_log_token_stats").distinct(), "uid")


def usage_by_session(spark, sf_dir):
    """A2: all sessions by usage."""
    return usage.usage_by(table(spark, sf_dir, "mc_log_token_stats").distinct(), "session_id", None)


def rate_limit_accept(spark, sf_dir):
    """Events accepted at one per user and 6 hours."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("user"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return usage.accept_rate(e, "user", "at", 6 * 3600.0).select("event_id", "accepted")


def cache_live_entries(spark, sf_dir):
    """The 10 newest entries of each sender of the last 90 days."""
    r = table(spark, sf_dir, "run_report").distinct().where("sender_id is not null").withColumn("at", F.unix_micros(F.col("run_ts").cast("timestamp")) / 1e6)
    return usage.live_entries(r, "sender_id", "at", NOW, 90 * 86400.0, 10, "run_id").select("sender_id", "run_id", "rank")


def cache_has_recent(spark, sf_dir):
    """Senders with a run of the last 30 days."""
    r = table(spark, sf_dir, "run_report").where("sender_id is not null").withColumn("at", F.unix_micros(F.col("run_ts").cast("timestamp")) / 1e6)
    return usage.has_recent(r, "sender_id", "at", NOW, 30 * 86400.0)


def session_filter_block(spark, sf_dir):
    """runs of sessions that no retry was recorded for."""
    listed = table(spark, sf_dir, "mc_log_token_stats").where("source = 'retry' and session_id is not null").select(F.col("session_id").alias("session")).distinct()
    r = table(spark, sf_dir, "run_report").distinct().select("run_id", "log_id", F.array("session_id").alias("c"))
    return usage.filter_sessions(r, "c", listed, "blacklist").select("run_id", "log_id")


def session_filter_allow(spark, sf_dir):
    """runs of sessions that a retry was recorded for."""
    listed = table(spark, sf_dir, "mc_log_token_stats").where("source = 'retry' and session_id is not null").select(F.col("session_id").alias("session")).distinct()
    r = table(spark, sf_dir, "run_report").distinct().select("run_id", "log_id", F.array("session_id").alias("c"))
    return usage.filter_sessions(r, "c", listed, "whitelist").select("run_id", "log_id")


def evidence_lookup(spark, sf_dir):
    """The notes that each project's judgement cites."""
    c = table(spark, sf_dir, "changelog_item").where("evidence_id is not null")
    notes = c.groupBy(F.concat_ws("/", "project_id", "evidence_id").alias("evidence_id")).agg(F.min_by(F.struct("source", "version_number", "url", "changelog"), "item_id").alias("x")).select("evidence_id", "x.*")
    j = notes.groupBy(F.substring_index("evidence_id", "/", 1).alias("judgement_id")).agg(F.array_sort(F.collect_set("evidence_id")).alias("e"))
    # Every note of the project is cited, and unknown ones before and after them.
    j = j.select("judgement_id", F.transform(F.concat(F.array(F.lit("none/1")), "e", F.array(F.lit("none/2"))), lambda e: F.struct(e.alias("evidence_id"), F.lit("cited").alias("quote"))).alias("evidence"))
    return lookup.cite_evidence(j, notes).select("judgement_id", "pos", "evidence_id", "generic")


def _evaluated(spark, sf_dir):
    g = table(spark, sf_dir, "strategy_c_gold_cases").distinct()
    return evaluate.evaluate(g, F.col("text"))


def eval_recall(spark, sf_dir):
    """Recalls of each gold case in its own text."""
    m = ("root_recall", "support_recall", "signature_recall", "culprit_recall", "noise_leak")
    return _evaluated(spark, sf_dir).select("case_id", *[F.round(c, 9).alias(c) for c in m], "success")


def eval_macro_grouped(spark, sf_dir):
    """Macro means over all cases, by loader and by kind."""
    return evaluate.summarize(_evaluated(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        log_parse_prefix, log_format, log_fold_keys, log_score_lines, log_select_windows, log_block_runs, log_error_windows_capped, log_must_keep, log_first_k_signatures, log_select, log_noise_prune,
        log_fold_groups, log_compose, log_budget_extract, log_extract, log_extract_b, log_error_focused, log_sections_a, log_termination, log_stats, log_fallback_flag, log_is_run_log, log_redact,
        strategy_route, priority_file_pick, archive_display_names, doc_lines, doc_report_metrics, doc_report_sections, doc_code_blocks, doc_instruction_lines, doc_exact_dedupe, changelog_keys, changelog_urls,
        changelog_first_per_url, search_greedy_dedupe, newest_changelogs, newer_than_anchor_topk, path_resolution_tiers, usage_windows, usage_by_user, usage_by_session, rate_limit_accept, cache_live_entries,
        cache_has_recent, session_filter_block, session_filter_allow, evidence_lookup, eval_recall, eval_macro_grouped,
    )
}


# ---------------------------------------------------------------- SQL

_WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _hit(col: str, *families: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, {_q('(?i)' + GAME[f].removeprefix('(?id)'))})" for f in families) + ")"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {_q(f'^{_WS}+|{_WS}+$')}, '', 'g')"


_LINES = "lines AS (SELECT DISTINCT log_id AS file, line_idx AS idx, coalesce(raw, '') AS raw FROM parsed_log_line)"
_BODY = _strip(f"regexp_replace(regexp_replace(raw, {_q(f'^{_WS}*(?:\\[[^\\]]+\\]{_WS}*)+')}, ''), '^[: ]+', '')")
_TIME = _q("(?i)" + GAME["timestamp"].removeprefix("(?id)"))
_LV = _q(T.LEVEL_TOKEN)
_PARSED = f"""{_LINES},
tokens AS (SELECT *, list_transform(regexp_extract_all(substr(raw, 1, 240), '\\[([^\\]]+)\\]', 1), lambda t: {_strip("t")}) AS tk FROM lines),
kinds AS (SELECT *, list_filter(tk, lambda t: regexp_matches('[' || t || ']', {_TIME})) AS tt,
  list_filter(tk, lambda t: regexp_matches(t, {_LV}) AND NOT regexp_matches('[' || t || ']', {_TIME})) AS lv FROM tokens),
parsed AS (SELECT file, idx, raw, {_BODY} AS body,
  CASE WHEN len(lv) > 0 THEN upper(regexp_extract(lv[-1], {_LV}, 2)) END AS severity,
  CASE WHEN len(lv) > 0 THEN regexp_extract(lv[1], {_LV}, 1) END AS thread,
  CASE WHEN len(lv) > 1 THEN regexp_extract(lv[-1], {_LV}, 1)
       WHEN len(lv) = 1 THEN list_filter(list_slice(tk, list_position(tk, lv[1]), len(tk)), lambda t: NOT regexp_matches(t, {_LV}) AND NOT regexp_matches('[' || t || ']', {_TIME}))[1] END AS logger,
  tt[-1] AS timestamp FROM kinds)"""


def _points() -> str:
    p = GAME_PROFILE
    out = ["CASE severity " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in p.severity_points) + " ELSE 0 END"]
    for n, fams, both in p.points:
        out.append(f"CASE WHEN {_hit('body', *fams)}" + (f" OR {_hit('raw', *fams)}" if both else "") + f" THEN {n} ELSE 0 END")
    hi, lo = p.evidence_points
    out.append(f"CASE WHEN {_hit('raw', 'evidence')} OR {_hit('body', 'evidence')} THEN CASE WHEN {_hit('raw', 'base_frame')} OR {_hit('body', 'base_frame')} THEN {lo} ELSE {hi} END ELSE 0 END")
    return " + ".join(out)


_SCORED = f"{_PARSED}, scored AS (SELECT *, CAST({_points()} AS INTEGER) AS score, {_hit('body', 'noise')} AS is_noise FROM parsed)"
_W = "(PARTITION BY file ORDER BY idx ROWS BETWEEN {} AND {})"


def _near(x: str, r: int) -> str:
    return f"bool_or({x}) OVER " + _W.format(f"{r} PRECEDING", f"{r} FOLLOWING")


_ALL_TO = _W.format("UNBOUNDED PRECEDING", "CURRENT ROW")
_ALL_BEFORE = _W.format("UNBOUNDED PRECEDING", "1 PRECEDING")


def _block(seed: str, cont: str) -> str:
    return f"({seed} OR coalesce({cont} AND max(CASE WHEN {seed} THEN idx END) OVER {_ALL_BEFORE} >= coalesce(max(CASE WHEN NOT {cont} THEN idx END) OVER {_ALL_TO}, -1), false))"


_FLAGS = f"""{_SCORED}, flagged AS (SELECT *, {_hit("body", "block_seed")} AS seed,
  body <> '' AND {_hit("body", "continuation", "class_loading", "dependency_detail", "datapack_failure", "shader_failure")} AS cont,
  {_hit("body", "reload_noise")} AS reload, {_hit("body", "datapack_failure", "shader_failure")} AS failure, {_hit("raw", "error_line")} AS err FROM scored)"""
_ENDING = "CASE " + " ".join(f"WHEN {_hit('raw', f)} OR {_hit('body', f)} THEN '{n}'" for f, n in (("oom", "OOM"), ("watchdog", "watchdog卡死"), ("tick_stall", "tick卡死"))) + f" WHEN {_hit('body', 'ordered_stop')} THEN '有序关闭' END"
_ERRORS = f"errors AS (SELECT *, err AND sum(CASE WHEN err THEN 1 ELSE 0 END) OVER {_ALL_TO} <= 300 AS first_err FROM flagged), near_errors AS (SELECT *, {_near('first_err', 8)} AS near_error FROM errors)"
_TAIL_KEY = _strip(f"regexp_replace(raw, {_TIME}, '')")
_THREAD = _strip("thread")
_FORMAT = f"""CASE WHEN severity IS NULL THEN raw ELSE '[' || concat_ws('/', CASE WHEN {_THREAD} <> '' AND lower({_THREAD}) NOT IN ('main', 'render thread') THEN {_THREAD} END, concat_ws(' ', severity, logger)) || ']: ' || body END"""
_USAGE = "u AS (SELECT DISTINCT * FROM mc_log_token_stats), a AS (SELECT coalesce(ts, 0) AS ts, uid, session_id, coalesce(input, 0) AS input, coalesce(output, 0) AS output FROM u)"


def _span(name: str, cond: str) -> str:
    return ", ".join(f"CAST(coalesce(sum(CASE WHEN {cond} THEN {x} END), 0) AS BIGINT) AS {name}_{x}" for x in ("input", "output"))


def _by(key: str, limit: str = "") -> str:
    return f"WITH {_USAGE} SELECT {key}, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, min(ts) AS first_seen, CAST(sum(input + output) AS BIGINT) AS sum FROM a WHERE coalesce({key}, '') <> '' GROUP BY {key} ORDER BY sum DESC, first_seen, {key} {limit}"


def _recall(items: str, empty: str, cond: str) -> str:
    return f"round(CASE WHEN len(coalesce({items}, [])) = 0 THEN {empty} ELSE len(list_filter({items}, lambda p: {cond})) / len({items})::DOUBLE END, 9)"


_YESTERDAY = NOW - ((int(NOW) % 86400) + 86400)
_CASES = f"""cases AS (SELECT DISTINCT * FROM strategy_c_gold_cases),
ev AS (SELECT *, {_recall("gold_root_regexes", "1.0", "regexp_matches(text, '(?im)' || p)")} AS root_recall, {_recall("gold_support_regexes", "1.0", "regexp_matches(text, '(?im)' || p)")} AS support_recall,
  {_recall("gold_signature_regexes", "1.0", "regexp_matches(text, '(?im)' || p)")} AS signature_recall, {_recall("culprit_ids", "1.0", "contains(lower(text), lower(p))")} AS culprit_recall,
  {_recall("forbidden_noise_regexes", "0.0", "regexp_matches(text, '(?im)' || p)")} AS noise_leak FROM cases),
evs AS (SELECT *, root_recall = 1 AND signature_recall = 1 AND culprit_recall = 1 AND noise_leak <= 0.25 AS success FROM ev)"""
_MEANS = ", ".join(f"round(avg({c}), 9) AS {c}" for c in ("root_recall", "support_recall", "signature_recall", "culprit_recall", "noise_leak")) + ", round(avg(CAST(success AS DOUBLE)), 9) AS success_rate, count(*) AS cases"
_ROUTES = """CASE WHEN n LIKE '%hs_err%' OR n LIKE '%crash%' THEN 'A' WHEN regexp_matches(n, 'latest|fcl|pcl|game[-_ ]?output|run[-_ ]?output|崩溃前|游戏崩溃') THEN 'C'
  WHEN regexp_matches(n, '\\bdebug\\b|日志|log') THEN 'B' ELSE 'C' END"""

SQL = {
    "log_parse_prefix": f"WITH {_PARSED} SELECT file, idx, body, severity, thread, logger, timestamp FROM parsed",
    "log_format": f"WITH {_PARSED} SELECT file, idx, {_FORMAT} AS line FROM parsed",
    "log_score_lines": f"WITH {_SCORED} SELECT file, idx, score, is_noise FROM scored",
    "log_select_windows": f"""WITH {_SCORED}, n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY idx) AS rn, count(*) OVER (PARTITION BY file) AS c FROM scored)
      SELECT file, idx, rn <= 180 OR c - rn < 180 AS ends, {", ".join(f"{_near(f'score >= {s}', r)} AS near_{r}" for s, r in GAME_PROFILE.radii)} FROM n""",
    "log_block_runs": f"WITH {_FLAGS} SELECT file, idx, {_block('seed', 'cont')} AS in_block FROM flagged",
    "log_error_windows_capped": f"WITH {_FLAGS}, {_ERRORS} SELECT file, idx, near_error FROM near_errors",
    "log_noise_prune": f"WITH {_FLAGS} SELECT file, idx, is_noise AND score <= 0 AND NOT (reload AND {_near('failure', 5)}) AS pruned FROM flagged",
    "log_fold_groups": f"""WITH {_LINES}, k AS (SELECT *, {_TAIL_KEY} AS key FROM lines),
      s AS (SELECT *, CASE WHEN lag(key) OVER w = key AND lag(idx) OVER w = idx - 1 THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY file ORDER BY idx)),
      g AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY idx) AS run FROM s)
      SELECT file, min(idx) AS start, max(idx) AS "end", arg_min(raw, idx) AS text, count(*) AS repeat_count, '{compose.TAIL}' AS repeat_label FROM g GROUP BY file, run""",
    "log_compose": f"""WITH {_FLAGS}, {_ERRORS}, p AS (SELECT file, idx, {_FORMAT} AS line FROM near_errors WHERE near_error),
      m AS (SELECT *, CASE WHEN coalesce(lag(idx) OVER (PARTITION BY file ORDER BY idx), -2) <> idx - 1 THEN '{T.GAP}' || chr(10) ELSE '' END || line AS part FROM p)
      SELECT file, {_strip("string_agg(part, chr(10) ORDER BY idx)")} AS body FROM m GROUP BY file""",
    "log_stats": f"WITH {_SCORED} SELECT file, count(*) FILTER (score > 0) AS key_hits, count(*) FILTER (score >= 4) AS strong_hits, count(*) FILTER (score <= 0 AND is_noise) AS noise FROM scored GROUP BY file",
    "log_fallback_flag": f"WITH {_SCORED} SELECT file, count(*) FILTER (score > 0) <= 0 OR (count(*) >= 300 AND count(*) FILTER (score >= 4) <= 0) AS fallback FROM scored GROUP BY file",
    "log_termination": f"""WITH {_SCORED}, e AS (SELECT *, {_ENDING} AS ending, {_hit("body", "fatal", "class_loading", "diagnostic", "dependency_header", "dependency_detail", "evidence")} OR {_hit("raw", "fatal", "evidence")} AS actionable, {_FORMAT} AS line FROM scored),
      g AS (SELECT file, arg_max(ending, idx) FILTER (ending IS NOT NULL) AS cat, bool_or(actionable) AS act,
        arg_max(coalesce(nullif(logger, ''), nullif(thread, ''), 'unknown'), idx) FILTER (body <> '' AND NOT is_noise) AS last_logger, arg_max(line, idx) FILTER (body <> '' AND NOT is_noise) AS last_line FROM e GROUP BY file),
      h AS (SELECT file, coalesce(cat, '无声中断') AS category, CASE WHEN cat IS NOT NULL THEN '' WHEN act THEN '；尾部无异常块，但前文已有异常/初始化失败证据，优先分析已保留的根因片段' ELSE '；尾部无异常块/崩溃报告落点，真凶大概率在独立 hs_err_pid*.log 或启动器/系统日志' END AS hint, last_logger, last_line FROM g)
      SELECT file, category, hint, last_logger, last_line, CASE WHEN last_line IS NULL THEN '' ELSE '[termination] type=' || category || '; last_logger=' || last_logger || '; last_non_noise=' || last_line || hint END AS note FROM h""",
    "log_is_run_log": f"""WITH {_LINES}, p AS (SELECT file, CAST(sum(CASE WHEN {_hit("raw", "timestamp", "event_prefix")} THEN 1 ELSE 0 END + CASE WHEN {_hit("raw", "run_hint")} THEN 2 ELSE 0 END) AS BIGINT) AS points FROM lines WHERE idx < 80 GROUP BY file)
      SELECT file, points, points >= 6 AS is_run_log FROM p""",
    "strategy_route": f"""WITH r AS (SELECT DISTINCT run_id, source_name, lower(coalesce(source_name, '')) AS n FROM run_report)
      SELECT run_id, {_ROUTES} AS strategy, CASE WHEN regexp_matches(n, '.\\.(zip|gz)$') AND regexp_matches(n, '错误报告|clash|crash|日志|log') THEN 'archive'
        WHEN regexp_matches(n, '.\\.(txt|log)$') AND regexp_matches(n, 'crash|hs_err|latest|debug|fcl|pcl|游戏崩溃|日志|log') THEN 'text' END AS route,
        regexp_replace(CASE WHEN coalesce(source_name, '') = '' THEN 'upload.log' ELSE source_name END, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}\\-.]', '_', 'g') AS safe_name FROM r""",
    "priority_file_pick": """WITH r AS (SELECT DISTINCT session_id AS archive, source_name AS name, log_id AS ord, lower(source_name) AS n FROM run_report WHERE session_id IS NOT NULL AND source_name IS NOT NULL),
      c AS (SELECT log_id AS ord, sum(length(coalesce(raw, '')) + 1) AS chars FROM (SELECT DISTINCT log_id, line_idx, raw FROM parsed_log_line) GROUP BY log_id),
      g AS (SELECT *, CASE WHEN n LIKE '%hs_err%' THEN 0 WHEN n LIKE '%crash%' THEN 1 WHEN n LIKE '%latest%' OR n LIKE '%游戏崩溃%' THEN 2 WHEN n LIKE '%日志%' THEN 3 WHEN n LIKE '%log%' THEN 4 WHEN n LIKE '%debug%' THEN 5 WHEN n LIKE '%fcl%' THEN 6 WHEN n LIKE '%pcl%' THEN 7 END AS "group",
        CASE WHEN n LIKE '%latest%' THEN 6 ELSE 4 END AS l FROM r)
      SELECT archive, name, ord, "group" FROM (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY "group", coalesce(chars, 0) DESC, CASE "group" WHEN 2 THEN l ELSE 0 END DESC, ord) AS rn FROM g LEFT JOIN c USING (ord) WHERE "group" IS NOT NULL) WHERE rn = 1""",
    "archive_display_names": """WITH r AS (SELECT DISTINCT session_id AS archive, source_name AS display, log_id AS ord FROM run_report), n AS (SELECT *, row_number() OVER (PARTITION BY archive, display ORDER BY ord) AS k FROM r)
      SELECT archive, CASE WHEN k > 1 THEN display || ' [' || k || ']' ELSE display END AS display, ord FROM n""",
    "doc_lines": """WITH s AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS p FROM documents),
      t AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM s) SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS pos, unnest(p) AS line FROM t""",
    "doc_exact_dedupe": "SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)",
    "doc_instruction_lines": f"""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS line FROM documents)
      SELECT doc_id, least(count(*), 5) AS n FROM s WHERE regexp_matches(line, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:download|install|run|execute|delete|format|rm)(?:[^\\p{{L}}\\p{{N}}_]|$)') OR regexp_matches(line, '{T.INSTRUCTIONS[1]}') GROUP BY doc_id""",
    "changelog_first_per_url": "SELECT min(item_id) AS item_id, url FROM changelog_item WHERE url IS NOT NULL GROUP BY url",
    "newer_than_anchor_topk": """WITH f AS (SELECT o_custkey, min((o_orderdate, o_orderkey)) AS m FROM orders GROUP BY o_custkey), j AS (SELECT o.* FROM (SELECT o_custkey, o_orderkey, o_orderdate FROM orders) o JOIN f USING (o_custkey) WHERE o_orderdate > m[1] AND o_orderkey <> m[2]),
      r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM j) SELECT o_custkey, o_orderkey, o_orderdate, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""",
    "path_resolution_tiers": """WITH f AS (SELECT DISTINCT project_id AS archive, 'mods/' || source || '/' || version_number || '.jar' AS path FROM changelog_item WHERE project_id IS NOT NULL AND version_number IS NOT NULL AND source IS NOT NULL),
      n AS (SELECT *, lower(regexp_extract(path, '([^/]*)$', 1)) AS name FROM f), r AS (SELECT DISTINCT archive, unnest([path, upper(path), upper(regexp_extract(path, '([^/]*)$', 1)), substr(path, 6), path || 'x']) AS requested FROM f),
      g AS (SELECT r.archive, r.requested, count(path) FILTER (path = requested) AS n1, count(path) FILTER (lower(path) = lower(requested)) AS n2, count(path) AS n3, count(path) FILTER (ends_with(lower(path), '/' || lower(requested))) AS n4,
        min(path) FILTER (path = requested) AS p1, min(path) FILTER (lower(path) = lower(requested)) AS p2, min(path) AS p3 FROM r LEFT JOIN n ON n.archive = r.archive AND n.name = lower(regexp_extract(r.requested, '([^/]*)$', 1)) GROUP BY ALL),
      t AS (SELECT *, CASE WHEN n1 > 0 THEN p1 WHEN n2 = 1 THEN p2 WHEN n3 = 1 THEN p3 END AS pick FROM g)
      SELECT archive, requested, pick AS path, CASE WHEN pick IS NULL THEN 0 WHEN n1 > 0 THEN 1 WHEN n2 = 1 THEN 2 ELSE 3 END AS tier, greatest(n3, n4) AS candidates, CASE WHEN pick IS NOT NULL THEN 'found' WHEN n3 > 1 OR n4 > 1 THEN 'ambiguous' ELSE 'missing' END AS status FROM t""",
    "usage_windows": f"""WITH {_USAGE}, k AS (SELECT * FROM a WHERE ts >= {NOW - 90 * 86400}) SELECT {_span("total", "true")}, {_span("month", f"ts >= {NOW - 30 * 86400}")}, {_span("yesterday", f"ts >= {_YESTERDAY} AND ts < {_YESTERDAY + 86400}")},
      {_span("six_hour", f"ts >= {NOW - 6 * 3600}")}, count(*) AS record_count FROM k""",
    "usage_by_user": _by("uid", "LIMIT 20"),
    "usage_by_session": _by("session_id"),
    "rate_limit_accept": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
      w(user_id, rn, event_id, last, accepted) AS (SELECT user_id, rn, event_id, t, true FROM e WHERE rn = 1 UNION ALL
        SELECT e.user_id, e.rn, e.event_id, CASE WHEN e.t - w.last >= 21600 THEN e.t ELSE w.last END, e.t - w.last >= 21600 FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
      SELECT event_id, accepted FROM w""",
    "cache_live_entries": f"""WITH r AS (SELECT DISTINCT * FROM run_report WHERE sender_id IS NOT NULL), l AS (SELECT *, epoch_us(run_ts) / 1e6 AS stored FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY sender_id ORDER BY stored DESC, run_id DESC) AS rank FROM l WHERE {NOW} - stored <= {90 * 86400.0})
      SELECT sender_id, run_id, CAST(rank AS INTEGER) AS rank FROM n WHERE rank <= 10""",
    "cache_has_recent": f"SELECT sender_id, {NOW} - max(epoch_us(run_ts) / 1e6) <= {30 * 86400.0} AS recent FROM run_report WHERE sender_id IS NOT NULL GROUP BY sender_id",
    "session_filter_block": "SELECT DISTINCT run_id, log_id FROM run_report WHERE session_id IS NULL OR session_id NOT IN (SELECT session_id FROM mc_log_token_stats WHERE source = 'retry' AND session_id IS NOT NULL)",
    "session_filter_allow": "SELECT DISTINCT run_id, log_id FROM run_report WHERE session_id IN (SELECT session_id FROM mc_log_token_stats WHERE source = 'retry' AND session_id IS NOT NULL)",
    "eval_recall": f"WITH {_CASES} SELECT case_id, root_recall, support_recall, signature_recall, culprit_recall, noise_leak, success FROM evs",
    "eval_macro_grouped": f"""WITH {_CASES} SELECT 'all' AS scope, NULL::VARCHAR AS value, {_MEANS} FROM evs UNION ALL SELECT 'loader', loader, {_MEANS} FROM evs GROUP BY loader UNION ALL SELECT 'kind', kind, {_MEANS} FROM evs GROUP BY kind""",
}

# ---------------------------------------------------------------- SQL of the whole selection

_ANCHOR_SQL = ", ".join(f"{_hit('body', k)} AS a_{k}" for k in selection.ANCHORS)
_ALL_FLAGS = f"""{_FLAGS}, f1 AS (SELECT *, {_hit("body", "evidence")} OR {_hit("raw", "evidence")} AS ev, {_hit("body", "base_frame")} AS base, coalesce(severity IN ('ERROR', 'FATAL'), false) AS fatal_sev, {_hit("body", "cause")} AS cause,
    {_hit("raw", "version")} OR {_hit("body", "version")} AS ver, {_hit("body", "crash_saved")} AS saved, {_hit("raw", "timestamp")} AS stamped, {_ANCHOR_SQL},
    regexp_extract(body, '((?:[A-Za-z_$][A-Za-z0-9_$]*\\.)*[A-Za-z_$][A-Za-z0-9_$]*(?:Exception|Error|Throwable|LinkageError))(?::\\s*([^\\r\\n]+))?', 0) AS sig FROM flagged),
  f2 AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY idx) AS rn, count(*) OVER (PARTITION BY file) AS n_lines, count(*) FILTER (score > 0) OVER (PARTITION BY file) AS key_hits, count(*) FILTER (score >= 4) OVER (PARTITION BY file) AS strong_hits FROM f1)"""
_AT = " OR ".join(["idx = min(CASE WHEN fatal_sev THEN idx END) OVER (PARTITION BY file)", "idx = max(CASE WHEN cause THEN idx END) OVER (PARTITION BY file)", "idx = min(CASE WHEN saved THEN idx END) OVER (PARTITION BY file)"] + [f"idx = min(CASE WHEN a_{k} THEN idx END) OVER (PARTITION BY file)" for k in selection.ANCHORS])
_SELECT = f"""{_ALL_FLAGS}, f3 AS (SELECT *, coalesce({_AT}, false) OR (ver AND sum(CASE WHEN ver THEN 1 ELSE 0 END) OVER {_ALL_TO} <= 3) AS anchor, rn <= 180 OR n_lines - rn < 180 AS ends,
    err AND sum(CASE WHEN err THEN 1 ELSE 0 END) OVER {_ALL_TO} <= 400 AS err400, stamped AND sum(CASE WHEN stamped THEN 1 ELSE 0 END) OVER {_ALL_TO} <= 240 AS stamp240, seed AND score > 0 AS seed_scored FROM f2),
  f4 AS (SELECT *, {" OR ".join(["ends", _block("seed_scored", "cont"), *(_near(f"score >= {k}", r) for k, r in GAME_PROFILE.radii)])} AS s_score, ends OR {_near("err400", 8)} OR stamp240 AS s_focus, {_near("anchor", 12)} AS near_anchor,
    is_noise AND score <= 0 AND NOT (reload AND {_near("failure", 5)}) AS s_noise, key_hits <= 0 OR (n_lines >= 300 AND strong_hits <= 0) AS fallback FROM f3)"""
SQL |= {
    "log_error_focused": f"""WITH {_SELECT}, p AS (SELECT file, idx, {_FORMAT} AS line FROM f4 WHERE s_focus), m AS (SELECT *, CASE WHEN coalesce(lag(idx) OVER (PARTITION BY file ORDER BY idx), -2) <> idx - 1 THEN '...[中间内容已省略]...' || chr(10) ELSE '' END || line AS part FROM p)
      SELECT file, {_strip("string_agg(part, chr(10) ORDER BY idx)")} AS body FROM m GROUP BY file""",
    "log_extract_b": f"""WITH {_ALL_FLAGS}, e AS (SELECT *, err AND sum(CASE WHEN err THEN 1 ELSE 0 END) OVER {_ALL_TO} <= 300 AS e3 FROM f2), k AS (SELECT *, n_lines <= 1000 OR rn <= 500 OR n_lines - rn < 500 OR {_near("e3", 8)} AS take FROM e),
      p AS (SELECT file, idx, {_FORMAT} AS line FROM k WHERE take), m AS (SELECT *, CASE WHEN coalesce(lag(idx) OVER (PARTITION BY file ORDER BY idx), -2) <> idx - 1 THEN '...[中间内容已省略]...' || chr(10) ELSE '' END || line AS part FROM p)
      SELECT file, {_strip("string_agg(part, chr(10) ORDER BY idx)")} AS body FROM m GROUP BY file""",
    "log_sections_a": """WITH g AS (SELECT DISTINCT case_id AS file, text FROM strategy_c_gold_cases), s AS (SELECT file, regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS p FROM g),
      l AS (SELECT file, generate_subscripts(p, 1) - 1 AS idx, unnest(p) AS raw FROM (SELECT file, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM s)),
      k(section, label, pat) AS (VALUES (0, 'header/description', '(?i)Description:|---- Minecraft Crash Report ----'), (1, 'stacktrace', '(?i)Stacktrace:|Exception Details:'), (2, 'caused by chain', '(?i)Caused by:'), (3, 'suspected mods', '(?i)Suspected Mods|Mod File|Mod List'), (4, 'system details', '(?i)System Details|-- System Details --')),
      f AS (SELECT file, section, label, min(idx) AS a FROM l JOIN k ON regexp_matches(raw, pat) GROUP BY ALL)
      SELECT f.file, CAST(section AS INTEGER) AS section, label, '[' || label || ']' || chr(10) || string_agg(raw, chr(10) ORDER BY idx) AS text FROM f JOIN l ON l.file = f.file AND idx BETWEEN a AND a + 399 GROUP BY f.file, section, label""",
    "doc_report_metrics": f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (SELECT *, {_strip("regexp_extract(t, '核心问题：[ \\t\\n\\f\\r\\x0b]*(.+)', 1)")} AS claim, {_strip("t")} AS s FROM t)
      SELECT doc_id, claim, regexp_matches(t, '\\bUNCERTAIN\\b') OR (contains(t, '补充确认：') AND NOT regexp_matches(t, '补充确认：[ \\t\\n\\f\\r\\x0b]*无')) AS needs_more_info,
        substr(regexp_replace(regexp_replace({_strip("lower(claim)")}, '\\s+', ' ', 'g'), '\\b[0-9]+(\\.[0-9]+)*\\b', 'x', 'g'), 1, 120) AS stability_key,
        CASE WHEN s = '' THEN 'empty' WHEN contains(lower(s), 'candidate.content.parts') THEN 'candidate.content.parts' WHEN contains(lower(s), 'api 返回的') THEN 'api 返回的' WHEN contains(lower(s), 'chat model') THEN 'chat model' WHEN contains(lower(s), 'request error') THEN 'request error'
          WHEN contains(lower(s), 'tool_loop') THEN 'tool_loop' WHEN contains(lower(s), '模型请求失败') THEN '模型请求失败' WHEN contains(lower(s), '模型响应异常') THEN '模型响应异常' WHEN length(s) <= 120 AND (contains(s, '请稍后重试') OR contains(s, '分析失败')) THEN 'short_failure_text' ELSE '' END AS suspect FROM c""",
    "changelog_urls": r"""WITH u AS (SELECT DISTINCT item_id, url FROM changelog_item), p AS (SELECT item_id, trim(coalesce(url, '')) AS u FROM u),
      q AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS s, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h, regexp_replace(regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g'), '/+$', '') AS w,
        list_filter(string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND lower(string_split(x, '=')[1]) NOT IN ('ref', 'source', 'spm', 'fbclid', 'gclid')) AS kv FROM p)
      SELECT item_id, CASE WHEN u = '' THEN '' ELSE s || '://' || h || CASE WHEN w = '' THEN '/' ELSE w END || CASE WHEN len(kv) = 0 THEN '' ELSE '?' || array_to_string(kv, '&') END END AS url_key,
        CASE WHEN regexp_matches(u, '(?i)^[a-z]+://(www\.)?github\.com/+[^/?#\s]+/+[^/?#\s]+') THEN regexp_extract(u, '(?i)github\.com/+([^/?#\s]+)/+([^/?#\s]+)', 1) || '/' || regexp_extract(u, '(?i)github\.com/+([^/?#\s]+)/+([^/?#\s]+)', 2) ELSE '' END AS repository FROM q""",
    "changelog_keys": f"""WITH n AS (SELECT DISTINCT item_id, project_slug, version_number, name, changelog, loaders FROM changelog_item),
      v AS (SELECT *, lower({_strip("coalesce(version_number, '')")}) AS r0, regexp_replace(lower({_strip("coalesce(version_number, '')")}), '^v+', '') AS bare FROM n), c AS (SELECT *, regexp_extract(bare, '^([^+\\s]*)', 1) AS core FROM v),
      x AS (SELECT *, lower({_strip("regexp_replace(regexp_replace(coalesce(changelog, ''), '<[^>]+>', ' ', 'g'), '&amp;', '&', 'g')")}) AS plain FROM c)
      SELECT item_id, {_strip("regexp_replace(regexp_replace(regexp_replace(lower(coalesce(name, '')), '[_-]+', ' ', 'g'), '[^\\p{L}\\p{M}\\p{N}\\p{Pc} ]', ' ', 'g'), '\\s+', ' ', 'g')")} AS title_key,
        trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce(project_slug, ''))), '\\.(jar|zip)$', ''), '\\+mc[0-9]+(\\.[0-9]+)*.*$', ''), '[^a-z0-9_-]+', '-', 'g'), '-+', '-', 'g'), '-') AS slug,
        array_to_string(list_sort(list_distinct(list_filter([r0, bare, core, CASE WHEN core = '' THEN '' ELSE 'v' || core END], lambda t: length(t) >= 2))), ' ') AS tokens,
        array_to_string(list_transform(coalesce(loaders, []), lambda l: CASE lower(trim(l)) WHEN 'fabric-loader' THEN 'fabric' WHEN 'quilt-loader' THEN 'quilt' WHEN 'neo forge' THEN 'neoforge' WHEN 'neo-forge' THEN 'neoforge' ELSE lower(trim(l)) END), ' ') AS loaders,
        CAST(length(substr(regexp_replace({_strip("regexp_replace(coalesce(changelog, ''), '[\\r\\n]', ' ', 'g')")}, '{_WS}+', ' ', 'g'), 1, 3000)) AS INTEGER) AS chars,
        plain = '' OR (regexp_matches(plain, '\\b(?:bug\\s*fix(?:es)?|fix(?:es|ed)?\\s+bugs?|crash(?:es)?|compat(?:ibility)?|misc(?:ellaneous)?|various fixes|several fixes|stability improvements?)\\b|修复若干|错误修复|问题修复|崩溃修复|兼容性修复|杂项修复')
          AND NOT regexp_matches(plain, 'render thread|sodium|mixin|injection|classnotfound|noclassdef|nosuchmethod|shader|opengl|fabric loader|neoforge|forge|java 21')) AS generic FROM x""",
    "evidence_lookup": """WITH c AS (SELECT DISTINCT * FROM changelog_item WHERE evidence_id IS NOT NULL), n AS (SELECT concat_ws('/', project_id, evidence_id) AS e, arg_min(changelog, item_id) AS changelog, min(item_id) AS i FROM c GROUP BY 1),
      t AS (SELECT split_part(n.e, '/', 1) AS judgement_id, n.e AS evidence_id, lower(trim(regexp_replace(coalesce(c.changelog, ''), '<[^>]+>', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS plain FROM n JOIN c ON c.item_id = n.i),
      k AS (SELECT *, row_number() OVER (PARTITION BY judgement_id ORDER BY evidence_id) AS r FROM t)
      SELECT judgement_id, CAST(r AS INTEGER) AS pos, evidence_id, plain = '' OR (regexp_matches(plain, '\\b(?:bug\\s*fix(?:es)?|fix(?:es|ed)?\\s+bugs?|crash(?:es)?|compat(?:ibility)?|misc(?:ellaneous)?|various fixes|several fixes|stability improvements?)\\b|修复若干|错误修复|问题修复|崩溃修复|兼容性修复|杂项修复')
        AND NOT regexp_matches(plain, 'render thread|sodium|mixin|injection|classnotfound|noclassdef|nosuchmethod|shader|opengl|fabric loader|neoforge|forge|java 21')) AS generic FROM k WHERE r <= 4""",
    "search_greedy_dedupe": r"""WITH RECURSIVE n AS (SELECT DISTINCT item_id, project_id || '@' || version_number AS q, coalesce(source, '') AS source, coalesce(url, '') AS url, coalesce(name, '') AS name FROM changelog_item WHERE project_id IS NOT NULL AND version_number IS NOT NULL),
      i AS (SELECT q, source, item_id, lower(regexp_extract(url, '^([^:/]*://[^/?#]*)', 1)) || regexp_extract(url, '^[^:/]*://[^/?#]*([^?#]*)', 1) AS u,
        trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '[_-]+', ' ', 'g'), '[^\p{L}\p{M}\p{N}\p{Pc} ]', ' ', 'g'), '\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY q ORDER BY source, item_id) AS k FROM n),
      r(q, k, source, us, ts, kept) AS (SELECT q, k, source, [u], [t], true FROM i WHERE k = 1 UNION ALL
        SELECT i.q, i.k, i.source, CASE WHEN (i.u <> '' AND list_contains(us, i.u)) OR (i.t <> '' AND list_contains(ts, i.t)) THEN us ELSE list_append(us, i.u) END, CASE WHEN (i.u <> '' AND list_contains(us, i.u)) OR (i.t <> '' AND list_contains(ts, i.t)) THEN ts ELSE list_append(ts, i.t) END,
          NOT ((i.u <> '' AND list_contains(us, i.u)) OR (i.t <> '' AND list_contains(ts, i.t))) FROM r JOIN i ON i.q = r.q AND i.k = r.k + 1)
      SELECT q AS query_id, source, count(*) AS raw_count, count(*) FILTER (kept) AS kept_count, count(*) FILTER (NOT kept) AS deduped_out FROM r GROUP BY q, source""",
    "newest_changelogs": """WITH n AS (SELECT DISTINCT item_id, project_id, date_published, changelog FROM changelog_item WHERE trim(changelog) <> '' AND project_id IS NOT NULL),
      t AS (SELECT project_id, item_id, coalesce(CASE WHEN regexp_matches(trim(date_published), '^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$') THEN try_cast(trim(date_published) AS TIMESTAMPTZ) END, TIMESTAMPTZ '0001-01-01 00:00:00+00') AS moment FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY moment DESC, item_id) AS rank FROM t) SELECT project_id, item_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""",
    "doc_code_blocks": r"""WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '(?s)```[^\n`]*\n.*?```', 0), lambda b: struct_pack(lang := trim(regexp_extract(b, '^```([^\n`]*)\n', 1)), code := trim(regexp_replace(regexp_extract(b, '(?s)^```[^\n`]*\n(.*?)```$', 1), '^\n+|\n+$', '', 'g'), ''))), lambda x: trim(x.code, ' ' || chr(9) || chr(10) || chr(13)) <> '') AS b FROM documents),
      l AS (SELECT doc_id, len(b) AS blocks, list_transform(b, lambda x, i: length(chr(10) || chr(10) || '[代码块 ' || i || ']' || chr(10) || '```' || CASE WHEN x.lang = '' THEN 'text' ELSE x.lang END || chr(10) || x.code || chr(10) || '```')) AS s FROM t WHERE len(b) > 0),
      c AS (SELECT doc_id, blocks, list_transform(s, lambda v, i: list_sum(list_slice(s, 1, i))) AS runs, s FROM l)
      SELECT doc_id, CAST(blocks AS INTEGER) AS blocks, CAST(length('以下是分析结果中的代码块（便于复制）：') + coalesce(list_max(list_filter(runs, lambda v: v + length('以下是分析结果中的代码块（便于复制）：') <= 15998)), 0) AS INTEGER) AS message_chars FROM c""",
}

# The folding of values, twice over, as RE2 has no look-around: the sign before a value is taken along.
_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"
_SIDE = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}.]"


def _folded(x: str) -> str:
    for pattern, to in ((r"(?i)\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b", "<uuid>"), (r"(?i)\b0x[0-9a-f]+\b", "<id>"), (r"(?i)\b(entity id|entity|id|eid)[=: #]+-?\d+\b", r"\1=<id>")):
        x = f"regexp_replace({x}, {_q(pattern)}, '{to}', 'g')"
    for value, to in ((rf"{_NUMBER}{_WS}*,{_WS}*{_NUMBER}{_WS}*,{_WS}*{_NUMBER}", "<coords>"), (_NUMBER, "<num>")):
        # Twice, as neighbours share a side; what was read already ends before a hyphen, which is no sign then.
        for side in (_SIDE, _SIDE[:-1] + r"\x01]"):
            x = f"regexp_replace({x}, {_q(f'(^|{side}){value}($|{_SIDE})')}, '\\1' || chr(1) || '\\2', 'g')"
        x = f"replace({x}, chr(1), '{to}')"
    return f"lower({_strip(f'regexp_replace({x}, {_q(_WS + chr(43))}, {_q(chr(32))}, {_q(chr(103))})')})"


_THROWN = _q(r"((?:[A-Za-z_$][A-Za-z0-9_$]*\.)*[A-Za-z_$][A-Za-z0-9_$]*(?:Exception|Error|Throwable|LinkageError))(?::\s*([^\r\n]+))?")
_SIGNATURE = f"CASE WHEN regexp_extract(body, {_THROWN}, 1) <> '' THEN regexp_extract(body, {_THROWN}, 1) || ':' || substr({_folded(f'regexp_extract(body, {_THROWN}, 2)')}, 1, 120) END"
_PRIORITY = f"""{_SELECT}, g1 AS (SELECT *, {_SIGNATURE} AS signature FROM f4), g2 AS (SELECT *, signature IS NOT NULL AND row_number() OVER (PARTITION BY file, signature ORDER BY idx) = 1 AS p_first FROM g1),
  g3 AS (SELECT *, p_first AND sum(CASE WHEN p_first THEN 1 ELSE 0 END) OVER {_ALL_TO} <= 32 AS p_keep FROM g2), g4 AS (SELECT *, ev OR p_keep AS hit, ev AND base AS alone, (ev OR p_keep) AND seed AS seed_hit, (ev OR p_keep) AND NOT (ev AND base) AS wide FROM g3),
  g5 AS (SELECT *, {_near("wide", 4)} OR (hit AND alone) OR {_block("seed_hit", "cont")} AS s_priority FROM g4)"""
SQL |= {
    "log_fold_keys": f"WITH {_PARSED} SELECT file, idx, replace({_folded('body')}, 'ς', 'σ') AS body_key, {_TAIL_KEY} AS tail_key, {_SIGNATURE} AS signature FROM parsed",
    "log_first_k_signatures": f"WITH {_PRIORITY} SELECT file, idx, signature AS f_signature FROM g5 WHERE p_keep",
    "log_must_keep": f"WITH {_PRIORITY} SELECT file, idx, anchor AS p_anchor, near_anchor OR s_priority AS s_must, s_priority, s_noise FROM g5",
    "log_select": f"WITH {_PRIORITY} SELECT file, idx, s_score, s_focus, fallback, CASE WHEN fallback THEN s_focus OR s_priority ELSE s_score OR near_anchor OR s_priority END AND NOT s_noise AS selected FROM g5",
}
