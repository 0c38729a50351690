"""Queries of the look-up, archive, limit and text operators that the tables show
apart from logs, with their SQL, whose constants are written out here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import report as R
from tracewright.functions import text as T
from tracewright.operators import archive, lookup, selection, usage
from tracewright.plans import log_queries
from tracewright.session import table


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "changelog_item").distinct()


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parsed_log_line").select("log_id", "line_idx", F.coalesce("raw", F.lit("")).alias("raw")).distinct()


def mod_resolution(spark, sf_dir):
    """Each note's project by its id, file name or name, of those that fit its first loader and game version."""
    c = _notes(spark, sf_dir)
    mods = c.select(
        F.col("item_id").alias("mod_key"), F.get("loaders", F.lit(0)).alias("loader"), F.get("game_versions", F.lit(0)).alias("game_version"),
        F.lit(None).cast("string").alias("sha512"), F.when(F.col("item_id") % 7 == 0, F.col("version_id")).alias("sha1"), F.when(F.col("item_id") % 3 == 0, F.upper("project_slug")).alias("mod_id"),
        F.concat("project_slug", F.lit("-fabric-"), "version_number", F.lit(".jar")).alias("filename"), F.col("project_slug").alias("name"),
    )
    projects = c.where("project_id is not null and project_slug is not null").groupBy("project_id").agg(
        F.max("project_slug").alias("slug"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("loaders")))).alias("loaders"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("game_versions")))).alias("game_versions"), F.collect_set("version_id").alias("hashes")
    )
    return lookup.resolve_mods(mods, projects).select("mod_key", "project_id", "tier")


def version_anchor(spark, sf_dir):
    """The anchor version of each run: its own id, else its number, else a file name."""
    c = _notes(spark, sf_dir).where("project_id is not null and version_id is not null")
    mods = c.select(F.col("item_id").alias("mod_id"), "project_id", F.when(F.col("item_id") % 3 == 0, F.col("version_id")).alias("matched_version_id"), F.when(F.col("item_id") % 3 == 1, F.upper("version_number")).alias("version"), F.concat("name", F.lit(".JAR")).alias("filename"))
    versions = c.select("project_id", "version_id", "version_number", F.array(F.concat("name", F.lit(".jar"))).alias("files"), F.col("item_id").alias("ord"))
    return lookup.current_version(mods, versions).select("mod_id", "version_id", "tier")


def correlated_releases(spark, sf_dir):
    """Of each project the 4 newest releases whose text holds the first note's version, or its game version and loader."""
    c = _notes(spark, sf_dir).where("project_id is not null")
    rel = c.select("project_id", F.col("item_id").alias("release_id"), F.col("version_number").alias("tag_name"), "name", F.col("changelog").alias("body"), F.col("item_id").alias("published_at"))
    first = lookup.first_per_key(c, "project_id", "item_id")
    wanted = first.select("project_id", T.version_tokens(F.array("version_number")).alias("tokens"), F.coalesce(F.get("game_versions", F.lit(0)), F.lit("none")).alias("game_version"), F.coalesce(F.get("loaders", F.lit(0)), F.lit("none")).alias("loader"), F.lit(0).cast("long").alias("since"))
    return lookup.correlated_releases(rel, wanted).select("project_id", "release_id", "rank")


def compatible_notes(spark, sf_dir):
    """whether each note supports fabric and 1.20.1."""
    return _notes(spark, sf_dir).select("item_id", lookup.compatible(F.col("loaders"), F.col("game_versions"), F.lit("fabric"), F.lit("1.20.1")).alias("fits"))


def retryable_lines(spark, sf_dir):
    """log lines and states that call for another try."""
    return _lines(spark, sf_dir).select("log_id", "line_idx", T.is_retryable(F.col("raw")).alias("retry"), T.is_retryable_status(F.col("line_idx")).alias("retry_status"))


def search_queries(spark, sf_dir):
    """Each document's text as a search query."""
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_query(F.regexp_replace(F.col("text"), "[^ -~\n\r\t]", "x")).alias("query"))


def filled_templates(spark, sf_dir):
    """A line about each note from a template."""
    return _notes(spark, sf_dir).select("item_id", T.fill_template(F.lit("{{name}} ({{version}}) of {{project}}: {{name}}"), {"name": F.col("name"), "version": F.col("version_number"), "project": F.col("project_slug")}).alias("line"))


def call_quota(spark, sf_dir):
    """The first 3 calls of each user."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    return usage.within_quota(e, "user_id", "event_id", 3)


def nonzero_usage(spark, sf_dir):
    """Calls of each source that used tokens."""
    u = usage.usage_events(table(spark, sf_dir, "mc_log_token_stats").distinct())
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("calls"), F.sum("input").alias("input"), F.sum("output").alias("output"))


def binary_texts(spark, sf_dir):
    """documents with a zero byte near the start; every seventh is given one."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b"))
    return d.select("doc_id", T.is_binary(F.when(F.col("doc_id") % 7 == 0, F.concat("b", F.unhex(F.lit("00")))).otherwise(F.col("b"))).alias("binary"))


def listed_candidates(spark, sf_dir):
    """runs that are not listed under any of the ids they go by."""
    r = table(spark, sf_dir, "run_report").distinct()
    c = usage.session_candidates(F.col("session_id"), F.col("sender_id"), F.lit("qq"), F.regexp_extract("session_id", ":(.*)$", 1))
    retry = table(spark, sf_dir, "mc_log_token_stats").where("source = 'retry' and session_id is not null")
    listed = retry.select(F.concat(F.lit("qq:"), "session_id").alias("session")).distinct()
    return usage.filter_sessions(r.select("run_id", "log_id", c.alias("c")), "c", listed, "blacklist").select("run_id", "log_id")


def strategy_dispatch(spark, sf_dir):
    """F1 with F2: the strategy of each run's log by name and first lines."""
    names = table(spark, sf_dir, "run_report").select(F.col("log_id").alias("file"), F.col("source_name").alias("name")).distinct()
    return archive.dispatch(names, selection.looks_like_run_log(_lines(spark, sf_dir), "log_id", "line_idx", "raw"))


def _gold_files(spark, sf_dir):
    g = table(spark, sf_dir, "strategy_c_gold_cases").select("case_id", "name", "kind", "text").distinct()
    path = F.concat_ws("/", F.coalesce("kind", F.lit("none")), F.concat("name", F.lit("-"), F.col("case_id").cast("string"), F.lit(".log")))
    return g.select(F.pmod("case_id", F.lit(20)).alias("archive"), path.alias("path"), "case_id", F.when(F.col("case_id") % 9 == 0, F.unhex(F.lit("00"))).otherwise(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("content"), F.lit("C").alias("strategy"), F.col("text").alias("extract"))


def read_archive(spark, sf_dir):
    """How requests for the gold texts as archive files are answered."""
    f = _gold_files(spark, sf_dir)
    wish = F.when(F.col("case_id") % 5 == 0, F.upper("path")).when(F.col("case_id") % 5 == 1, F.concat("path", F.lit(";x"))).when(F.col("case_id") % 5 == 2, F.regexp_extract("path", "([^/]*)$", 1)).when(F.col("case_id") % 5 == 3, F.concat(F.lit("/"), "path")).otherwise(F.lit("absent.txt"))
    requests = f.select("archive", F.col("case_id").alias("ord"), wish.alias("requested"))
    return archive.read_archive(requests, f.select("archive", "path", "content", "strategy", "extract"), quota=2).select("archive", "ord", "status", "path", F.col("text").isNotNull().alias("answered"))


def archive_file_list(spark, sf_dir):
    """The file names of each session, the first 5."""
    return archive.file_list(table(spark, sf_dir, "run_report").select(F.col("session_id").alias("archive"), F.col("source_name").alias("name")).where("archive is not null"), 5)


def cached_texts(spark, sf_dir):
    """The newest runs of each sender, numbered."""
    r = table(spark, sf_dir, "run_report").distinct().where("sender_id is not null").withColumn("at", F.unix_micros(F.col("run_ts").cast("timestamp")) / 1e6)
    live = usage.live_entries(r, "sender_id", "at", 1746000000.0, 90 * 86400.0, 10, "run_id")
    return archive.numbered(live, "sender_id", "rank", F.col("run_id"))


SEARCH_SOURCES = [("curseforge", "CurseForge"), ("github", "GitHub"), ("modrinth", "Modrinth")]


def search_listing(spark, sf_dir):
    """Notes of one version from all sources as one listing."""
    c = table(spark, sf_dir, "changelog_item").select("item_id", "project_id", "version_number", "source", "url", "name").distinct().where("project_id is not null and version_number is not null and source is not null")
    rank = F.array_position(F.array(*[F.lit(k) for k, _ in SEARCH_SOURCES]), F.col("source"))
    items = c.select(F.concat_ws("@", "project_id", "version_number").alias("query_id"), "source", F.col("item_id").alias("pos"), F.lower("url").alias("url_key"), F.lower("name").alias("title_key"), F.col("name").alias("title"), "url", rank.alias("source_rank"))
    kept = lookup.greedy_dedupe(items)
    full = kept.join(items.select("query_id", "source", "pos", "title", "url"), ["query_id", "source", "pos"]).withColumn("summary", F.lit(""))
    return archive.search_listing(full, lookup.dedupe_stats(items, kept), SEARCH_SOURCES)


def payload_projects(spark, sf_dir):
    """Notes as a search payload, read again as projects."""
    c = _notes(spark, sf_dir).where("project_id is not null and project_slug is not null").select("project_id", "item_id", "project_slug", "name", "loaders", "game_versions")
    hit = F.struct(F.col("name").alias("title"), F.col("project_slug").alias("slug"), F.col("project_id"), F.lit("mod").alias("project_type"), F.lit("<b>A &amp; B</b>").alias("description"), F.col("loaders").alias("categories"), F.col("game_versions").alias("versions"))
    payload = c.groupBy(F.col("project_id").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("item_id", hit.alias("hit")))).alias("l"))
    payload = payload.select("query_id", F.to_json(F.struct(F.transform("l", lambda x: x["hit"]).alias("hits"))).alias("payload"))
    return R.project_items(payload).select("query_id", "title", "url", "summary", F.array_join("loaders", ",").alias("loaders"), F.array_join("versions", ",").alias("versions"))


def entities_read(spark, sf_dir):
    """Names and versions of notes behind tags and entities."""
    name = F.concat(F.lit("<p>&lt;"), F.coalesce("name", F.lit("")), F.lit("&gt; &#228;&#x4e2d;&amp;lt;&nbsp;&copy; &unknown; "), F.coalesce("version_number", F.lit("")), F.lit("</p>"))
    return _notes(spark, sf_dir).select("item_id", T.strip_html(name).alias("plain"))


def salvaged_json(spark, sf_dir):
    """Fields of answers with an object between other words."""
    c = _notes(spark, sf_dir).select("item_id", "name", F.to_json(F.struct(F.col("item_id").alias("i"), F.col("name").alias("n"))).alias("j"))
    answer = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).when(F.col("item_id") % 3 == 1, F.concat(F.lit("so: "), "j", F.lit(" ok"))).otherwise("nothing")
    text = R.response_text(F.to_json(F.struct(answer.alias("text"))))
    return c.select("item_id", F.get_json_object(T.salvage_json(text), "$.i").cast("long").alias("i"), F.get_json_object(T.salvage_json(text), "$.n").alias("n"))


def newest_stored(spark, sf_dir):
    """The runs of each sender not older than 60 days before the newest run."""
    r = table(spark, sf_dir, "run_report").distinct().where("run_ts is not null")
    newest = r.agg(F.max("run_ts").alias("top"))
    return r.join(F.broadcast(newest)).where("run_ts >= top - interval 60 days").select("log_id", "run_id")


QUERIES = {
    f.__name__: f
    for f in (
        mod_resolution, version_anchor, correlated_releases, compatible_notes, retryable_lines, search_queries, filled_templates, call_quota, nonzero_usage, binary_texts, listed_candidates, strategy_dispatch,
        read_archive, archive_file_list, cached_texts, search_listing, payload_projects, entities_read, salvaged_json, newest_stored,
    )
}

_SLUG = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({}, ''))), '\\.(jar|zip)$', ''), '\\+mc[0-9]+(\\.[0-9]+)*.*$', ''), '[^a-z0-9_-]+', '-', 'g'), '-+', '-', 'g'), '-')"
_FROM_FILE = _SLUG.format("regexp_replace(regexp_replace({}, '(?i)[-_]?(fabric)[-_]?.*$', ''), '(?i)[-_]?v?[0-9]+(\\.[0-9]+)+([-+].*)?$', '')")
_FITS = "(len(coalesce(p.loaders, [])) = 0 OR list_contains(list_transform(p.loaders, lambda x: lower(x)), {})) AND (len(coalesce(p.game_versions, [])) = 0 OR list_contains(p.game_versions, {}))"
_N = "n AS (SELECT DISTINCT * FROM changelog_item)"
_CODES = " OR ".join(f"contains(t, '{p}{c}')" for c in (429, 500, 502, 503, 504) for p in (" ", "status code: "))
_PHRASES = " OR ".join(f"contains(t, '{p}')" for p in ("rate limit", "too many requests", "service unavailable", "server error", "bad gateway", "gateway timeout", "overloaded", "temporarily unavailable", "upstream", "candidate.content.parts 为空", "candidate.content.parts empty"))
_STRATEGY = "CASE WHEN contains(n, 'hs_err') OR contains(n, 'crash') THEN 'A' WHEN regexp_matches(n, 'latest|fcl|pcl|game[-_ ]?output|run[-_ ]?output|崩溃前|游戏崩溃') THEN 'C' WHEN regexp_matches(n, '\\bdebug\\b|日志|log') THEN 'B' ELSE 'C' END"
SQL = {
    "compatible_notes": f"WITH {_N} SELECT item_id, {_FITS.format(repr('fabric'), repr('1.20.1'))} AS fits FROM n p",
    "mod_resolution": f"""WITH {_N}, p AS (SELECT project_id, max(project_slug) AS slug, list_distinct(flatten(list(loaders) FILTER (loaders IS NOT NULL))) AS loaders, list_distinct(flatten(list(game_versions) FILTER (game_versions IS NOT NULL))) AS game_versions, list(DISTINCT version_id) AS hashes
        FROM n WHERE project_id IS NOT NULL AND project_slug IS NOT NULL GROUP BY project_id),
      m AS (SELECT item_id AS mod_key, loaders[1] AS loader, game_versions[1] AS gv, CASE WHEN item_id % 7 = 0 THEN version_id END AS k0, {_SLUG.format("CASE WHEN item_id % 3 = 0 THEN upper(project_slug) END")} AS k1, {_FROM_FILE.format("project_slug || '-fabric-' || version_number")} AS k2, {_SLUG.format("project_slug")} AS k3 FROM n),
      k AS (SELECT mod_key, loader, gv, 0 AS tier, k0 AS key FROM m UNION ALL SELECT mod_key, loader, gv, 1, k1 FROM m UNION ALL SELECT mod_key, loader, gv, 2, coalesce(k2, '') FROM m UNION ALL SELECT mod_key, loader, gv, 3, k3 FROM m),
      j AS (SELECT k.mod_key, p.project_id, k.tier, row_number() OVER (PARTITION BY mod_key ORDER BY tier, project_id) AS rn FROM k JOIN p ON key <> '' AND (list_contains(p.hashes, key) OR {_SLUG.format("p.slug")} = key) WHERE tier = 0 OR ({_FITS.format("loader", "gv")}))
      SELECT mod_key, project_id, tier FROM j WHERE rn = 1""",
    "version_anchor": f"""WITH {_N}, v AS (SELECT * FROM n WHERE project_id IS NOT NULL AND version_id IS NOT NULL),
      j AS (SELECT m.item_id AS mod_id, v.version_id, v.item_id AS ord, CASE WHEN m.item_id % 3 = 0 AND m.version_id = v.version_id THEN 1 WHEN m.item_id % 3 = 1 AND lower(trim(v.version_number)) <> '' AND lower(trim(v.version_number)) = lower(trim(m.version_number)) THEN 2
        WHEN lower(trim(m.name || '.jar')) = lower(trim(v.name || '.jar')) THEN 3 END AS tier FROM v m JOIN v ON m.project_id = v.project_id)
      SELECT mod_id, version_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY mod_id ORDER BY tier, ord) AS rn FROM j WHERE tier IS NOT NULL) WHERE rn = 1""",
    "correlated_releases": f"""WITH {_N}, c AS (SELECT * FROM n WHERE project_id IS NOT NULL), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY item_id) AS rn FROM c) WHERE rn = 1),
      w AS (SELECT project_id, 0 AS since, coalesce(game_versions[1], 'none') AS gv, lower(coalesce(loaders[1], 'none')) AS ld, lower(trim(coalesce(version_number, ''))) AS r0 FROM f),
      w2 AS (SELECT *, regexp_replace(r0, '^v+', '') AS bare, regexp_extract(regexp_replace(r0, '^v+', ''), '^([^+\\s]*)', 1) AS core FROM w),
      w3 AS (SELECT *, list_filter([r0, bare, core, CASE WHEN core = '' THEN '' ELSE 'v' || core END], lambda x: length(x) >= 2) AS tokens,
        CASE ld WHEN 'fabric' THEN ['fabric'] WHEN 'fabric-loader' THEN ['fabric'] WHEN 'forge' THEN ['forge'] WHEN 'neoforge' THEN ['neoforge', 'neo forge', 'neo-forge'] WHEN 'neo forge' THEN ['neoforge', 'neo forge', 'neo-forge'] WHEN 'neo-forge' THEN ['neoforge', 'neo forge', 'neo-forge'] WHEN 'quilt' THEN ['quilt'] WHEN 'quilt-loader' THEN ['quilt'] ELSE [ld] END AS words FROM w2),
      j AS (SELECT c.project_id, c.item_id, lower(concat_ws(' ', version_number, name, substr(changelog, 1, 1200))) AS t, tokens, words, lower(gv) AS gv FROM c JOIN w3 USING (project_id) WHERE c.item_id > since),
      h AS (SELECT project_id, item_id AS release_id, row_number() OVER (PARTITION BY project_id ORDER BY item_id DESC) AS rank FROM j WHERE len(list_filter(tokens, lambda x: contains(t, x))) > 0 OR (contains(t, gv) AND len(list_filter(words, lambda x: contains(t, x))) > 0))
      SELECT project_id, release_id, CAST(rank AS INTEGER) AS rank FROM h WHERE rank <= 4""",
    "retryable_lines": f"WITH l AS (SELECT DISTINCT log_id, line_idx, lower(coalesce(raw, '')) AS t, raw FROM parsed_log_line) SELECT log_id, line_idx, {_CODES} OR {_PHRASES} AS retry, line_idx = 429 OR line_idx BETWEEN 500 AND 599 AS retry_status FROM l",
    "search_queries": """WITH q AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^ -~\\n\\r\\t]', 'x', 'g') AS t FROM documents),
      s AS (SELECT doc_id, substr(regexp_replace(trim(t, ' ' || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g'), 1, 120) AS t FROM q)
      SELECT doc_id, trim(regexp_replace(regexp_replace(t, '[^0-9A-Za-z_.+#: -]', ' ', 'g'), '\\s+', ' ', 'g')) AS query FROM s""",
    "filled_templates": f"WITH {_N} SELECT item_id, coalesce(name, '') || ' (' || coalesce(version_number, '') || ') of ' || coalesce(project_slug, '') || ': ' || coalesce(name, '') AS line FROM n",
    "call_quota": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3 AS granted FROM events",
    "nonzero_usage": "SELECT source, count(*) AS calls, CAST(sum(coalesce(input, 0)) AS BIGINT) AS input, CAST(sum(coalesce(output, 0)) AS BIGINT) AS output FROM (SELECT DISTINCT * FROM mc_log_token_stats) WHERE coalesce(input, 0) + coalesce(output, 0) <> 0 GROUP BY source",
    "binary_texts": "SELECT doc_id, doc_id % 7 = 0 AND strlen(coalesce(text, '')) < 4096 AS binary FROM documents",
    "listed_candidates": "SELECT DISTINCT run_id, log_id FROM run_report WHERE session_id IS NULL OR session_id NOT IN (SELECT session_id FROM mc_log_token_stats WHERE source = 'retry' AND session_id IS NOT NULL)",
    "strategy_dispatch": f"""WITH r AS (SELECT DISTINCT log_id AS file, source_name, lower(coalesce(source_name, '')) AS n FROM run_report), s AS (SELECT file, {_STRATEGY} AS named FROM r)
      SELECT s.file, CASE WHEN named = 'B' AND coalesce(is_run_log, false) THEN 'C' ELSE named END AS strategy FROM s LEFT JOIN ({log_queries.SQL["log_is_run_log"]}) USING (file)""",
    "read_archive": """WITH g AS (SELECT DISTINCT case_id, name, kind, text FROM strategy_c_gold_cases), f AS (SELECT case_id % 20 AS archive, case_id, coalesce(kind, 'none') || '/' || name || '-' || case_id || '.log' AS path FROM g),
      s AS (SELECT *, CASE case_id % 5 WHEN 1 THEN 'several' WHEN 4 THEN 'missing' ELSE 'found' END AS f FROM f),
      q AS (SELECT *, CASE WHEN f = 'found' THEN row_number() OVER (PARTITION BY archive, f ORDER BY case_id) END AS k FROM s),
      t AS (SELECT *, CASE WHEN f <> 'found' THEN f WHEN k > 2 THEN 'no_calls_left' WHEN case_id % 9 = 0 THEN 'binary' ELSE 'read' END AS status FROM q)
      SELECT archive, case_id AS ord, status, CASE WHEN status = 'read' THEN path END AS path, status = 'read' AS answered FROM t""",
    "archive_file_list": """WITH r AS (SELECT DISTINCT session_id AS archive, source_name AS name FROM run_report WHERE session_id IS NOT NULL AND source_name IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY name) AS k, count(*) OVER (PARTITION BY archive) AS c FROM r)
      SELECT archive, string_agg('- ' || name, chr(10) ORDER BY name) FILTER (k <= 5) || CASE WHEN max(c) > 5 THEN chr(10) || '- ...(其余 ' || (max(c) - 5) || ' 个文件已省略)' ELSE '' END AS listing FROM n GROUP BY archive""",
    "cached_texts": """WITH r AS (SELECT DISTINCT * FROM run_report WHERE sender_id IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY sender_id ORDER BY run_ts DESC, run_id DESC) AS k FROM r WHERE 1746000000.0 - epoch_us(run_ts) / 1e6 <= 7776000)
      SELECT sender_id, CAST(count(*) AS INTEGER) AS entries, 'uid=' || sender_id || ' 共有 ' || count(*) || ' 条缓存的日志分析结果：' || chr(10) || string_agg('--- 结果 ' || k || ' ---' || chr(10) || run_id, chr(10) ORDER BY k) AS text FROM n WHERE k <= 10 GROUP BY sender_id""",
    "payload_projects": f"""WITH {_N}, c AS (SELECT *, 'https://modrinth.com/mod/' || project_slug AS u FROM n WHERE project_id IS NOT NULL AND project_slug IS NOT NULL AND trim(name) <> ''), f AS (SELECT *, row_number() OVER (PARTITION BY project_id, u ORDER BY item_id) AS rn FROM c)
      SELECT project_id AS query_id, trim(name) AS title, u AS url, 'A & B' AS summary, array_to_string(list_slice(list_filter(coalesce(loaders, []), lambda x: lower(x) IN ('fabric', 'forge', 'neoforge', 'quilt')), 1, 3), ',') AS loaders, array_to_string(list_slice(list_filter(coalesce(game_versions, []), lambda x: trim(x) <> ''), 1, 3), ',') AS versions FROM f WHERE rn = 1""",
    "entities_read": f"WITH {_N} SELECT item_id, trim(regexp_replace('<' || coalesce(name, '') || '> ä中&lt; © &unknown; ' || coalesce(version_number, ''), '\\s+', ' ', 'g')) AS plain FROM n",
    "salvaged_json": f"WITH {_N} SELECT item_id, CASE WHEN item_id % 3 < 2 THEN item_id END AS i, CASE WHEN item_id % 3 < 2 THEN name END AS n FROM n",
    "newest_stored": "WITH r AS (SELECT DISTINCT * FROM run_report WHERE run_ts IS NOT NULL) SELECT log_id, run_id FROM r WHERE run_ts >= (SELECT max(run_ts) FROM r) - INTERVAL 60 DAY",
}
