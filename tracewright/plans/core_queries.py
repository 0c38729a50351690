"""Queries of the core: rolling usage and log entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.logparse import LEVELS, log_entries, mine_templates, text_lines
from tracewright.operators.rolling import rolling_totals
from tracewright.session import table


def p2_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and averages of the 7 and 30 days ending with each user-day."""
    return rolling_totals(table(spark, sf_dir, "mc_log_token_stats")).withColumnRenamed("entity", "uid")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User-days quiet for 7 days but not for 30."""
    r = p2_rolling(spark, sf_dir)
    return r.where("input_7 + output_7 = 0 and input_30 + output_30 > 0").select("uid", F.date_format("day", "yyyy-MM-dd").alias("day"))


def _entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "parsed_log_line").select("log_id", "line_idx", "raw")
    gold = text_lines(table(spark, sf_dir, "strategy_c_gold_cases"), "case_id", "text")
    mined = mine_templates(lines.select("raw").unionAll(gold.select("raw")), "raw")
    return log_entries(lines, "log_id", "line_idx", "raw", mined), log_entries(gold, "case_id", "line_idx", "raw", mined)


def p5_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All log entries with their fields and whole messages."""
    a, b = _entries(spark, sf_dir)
    return a.withColumn("src", F.lit("line")).unionByName(b.withColumn("src", F.lit("gold"))).withColumnRenamed("log", "rec_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extent and the severity of each log entry."""
    return p5_entries(spark, sf_dir).select("src", "rec_id", "first_line", "last_line", "severity")


def p5_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moment of each entry of the logs whose time tells a whole date."""
    a, _ = _entries(spark, sf_dir)
    return a.where("moment is not null").select(F.col("log").alias("log_id"), "first_line", F.unix_micros("moment").alias("micros"))


QUERIES = {"p5_moments": p5_moments, "p2_found": p2_found, "p2_rolling": p2_rolling, "p5_found": p5_found, "p5_entries": p5_entries}

_DAILY = """
daily AS (
  SELECT uid, day, CAST(sum(i) AS BIGINT) AS input, CAST(sum(o) AS BIGINT) AS output, count(*) AS calls FROM (
    SELECT regexp_replace(uid, '^[\\s\\x{00a0}\\x{3000}]+|[\\s\\x{00a0}\\x{3000}]+$', '', 'g') AS uid,
      CAST(floor((CASE WHEN ts < 1e11 THEN ts WHEN ts < 1e14 THEN ts / 1e3 WHEN ts < 1e17 THEN ts / 1e6 ELSE ts / 1e9 END) / 86400) AS INTEGER) AS day,
      coalesce(input, 0) AS i, coalesce(output, 0) AS o
    FROM (SELECT DISTINCT * FROM mc_log_token_stats) WHERE uid IS NOT NULL AND ts IS NOT NULL AND ts <> 0)
  WHERE uid <> '' GROUP BY uid, day),
grid AS (SELECT uid, unnest(generate_series(min(day), max(day))) AS day FROM daily GROUP BY uid),
full_days AS (SELECT g.uid, CAST(g.day AS INTEGER) AS d, coalesce(input, 0) AS input, coalesce(output, 0) AS output, coalesce(calls, 0) AS calls
  FROM grid g LEFT JOIN daily x ON x.uid = g.uid AND x.day = g.day)
"""
_W = "OVER (PARTITION BY uid ORDER BY d ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def _rolled(p: int) -> str:
    w = _W.format(p - 1)
    return (
        f"CAST(sum(input) {w} AS BIGINT) AS input_{p}, CAST(sum(output) {w} AS BIGINT) AS output_{p}, CAST(sum(calls) {w} AS BIGINT) AS calls_{p}, "
        f"CAST(max(input + output) {w} AS BIGINT) AS max_total_{p}, CAST(sum(input) {w} AS BIGINT) / {p}.0::DOUBLE AS avg_input_{p}, CAST(sum(output) {w} AS BIGINT) / {p}.0::DOUBLE AS avg_output_{p}"
    )


_ROLLING = f"WITH {_DAILY} SELECT uid, DATE '1970-01-01' + d AS day, input, output, calls, {_rolled(7)}, {_rolled(30)} FROM full_days"
# p5: the layouts as one alternation each; RE2 has no look-ahead, which only the
# syslog level needs to tell a level word from the message.
_HEADS = (
    r"^\[\d{1,2}[A-Z][a-z]{2}\d{4} \d\d:\d\d:\d\d(?:[.,]\d+)?\] \[[^\]]*/([A-Za-z]+)\] \[[^\]]*\]:",
    r"^\[\d\d:\d\d:\d\d(?:[.,]\d+)?\] \[[^\]/]+\] \[([A-Za-z]+)\] \[[^\]]*\]:",
    r"^\[\d\d:\d\d:\d\d(?:[.,]\d+)?\] \[[^\]]*/([A-Za-z]+)\](?: \[[^\]]*\])?:",
    r"^\[\d\d:\d\d:\d\d(?:[.,]\d+)? ([A-Za-z]+)\]:",
    r"^\[\d+[.,]\d+s\]\[([A-Za-z]+) *\]\[",
    r'^\{"(?:@t|time|timestamp|ts)": ?"[^"]*"(?:, ?"(?:lvl|level|severity)": ?"(\w*)")?',
    r"^\d{10}(?:\d{3}){0,3}\|([A-Za-z]+)\|[^|]*\|[^|]*\|",
    r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d(?:[.,]\d+)?Z? +([A-Za-z]+) +\[[^\]]*\] \S+ -",
    r"^\d\d-\d\d \d\d:\d\d:\d\d[.,]\d+ +\d+ +\d+ ([A-Z]) [^:]+:",
    r"^(?:time|ts)=\S+ level=(\w+)",
    r"^(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{1,2}, \d{4} \d{1,2}:\d\d:\d\d [AP]M \S+ \S+\s*()$",
    r"^(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [ \d]\d \d\d:\d\d:\d\d \S+ [^\s\[:]+(?:\[\d+\])?: ?(?:<?((?i:trace|debug|info|notice|warn|warning|error|fatal|crit))(?:> |: | \S))?",
)
_TWO_LINES = 11
_LEVEL_CASE = "CASE upper(w) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEVELS.items()) + " ELSE '' END"


def _quote(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


_WHICH = "CASE " + " ".join(f"WHEN regexp_matches(c, {_quote(p)}) THEN {i}" for i, p in enumerate(_HEADS, 1)) + " END"
_WORD = "CASE k " + " ".join(f"WHEN {i} THEN regexp_extract(c, {_quote(p)}, 1)" for i, p in enumerate(_HEADS, 1)) + " END"
_P5 = f"""WITH l AS (SELECT DISTINCT 'line' AS src, log_id AS rec_id, CAST(line_idx AS BIGINT) AS i, raw FROM parsed_log_line),
g AS (SELECT DISTINCT case_id, regexp_split_to_array(regexp_replace(text, '(?:\\r\\n|\\n|\\r)$', ''), '\\r\\n|\\n|\\r') AS p FROM strategy_c_gold_cases WHERE text <> ''),
x AS (SELECT * FROM l UNION ALL SELECT 'gold', case_id, CAST(generate_subscripts(p, 1) - 1 AS BIGINT), unnest(p) FROM g),
c AS (SELECT src, rec_id, i, regexp_replace(regexp_replace(raw, '\x1b\\[[0-9;]*[A-Za-z]', '', 'g'), '^[\\w.-]+[-_]\\d+ +\\| ', '') AS c FROM x),
k AS (SELECT *, {_WHICH} AS k FROM c),
w AS (SELECT *, CASE WHEN k = {_TWO_LINES} THEN regexp_extract(lead(c) OVER o, '^(SEVERE|WARNING|INFO|CONFIG|FINEST|FINER|FINE): ?', 1) ELSE {_WORD} END AS w, max(i) OVER (PARTITION BY src, rec_id) AS last FROM k WINDOW o AS (PARTITION BY src, rec_id ORDER BY i)),
e AS (SELECT src, rec_id, i, w, last, lead(i) OVER (PARTITION BY src, rec_id ORDER BY i) AS nxt FROM w WHERE k IS NOT NULL)
SELECT src, rec_id, i AS first_line, coalesce(nxt - 1, last) AS last_line, {_LEVEL_CASE} AS severity FROM e"""
_MONTHS = "CASE {} " + " ".join(f"WHEN '{m}' THEN '{i:02d}'" for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)) + " END"
_JOINED, _SPELT = r"'^\[(\d{1,2})([A-Z][a-z]{2})(\d{4}) (\d\d:\d\d:\d\d)([.,]\d+)?\]'", r"'^([A-Z][a-z]{2}) (\d{1,2}), (\d{4}) (\d{1,2}):(\d\d:\d\d) ([AP])M'"
_ISO = r"""'^(?:\{"(?:@t|time|timestamp|ts)": ?"|(?:time|ts)=)?(\d{4}-\d\d-\d\d)[ T](\d\d:\d\d:\d\d)([.,]\d+)?(Z|[+-]\d\d:?\d\d)?'"""
_AM_PM = f"(CAST(regexp_extract(c, {_SPELT}, 4) AS INTEGER) % 12 + CASE WHEN regexp_extract(c, {_SPELT}, 6) = 'P' THEN 12 ELSE 0 END)"
_MOMENTS = f"""WITH l AS (SELECT DISTINCT log_id, CAST(line_idx AS BIGINT) AS first_line, regexp_replace(regexp_replace(raw, '\x1b\\[[0-9;]*[A-Za-z]', '', 'g'), '^[\\w.-]+[-_]\\d+ +\\| ', '') AS c FROM parsed_log_line),
k AS (SELECT *, {_WHICH} AS k FROM l),
m AS (SELECT *, CASE WHEN k IS NULL THEN NULL WHEN regexp_matches(c, '^\\d{{10}}(?:\\d{{3}}){{0,3}}\\|') THEN CAST(rpad(regexp_extract(c, '^(\\d+)', 1), 16, '0')[:16] AS BIGINT)
  WHEN regexp_matches(c, {_ISO}) THEN epoch_us(CAST(regexp_extract(c, {_ISO}, 1) || ' ' || regexp_extract(c, {_ISO}, 2) || replace(regexp_extract(c, {_ISO}, 3), ',', '.') || CASE regexp_extract(c, {_ISO}, 4) WHEN '' THEN '+00' WHEN 'Z' THEN '+00' ELSE regexp_extract(c, {_ISO}, 4) END AS TIMESTAMPTZ))
  WHEN regexp_matches(c, {_JOINED}) THEN epoch_us(CAST(regexp_extract(c, {_JOINED}, 3) || '-' || {_MONTHS.format(f"regexp_extract(c, {_JOINED}, 2)")} || '-' || lpad(regexp_extract(c, {_JOINED}, 1), 2, '0') || ' ' || regexp_extract(c, {_JOINED}, 4) || replace(regexp_extract(c, {_JOINED}, 5), ',', '.') AS TIMESTAMP))
  WHEN regexp_matches(c, {_SPELT}) THEN epoch_us(CAST(regexp_extract(c, {_SPELT}, 3) || '-' || {_MONTHS.format(f"regexp_extract(c, {_SPELT}, 1)")} || '-' || lpad(regexp_extract(c, {_SPELT}, 2), 2, '0') || ' ' || lpad({_AM_PM}::VARCHAR, 2, '0') || ':' || regexp_extract(c, {_SPELT}, 5) AS TIMESTAMP)) END AS micros FROM k)
SELECT log_id, first_line, micros FROM m WHERE micros IS NOT NULL"""
SQL = {
    "p5_moments": _MOMENTS,
    "p5_found": _P5,
    "p2_rolling": _ROLLING,
    "p2_found": f"SELECT uid, strftime(day, '%Y-%m-%d') AS day FROM ({_ROLLING}) WHERE input_7 + output_7 = 0 AND input_30 + output_30 > 0",
}
