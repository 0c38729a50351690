"""Semi-structured log lines into entries with timestamp, level, thread,
component and message.

Method: frequent position-word mining.  Every line gives the first tokens of its
head, digits folded; equal heads are added up before anything is shuffled.
Distributed (position, token) counts give the frequent constants; a head with
its infrequent tokens starred is a template.  Frequent beginnings of templates that
hold a time and a level become headers: their brackets and separators are
anchors, what stands between is assigned to timestamp, level, thread and
component.  They also tell container prefixes and the order of the given
layouts, which serve as fallback rules for what no mined header covers.  Both
tables that reach the driver are bounded: at most ``positions / support``
constants and as many beginnings of templates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import stage_table

POSITIONS = 8
#: Positions that tell container prefixes and layouts.
SHORT = 4
CHUNK = 20_000

# How programs write levels, and the level each stands for.
LEVELS = {
    "TRACE": "TRACE", "TRCE": "TRACE", "TRAC": "TRACE", "VERBOSE": "TRACE", "VERB": "TRACE", "V": "TRACE", "T": "TRACE",
    "FINER": "TRACE", "FINEST": "TRACE",
    "DEBUG": "DEBUG", "DBUG": "DEBUG", "DBG": "DEBUG", "D": "DEBUG", "FINE": "DEBUG", "CONFIG": "DEBUG",
    "INFO": "INFO", "INFORMATION": "INFO", "NOTICE": "INFO", "I": "INFO",
    "WARN": "WARN", "WARNING": "WARN", "WRN": "WARN", "W": "WARN",
    "ERROR": "ERROR", "ERRO": "ERROR", "ERR": "ERROR", "SEVERE": "ERROR", "E": "ERROR",
    "FATAL": "FATAL", "CRIT": "FATAL", "CRITICAL": "FATAL", "F": "FATAL", "EMERG": "FATAL", "ALERT": "FATAL",
}


@dataclass(frozen=True)
class Layout:
    """A header layout: ``first`` holds the characters that can start it,
    ``pattern`` the whole head, the numbers are capture groups (0: absent)."""

    name: str
    first: str
    pattern: str
    timestamp: int
    level: int = 0
    thread: int = 0
    component: int = 0
    #: Levels that stand at the start of the next line.
    level_below: bool = False
    #: The head in folded form, against which mined templates are held.
    folded: str = ""


MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
#: The layouts known, in the order in which they are tried as fallback rules.
LAYOUTS = (
    Layout("dated_thread_marker", "[", r"^\[(\d{1,2}" + MONTH + r"\d{4} \d\d:\d\d:\d\d(?:[.,]\d+)?)\] \[([^\]]*)/([A-Za-z]+)\] \[([^\]]*?)/?[^/\]]*\]: ?", 1, 3, 2, 4, folded=r"^\[0[A-Z][a-z]+0 0:0:0"),
    Layout("clock_bracket_fields", "[", r"^\[(\d\d:\d\d:\d\d(?:[.,]\d+)?)\] \[([^\]/]+)\] \[([A-Za-z]+)\] \[([^\]]*)\]: ?", 1, 3, 2, 4, folded=r"^\[0:0:0(?:[.,]0)?\] \[[^\]/]+\] \[[A-Za-z]+\]"),
    Layout("clock_thread_level", "[", r"^\[(\d\d:\d\d:\d\d(?:[.,]\d+)?)\] \[([^\]]*)/([A-Za-z]+)\](?: \[([^\]]*)\])?: ?", 1, 3, 2, 4, folded=r"^\[0:0:0(?:[.,]0)?\] \["),
    Layout("clock_level", "[", r"^\[(\d\d:\d\d:\d\d(?:[.,]\d+)?) ([A-Za-z]+)\]: ?(?:\[([\w .-]+)\] )?", 1, 2, 0, 3, folded=r"^\[0:0:0 [A-Za-z]+\]"),
    Layout("uptime_tags", "[", r"^\[(\d+[.,]\d+s)\]\[([A-Za-z]+) *\]\[([^\]]*)\] ?", 1, 2, 0, 3, folded=r"^\[0[.,]0s\]\["),
    Layout("json_object", "{", r'^\{"(?:@t|time|timestamp|ts)": ?"([^"]*)"(?:, ?"(?:lvl|level|severity)": ?"(\w*)")?(?:, ?"(?:logger|component)": ?"([^"]*)")?(?:, ?"thread": ?"([^"]*)")?', 1, 2, 4, 3, folded=r'^\{"(?:@t|time|timestamp|ts)":'),
    Layout("epoch_pipe", "0", r"^(\d{10}(?:\d{3}){0,3})\|([A-Za-z]+)\|([^|]*)\|([^|]*)\|", 1, 2, 3, 4, folded=r"^0\|[A-Za-z]+\|"),
    Layout("iso_level_thread", "0", r"^(\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d(?:[.,]\d+)?Z?) +([A-Za-z]+) +\[([^\]]*)\] (\S+) - ?", 1, 2, 3, 4, folded=r"^0-0-0[ T]0:0:0"),
    Layout("short_date_pids", "0", r"^(\d\d-\d\d \d\d:\d\d:\d\d[.,]\d+) +\d+ +(\d+) ([A-Z]) ([^:]+): ?", 1, 3, 2, 4, folded=r"^0-0 0:0:0"),
    Layout("key_value", "a", r'^(?:time|ts)=(\S+) level=(\w+)(?: component=(\S+))?(?: msg=)?', 1, 2, 0, 3, folded=r"^(?:time|ts)=0-0-0T"),
    Layout("long_date_two_lines", "a", r"^(" + MONTH + r" \d{1,2}, \d{4} \d{1,2}:\d\d:\d\d [AP]M) (\S+) \S+\s*$", 1, 0, 0, 2, True, folded=r"^" + MONTH + r" 0, 0 0:0:0"),
    Layout("syslog", "a", r"^(" + MONTH + r" [ \d]\d \d\d:\d\d:\d\d) \S+ ([^\s\[:]+)(?:\[\d+\])?: ?(?:<?(?i:(trace|debug|info|notice|warn|warning|error|fatal|crit))(?:> |: | (?=\S)))?", 1, 3, 0, 2, folded=r"^" + MONTH + r" +0 0:0:0"),
)
BELOW = r"^(SEVERE|WARNING|INFO|CONFIG|FINEST|FINER|FINE): ?"
ANSI = "\x1b\\[[0-9;]*[A-Za-z]"
CONTAINER = r"^[\w.-]+[-_]\d+ +\| "


@dataclass
class Mined:
    """What the mining found: container prefixes (patterns) and the layouts by
    weight, with the number of lines whose template told so."""

    prefixes: list[str] = field(default_factory=list)
    layouts: list[tuple[str, int]] = field(default_factory=list)
    #: Headers made of templates, the most special first.
    headers: list[Layout] = field(default_factory=list)

    def ordered(self) -> list[Layout]:
        """Of each first character: mined headers with an end mark (or joined brackets), the given
        layouts as fallback rules, then mined headers without an end mark, which
        say less.  The groups go by the weight of their layouts."""
        rank = {n: i for i, (n, _) in enumerate(sorted(self.layouts, key=lambda x: (-x[1], x[0])))}
        groups: dict[str, int] = {}
        for x in LAYOUTS:
            groups[x.first] = min(groups.get(x.first, 99), rank.get(x.name, 99))
        given = sorted(LAYOUTS, key=lambda x: (groups[x.first], x.first, LAYOUTS.index(x)))
        sure = [x for x in self.headers if x.name.endswith(ENDS) or _JOINED.fullmatch(x.name)]
        return sure + given + [x for x in self.headers if x not in sure]


#: Marks at which a header ends and the message begins.
ENDS = (":", "-", "(L)")
#: Brackets that stand one at the other say as much as an end mark.
_JOINED = re.compile(r"\[T\](?:\[[LX]\]){2,}")
_WORDS = sorted((w for w in LEVELS if len(w) > 1), key=lambda w: (-len(w), w))
_LEVEL = "(?:" + "|".join(_WORDS) + ")"
#: A time in folded form.
_TIME = re.compile(r"(?:(?:0-0-0|0/0/0|0\.0\.0|0-0|0/0|0" + MONTH + "0|" + MONTH + " 0,? 0,?|" + MONTH + " 0|0 " + MONTH + r" 0)[ T])?0:0:0(?:[.,]0)?(?: [AP]M)?(?:Z|[+-]0(?::0)?)?|0[.,]0s")
# What may follow a time in a template: (name in the header's name, folded form, pattern).
_FIELDS = tuple(
    (name, re.compile(folded), pattern)
    for name, folded, pattern in (
        (" ", " ", " +"),
        ("H", r"[\w.-]+(?= [^\s\[\]]+\[0\]:)", r"\S+"),
        ("X[N]:", r"[^\s\[\]]+\[0\]:(?= |$)", r"(?<name>[^\s\[:]+)\[\d+\]: ?"),
        ("[X/L]", r"\[[^\]\[]*/(?i:" + _LEVEL + r")\]", r"\[(?<thread>[^\]]*)/(?<level>(?i:" + _LEVEL + r"))\]"),
        ("[L/X]", r"\[(?i:" + _LEVEL + r")/[^\]\[]*\]", r"\[(?<level>(?i:" + _LEVEL + r"))/(?<thread>[^\]]*)\]"),
        *((f"{a}L{b}", rf"\{a}(?i:{_LEVEL}) ?\{b}", rf"\{a}(?<level>(?i:{_LEVEL})) *\{b}") for a, b in ("[]", "()", "<>", "{}")),
        *((f"{a}X{b}", rf"\{a}[^\{b}\{a}]*\{b}", rf"\{a}(?<name>[^\{b}]*)\{b}") for a, b in ("[]", "()", "{}")),
        ("L", _LEVEL + r"(?=[ \])>:|]|$)", "(?<level>" + _LEVEL + ")"),
        ("L", r"[VTDIWEF](?= |$)", "(?<level>[VTDIWEF])"),
        ("N", r"0(?= |$)", r"(?<number>\d+)"),
        ("|", r"\|(?= |$)", r"\|"),
        ("-", r"-(?= |$)", "- ?"),
        ("::", r"::(?= |$)", ":: ?"),
        (":", r":(?= |$)", ": ?"),
        ("]", r"\]", r"\]"),
        (")", r"\)", r"\)"),
        (">", r">", ">"),
        ("X -", r"[^\s\[\](){}<>|]+ -(?= |$)", r"(?<name>\S+) +- ?"),
        ("X ::", r"[^\s\[\](){}<>|]+ ::?(?= |$)", r"(?<name>\S+) +::? ?"),
        ("X |", r"[^\s\[\](){}<>|]+ \|(?= |$)", r"(?<name>[^|]*?) +\|"),
        ("X:", r"[^\s\[\](){}<>|:*]+:(?= |$)", r"(?<name>[^\s:\[]+): ?"),
    )
)


def _time_pattern(folded: str) -> str:
    parts = {"0:0:0": r"\d{1,2}:\d\d:\d\d(?:[.,]\d+)?", "0": r"\d+", " ": " +", "AM": "[AP]M", "PM": "[AP]M"}
    return "".join(parts.get(x) or (MONTH if re.fullmatch(MONTH, x) else "" if x in (".0", ",0") else re.escape(x)) for x in re.findall(r"0:0:0|(?<=0:0:0)[.,]0|[AP]M|" + MONTH + "|.", folded))


def header_of(template: str) -> Layout | None:
    """The header that a template tells: a time first, a level behind it, and
    nothing but marks, names in brackets and names before a mark between and
    after them.  None where any part of the template is something else.

    Fallback rules: what shares a bracket with the level is the thread; of two
    other names the first is the thread and the last the component; a single
    one is the component, or the thread if a bracketed one stands before the
    level; the last number before the level is the thread if no name is.  A
    starred end in a header that isn't complete is a name with its end mark.
    Behind a host and a program with its process number a level may be missing.
    """
    m = re.match(r"([\[(<]?)", template)
    t = _TIME.match(template, m.end())
    if not t:
        return None
    name, at = m[1] + "T", t.end()
    pattern = re.escape(m[1]) + "(?<time>" + _time_pattern(t[0]) + ")"
    while at < len(template):
        if name.endswith(ENDS):
            return None
        star = template[at:] == "*" and "L" in name
        if star and name.endswith("L] "):
            # A dated log names logger and marker.
            name, pattern = name + "[X]:", pattern + (r"\[(?<name>[^\]]*?)/?[^/\]]*\]: ?" if re.match("0[A-Z]", t[0]) else r"\[(?<name>[^\]]*)\]: ?")
            break
        if star and name.endswith("L "):
            name, pattern = name + "X:", pattern + r"(?<name>[^\s:\[]+): ?"
            break
        for label, folded, part in _FIELDS:
            f = folded.match(template, at)
            if f and not ("L" in label and "L" in name) and not (label == "N" and "L" in name):
                break
        else:
            return None
        if label == "[X]" and "/L]" in name and re.match("0[A-Z]", t[0]):
            part = r"\[(?<name>[^\]]*?)/?[^/\]]*\]"
        if label == "L" and len(f[0]) == 1 and not re.search(r"[N\]|] $", name):
            return None
        name, pattern, at = name + label, pattern + part, f.end()
    if "L" not in name and name.endswith("X[N]:"):
        # Programs behind a host and a process number write their level first, if at all.
        name, pattern = name + "(L)", pattern + r"(?:<?(?<level>(?i:trace|debug|info|notice|warn|warning|error|fatal|crit))(?:> |: | (?=\S)))?"
    if "L" not in name or name.endswith(" "):
        return None
    if name == "[T L]:":
        pattern += r"(?:\[(?<name>[\w .-]+)\] )?"
    groups = [g for g in re.findall(r"\(\?<(\w+)>", pattern)]
    number = {k: [i for i, g in enumerate(groups, 1) if g == k] for k in ("time", "level", "thread", "name", "number")}
    names, level = number["name"], number["level"][0]
    thread = number["thread"][0] if number["thread"] else 0
    if not thread and len(names) > 1 or not thread and names and names[0] < level and re.search(r"\[X\].*L", name):
        thread, names = names[0], names[1:]
    if not thread and number["number"]:
        thread = number["number"][-1]
    first = m[1] or ("a" if t[0][0].isalpha() else "0")
    return Layout(name, first, "^" + re.sub(r"\(\?<\w+>", "(", pattern), 1, level, thread, names[-1] if names else 0)


def headers_of(templates: dict[str, int], least: int) -> list[Layout]:
    """The headers of frequent beginnings of templates, the most special first;
    one that is hardly found without a longer one around it is left out."""
    found: dict[str, Layout] = {}
    weight: dict[str, int] = {}
    for t, n in sorted(templates.items()):
        if x := header_of(t):
            found.setdefault(x.name, x)
            weight[x.name] = weight.get(x.name, 0) + n
    rest = dict(weight)
    for x in found:
        inner = [y for y in found if y != x and x.startswith(y)]
        if inner:
            rest[max(inner, key=len)] -= weight[x]
    keep = [x for x in found if rest[x] >= least]
    return [found[x] for x in sorted(keep, key=lambda x: (-len(x), -weight[x], x))]


def _head_tokens(text: Column) -> Column:
    # The first tokens of the whole line, however long they are; what is cut off is the rest behind them.
    plain = F.when(F.instr(text, "\x1b") > 0, F.regexp_replace(text, ANSI, "")).otherwise(text)
    tokens = F.slice(F.split(plain, " +", POSITIONS + 1), 1, POSITIONS)
    return F.split(F.regexp_replace(F.array_join(tokens, " "), "[0-9]+", "0"), " ")


def mine_templates(lines: DataFrame, text: str, support: float = 1e-3) -> Mined:
    """Mine the frequent (position, token) pairs of the line heads and the
    templates they form; ``support`` is a share of the distinct-weighted lines.
    An empty table gives an empty result (all layouts are fallback rules)."""
    # The added-up heads have three readers; they are written once.
    heads = stage_table(lines.where(F.length(text) > 0).select(_head_tokens(F.col(text)).alias("head")).groupBy("head").agg(F.count(F.lit(1)).alias("n")), "heads")
    pairs = heads.select("n", F.posexplode("head").alias("pos", "token")).groupBy("pos", "token").agg(F.sum("n").alias("n"))
    n = pairs.where("pos = 0").agg(F.sum("n")).first()[0] or 0
    if not n:
        return Mined()
    least = max(2, int(support * n))
    constants = {(r.pos, r.token) for r in pairs.where(F.col("n") >= least).collect()}  # at most POSITIONS / support rows
    by_pos = [sorted(t for p, t in constants if p == i) for i in range(POSITIONS)]
    starred = F.array_join(
        F.concat(
            *[
                F.when(F.size("head") > i, F.array(F.when(F.get("head", F.lit(i)).isin(by_pos[i]) if by_pos[i] else F.lit(False), F.get("head", F.lit(i))).otherwise("*"))).otherwise(F.array().cast("array<string>"))
                for i in range(POSITIONS)
            ]
        ),
        " ",
    )
    # Each beginning of a template; whole ones also tell prefixes and layouts.
    starts = heads.select("n", F.split(starred, " ").alias("s")).select("n", "s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("k"))
    starts = starts.select(F.array_join(F.slice("s", 1, F.col("k")), " ").alias("template"), "n", F.when(F.col("k") == F.least(F.size("s"), F.lit(SHORT)), F.col("n")).otherwise(0).alias("whole"))
    templates = starts.groupBy("template").agg(F.sum("n").alias("n"), F.sum("whole").alias("whole")).where(F.col("n") >= least).collect()  # at most POSITIONS / support rows
    found, prefixes, begun = {}, set(), {}
    for r in templates:
        t = r.template
        if m := re.match(r"^(\S+) \| (.*)$", t):
            prefixes.add(m[1])
            t = m[2]
        begun[t] = begun.get(t, 0) + r.n
        if r.whole < least:
            continue
        for x in LAYOUTS:
            if re.match(x.folded, t):
                found[x.name] = found.get(x.name, 0) + r.whole
                break
    strip = sorted("^" + re.sub("0", r"\\d+", re.escape(p)) + r" +\| " for p in prefixes if p != "*" and not _TIME.match(p))
    return Mined(strip, sorted(found.items()), headers_of(begun, least))


def _extract(c: Column, layouts: list[Layout], which: Column, group: str) -> Column:
    """The capture group of the line's own layout; other layouts aren't tried."""
    cases = [(x, getattr(x, group)) for x in layouts if getattr(x, group)]
    return reduce(lambda acc, x: acc.when(which == x[0].name, F.regexp_extract(c, x[0].pattern, x[1])), cases[1:], F.when(which == cases[0][0].name, F.regexp_extract(c, cases[0][0].pattern, cases[0][1])))


def parse_lines(lines: DataFrame, text: str, mined: Mined | None = None) -> DataFrame:
    """Add ``clean, layout, ts_text, level_word, thread_name, component_name, below`` to each line.

    ``layout`` is null for a line that begins no entry.  ``below`` is the level
    word of a line that carries the level of the header line above it.
    """
    mined = mined or Mined()
    raw = F.coalesce(F.col(text), F.lit(""))
    plain = F.when(F.instr(raw, "\x1b") > 0, F.regexp_replace(raw, ANSI, "")).otherwise(raw)
    strip = "|".join([*(p[1:] for p in mined.prefixes), CONTAINER[1:]])
    head = F.substring(plain, 1, 40)
    df = lines.withColumn("clean", F.when(F.instr(head, " | ") > 0, F.regexp_replace(plain, "^(?:" + strip + ")", "")).otherwise(plain))
    c, one = F.col("clean"), F.substring("clean", 1, 1)
    layouts = mined.ordered()
    kinds: dict[str, list[Layout]] = {}
    for x in layouts:
        kinds.setdefault(x.first, []).append(x)
    tests = {"[": one == "[", "(": one == "(", "<": one == "<", "{": one == "{", "0": one.between("0", "9"), "a": one.rlike("[A-Za-z]")}

    def cascade(own: list[Layout]) -> Column:
        return reduce(lambda acc, x: acc.when(c.rlike(x.pattern), F.lit(x.name)), own[1:], F.when(c.rlike(own[0].pattern), F.lit(own[0].name)))

    which = None
    for k, own in kinds.items():
        which = F.when(tests[k], cascade(own)) if which is None else which.when(tests[k], cascade(own))
    df = df.withColumn("layout", which)
    lay = F.col("layout")
    return df.withColumns(
        {
            "ts_text": _extract(c, layouts, lay, "timestamp"),
            "level_word": _extract(c, layouts, lay, "level"),
            "thread_name": _extract(c, layouts, lay, "thread"),
            "component_name": _extract(c, layouts, lay, "component"),
            "below": F.when(lay.isNull() & one.isin("S", "W", "I", "C", "F"), F.nullif(F.regexp_extract(c, BELOW, 1), F.lit(""))),
        }
    )


def moment(written: Column) -> Column:
    """The moment that a head's time tells, in UTC where it names no zone; null where it
    tells no whole date (a clock, a day without a year, the time since a start)."""
    months = F.create_map(*[F.lit(x) for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1) for x in (m, f"{i:02d}")])
    t = F.translate(written, ",", ".")
    part = lambda p, i: F.regexp_extract(written, p, i)
    joined = r"^(\d{1,2})([A-Z][a-z]{2})(\d{4}) (.*)$"
    spelt = r"^([A-Z][a-z]{2}) (\d{1,2}), (\d{4}) (\d{1,2}):(\d\d:\d\d) ([AP])M$"
    month = lambda p, i: F.coalesce(F.try_element_at(months, part(p, i)), F.lit("00"))
    hour = F.pmod(part(spelt, 4).try_cast("int"), F.lit(12)) + F.when(part(spelt, 6) == "P", 12).otherwise(0)
    n = F.length(written)
    micros = F.when(n == 10, written.try_cast("long") * 1_000_000).when(n == 13, written.try_cast("long") * 1000).when(n == 16, written.try_cast("long")).otherwise(F.floor(written.try_cast("long") / 1000).cast("long"))
    return (
        F.when(written.rlike(r"^\d{10}(?:\d{3}){0,3}$"), F.timestamp_micros(micros))
        .when(written.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d"), F.try_to_timestamp(t))
        .when(written.rlike(joined), F.try_to_timestamp(F.concat(part(joined, 3), F.lit("-"), month(joined, 2), F.lit("-"), F.lpad(part(joined, 1), 2, "0"), F.lit(" "), F.translate(part(joined, 4), ",", "."))))
        .when(written.rlike(spelt), F.try_to_timestamp(F.concat(part(spelt, 3), F.lit("-"), month(spelt, 1), F.lit("-"), F.lpad(part(spelt, 2), 2, "0"), F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), part(spelt, 5))))
    )


def canonical_level(word: Column) -> Column:
    """TRACE, DEBUG, INFO, WARN, ERROR, FATAL; '' for null or any other word."""
    by: dict[str, list[str]] = {}
    for k, v in LEVELS.items():
        by.setdefault(v, []).append(k)
    w = F.upper(word)
    return reduce(lambda acc, x: acc.when(w.isin(x[1]), F.lit(x[0])), list(by.items())[1:], F.when(w.isin(by["TRACE"]), F.lit("TRACE"))).otherwise("")


def log_entries(lines: DataFrame, log: str, idx: str, text: str, mined: Mined | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row for each log entry: ``log, first_line, last_line, severity,
    timestamp, moment, thread, component, layout, message``; ``timestamp`` is the time
    as it is written, ``moment`` the moment it tells (see ``moment``).

    Lines are told apart by (log, idx); repeated deliveries count once (of
    differing ones the least text).  Rows without log or idx are left out.  A
    null text is an empty line.  Lines before a log's first entry belong to
    none; a quoted or indented log line begins no entry.  An empty table gives
    an empty result; other columns, whatever their names, are not read.

    A log may be of any length: it is cut into chunks of ``chunk`` lines that
    are sorted apart; the entry that is open at a chunk's end is handed on
    through a table of one row a chunk.  The lines of one entry come together
    for its message.
    """
    src = lines.select(F.col(log).alias("log"), F.col(idx).cast("long").alias("line"), F.col(text).alias("text")).where("log is not null and line is not null")
    p = parse_lines(src, "text", mined)
    head = F.when(F.col("layout").isNotNull(), F.struct("layout", "level_word", "ts_text", "thread_name", "component_name"))
    p = p.select("log", "line", F.floor(F.col("line") / chunk).alias("chunk"), head.alias("head"), "below", "clean")
    p = p.repartition("log", "chunk").groupBy("log", "chunk", "line").agg(F.min(F.struct("clean", "head", "below")).alias("x")).select("log", "chunk", "line", "x.*")
    w = Window.partitionBy("log", "chunk").orderBy("line")
    p = p.withColumn("start", F.last(F.when(F.col("head").isNotNull(), F.col("line")), True).over(w))
    # One row a chunk: the last entry begun in it.  The chunks of a log are few.
    ends = p.groupBy("log", "chunk").agg(F.max("start").alias("last_start"))
    before = Window.partitionBy("log").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("log", "chunk", F.last("last_start", True).over(before).alias("open")).where("open is not null")
    p = p.join(carry, ["log", "chunk"], "left").withColumn("start", F.coalesce("start", "open")).where("start is not null")
    at = F.when(F.col("line") == F.col("start"), F.col("head"))
    second = F.when(F.col("line") == F.col("start") + 1, F.col("below"))
    g = p.groupBy("log", "start").agg(
        F.max("line").alias("last_line"),
        F.max(at).alias("head"),
        F.max(second).alias("below"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "clean"))), lambda s: s["clean"]), "\n").alias("whole"),
    )
    two = F.col("head.layout").isin([x.name for x in LAYOUTS if x.level_below])
    level = F.when(two, F.col("below")).otherwise(F.col("head.level_word"))
    names = {x.name: x for x in (mined or Mined()).ordered()}
    header = reduce(lambda acc, x: acc.when(F.col("head.layout") == x.name, F.regexp_replace("whole", x.pattern.removesuffix("$") if not x.level_below else x.pattern.removesuffix(r"\s*$") + r"[ \t]*(?:\n(?:[A-Z]+: ?)?)?", "")), list(names.values()), F.when(F.lit(False), F.col("whole")))
    return g.select(
        "log",
        F.col("start").alias("first_line"),
        "last_line",
        canonical_level(level).alias("severity"),
        F.col("head.ts_text").alias("timestamp"),
        moment(F.col("head.ts_text")).alias("moment"),
        F.nullif(F.col("head.thread_name"), F.lit("")).alias("thread"),
        F.nullif(F.col("head.component_name"), F.lit("")).alias("component"),
        F.col("head.layout").alias("layout"),
        header.alias("message"),
    )


def text_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """The lines of each text as (key, line_idx, raw): numbered from 0, split at
    CR LF, LF or CR; an empty rest after the last line end is no line.  Null and
    empty texts have no lines; of rows of one key with differing texts the least text counts."""
    t = texts.select(F.col(key), F.col(text)).where(f"{key} is not null").groupBy(key).agg(F.min(text).alias(text))
    parts = F.split(F.regexp_replace(F.col(text), "(?:\r\n|\n|\r)$", ""), "\r\n|\n|\r")
    return t.where(F.length(text) > 0).select(F.col(key), F.posexplode(parts).alias("line_idx", "raw"))
