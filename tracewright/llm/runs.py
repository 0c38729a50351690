"""Runs of the same happening in ordered event sequences.

Method: boundary interval lookup.  The events of an entity are cut into chunks;
in each sorted chunk the positions at which a run starts are gathered into a
sorted array, every event is assigned to its run by binary search in it, and
the runs are aggregated.  Whether an event goes on with a run depends on the run's
most complete text so far, so a chunk decides by itself only what lies between
its first and its last certain boundary; what lies around a chunk's end is put
together over the end and decided there, so chunks make no difference.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import stage_table

CHUNK = 20_000

_UUID = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])")
_HEX = re.compile(r"(?<![0-9A-Za-z_])0[xX][0-9A-Fa-f]*(?![0-9A-Za-z_])")
_CLOCK = re.compile(r"(?<![\w.])[0-9]{1,4}([-/:.])[0-9]{1,2}\1[0-9]{1,4}(?:[T ][0-9][0-9]:[0-9][0-9](?::[0-9][0-9])?)?(?:[.,][0-9]+)?Z?(?![\w])")
# A number stands free or has a unit behind it; digits inside a name are part of the name.
_NUM = re.compile(r"(?<![0-9A-Za-z_.:/])[-+]?[0-9]+(?:[.,][0-9]+)*(?=(?:ns|us|µs|ms|s|m|h|kb|mb|gb|b|%|x|KB|MB|GB|NS|US|MS|S)?(?![0-9A-Za-z_:/]))")
_CUT = re.compile(r"(?:\.\.\.|…)\s*$")
_TAIL = re.compile(r"[\s.;,!…]+$")
_PREFIX = re.compile(r"^\s*(?:\[[^\]]*\]\s*)+:\s*")
_NOTE = re.compile(r"\s*[(（](?:连续)?重复\s*\d+\s*次[)）]\s*$")
VALUE = "\x00"


def bare_group_text(text: str) -> str:
    """The text of a folded group without its prefix and its repeat note."""
    return _PREFIX.sub("", _NOTE.sub("", text))


Masked = tuple[str, bool, bool]


def mask(text: str) -> Masked:
    """(text with values masked, all in capitals, marked as cut)."""
    cut = _CUT.search(text) is not None
    t = " ".join(text.split())
    t = _TAIL.sub("", t)
    caps = t.upper() == t and t.lower() != t
    for p in (_UUID, _HEX, _CLOCK, _NUM):
        t = p.sub(VALUE, t)
    return t, caps, cut


def masked_columns(text: Column) -> dict[str, Column]:
    """The same as ``mask``, as columns ``masked, caps, cut``."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", ""), r"(?U)[\s.;,!…]+$", "")
    m = t
    for p in (_UUID, _HEX, _CLOCK, _NUM):
        m = F.regexp_replace(m, "(?U)" + p.pattern, VALUE)
    return {"masked": m, "caps": (F.upper(t) == t) & (F.lower(t) != t), "cut": text.rlike(r"(?U)(?:\.\.\.|…)\s*$")}


def one_slip(a: str, b: str) -> bool:
    """Equal up to one letter left out, doubled, put in, changed or swapped with its neighbour."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return False
    i, n = 0, min(la, lb)
    while i < n and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < la and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if la > lb else a[i:] == b[i + 1 :]


def _same_token(a: str, b: str) -> bool:
    if a == b:
        return True
    # A slip of the pen happens in plain words; names with digits, inner
    # capitals, paths and dots are compared as they are.
    x, y = a.rstrip(",.:;!?)"), b.rstrip(",.:;!?)")
    if x == y:
        return True
    if x[1:] != x[1:].lower() or y[1:] != y[1:].lower():
        return False
    return len(x) > 2 and len(y) > 2 and x.replace("'", "").isalpha() and y.replace("'", "").isalpha() and one_slip(x, y)


def _starts(part: str, whole: str) -> bool:
    """``part`` is what a cut left of the token ``whole``."""
    if whole.startswith(part.rstrip(",.")):
        return True
    return VALUE in whole and re.fullmatch(r"[(\x00+-]*[0-9A-Fa-fxX.,-]*", part) is not None


def same_masked(a: Masked, b: Masked) -> bool:
    """Same wording, differing only in values, small flaws or completeness."""
    if a[0] == b[0]:
        return True
    (ma, ca, cut_a), (mb, cb, cut_b) = a, b
    ta, tb = ma.split(" "), mb.split(" ")
    if ca != cb or ca:
        ta, tb = [x.lower() for x in ta], [x.lower() for x in tb]
    elif ta[0] and tb[0]:
        ta[0], tb[0] = ta[0][0].lower() + ta[0][1:], tb[0][0].lower() + tb[0][1:]
    if len(ta) > len(tb):
        ta, tb, cut_a, cut_b = tb, ta, cut_b, cut_a
    n, slips = len(ta), 0
    for x, y in zip(ta[:-1], tb, strict=False):
        if x != y:
            slips += 1
            if slips > 2 or not _same_token(x, y):
                return False
    x, y = ta[-1], tb[n - 1]
    if n == len(tb):
        return x == y or _same_token(x, y) or _starts(x, y) and (cut_a or n > 1) or _starts(y, x) and (cut_b or n > 1)
    return (n > 1 or cut_a) and bool(x) and (_same_token(x, y) or _starts(x, y))


def same_happening(a: str, b: str) -> bool:
    """Whether two texts report the same happening."""
    return same_masked(mask(a), mask(b))


def _fuller(t: Masked, rep: Masked) -> bool:
    return t[0].count(" ") > rep[0].count(" ") or rep[2] and not t[2]


def starts_of(texts: list[Masked], rep: Masked | None = None) -> tuple[list[int], Masked | None]:
    """(positions at which a run starts, the most complete text of the last run).  Each text is held against the
    most complete text of the run so far; ``rep`` is that of a run which is open before the first text."""
    starts = []
    for i, t in enumerate(texts):
        if rep is None or not same_masked(rep, t):
            starts.append(i)
            rep = t
        elif _fuller(t, rep):
            rep = t
    return starts, rep


def run_starts(texts: list[str]) -> list[int]:
    """Positions at which a run starts."""
    return starts_of([mask(t) for t in texts])[0]


def _apart(a: str, b: str, most: int) -> bool:
    """Whether more than ``most`` edits lie between two words."""
    if abs(len(a) - len(b)) > most:
        return True
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return True
    return row[-1] > most


def certain_boundary(a: Masked, b: Masked) -> bool:
    """Whether a run ends between two neighbours whatever came before.  A run's text that goes with one of them
    has its first word but for one slip (two edits at most), if both have two words and more."""
    if " " not in a[0] or " " not in b[0]:
        return False
    x, y = a[0].split(" ", 1)[0].lower().rstrip(",.:;!?)"), b[0].split(" ", 1)[0].lower().rstrip(",.:;!?)")
    return _apart(x, y, 4)


_ROW = "log long, chunk long, piece int, first long, last long, events long, count long, t0 timestamp_ntz, t1 timestamp_ntz, text string, masked string, caps boolean, cut boolean"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
_NEVER = np.iinfo(np.int64).max


def _merge(g: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, np.ndarray]:
    """Rows joined to runs: each row is assigned to its run by binary search in the sorted starts, then added up."""
    n = len(g["first"])
    run = np.searchsorted(starts, np.arange(n), side="right") - 1
    out = {k: g[k][starts] for k in ("log", "chunk", "first", "text", "masked", "caps", "cut")}
    last = np.full(len(starts), np.iinfo(np.int64).min)
    np.maximum.at(last, run, g["last"])
    out["last"] = last
    for k in ("events", "count"):
        out[k] = np.zeros(len(starts), dtype=np.int64)
        np.add.at(out[k], run, g[k])
    out["t0"], out["t1"] = np.full(len(starts), _NEVER), np.full(len(starts), -_NEVER)
    np.minimum.at(out["t0"], run, g["t0"])
    np.maximum.at(out["t1"], run, g["t1"])
    return out


def _arrays(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    g = {k: pdf[k].to_numpy() for k in pdf.columns}
    for k, none in (("t0", _NEVER), ("t1", -_NEVER)):
        v = pdf[k].to_numpy().astype("datetime64[us]")
        g[k] = np.where(np.isnat(v), none, v.astype(np.int64))
    return g


def _frame(g: dict[str, np.ndarray], piece: np.ndarray | int) -> pd.DataFrame:
    out = pd.DataFrame({k: g[k] for k in _NAMES if k not in ("piece", "t0", "t1")})
    for k in ("t0", "t1"):
        out[k] = np.where(np.abs(g[k]) == _NEVER, np.datetime64("NaT", "us"), g[k].astype("datetime64[us]"))
    out["piece"] = piece
    return out[_NAMES]


def _keys(g: dict[str, np.ndarray]) -> list[Masked]:
    return list(zip(g["masked"].tolist(), g["caps"].tolist(), g["cut"].tolist(), strict=True))


def _take(g: dict[str, np.ndarray], at: slice) -> dict[str, np.ndarray]:
    return {k: v[at] for k, v in g.items()}


def _equal_blocks(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Neighbours that are equal but for their values as one row."""
    new = np.ones(len(g["first"]), dtype=bool)
    new[1:] = (g["masked"][1:] != g["masked"][:-1]) | (g["caps"][1:] != g["caps"][:-1]) | (g["cut"][1:] != g["cut"][:-1])
    return _merge(g, np.flatnonzero(new))


def _chunk_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (log, chunk, first): the runs between the certain boundaries of each chunk (piece 0), and what
    lies before the first (1) and from the last one on (2)."""

    def close(parts: list[pd.DataFrame]) -> pd.DataFrame:
        g = _equal_blocks(_arrays(pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]))
        keys = _keys(g)
        n = len(keys)
        lo = next((i for i in range(1, n) if certain_boundary(keys[i - 1], keys[i])), None)
        if lo is None:
            return _frame(g, 1)
        hi = next(i for i in range(n - 1, 0, -1) if certain_boundary(keys[i - 1], keys[i]))
        out = [_frame(_take(g, slice(0, lo)), 1), _frame(_take(g, slice(hi, n)), 2)]
        if hi > lo:
            out.append(_frame(_merge(_take(g, slice(lo, hi)), np.asarray(starts_of(keys[lo:hi])[0])), 0))
        return pd.concat(out, ignore_index=True)

    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        key = pdf[["log", "chunk"]].to_numpy()
        done = []
        for at in np.split(np.arange(len(pdf)), np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1):
            if held and tuple(held[0][["log", "chunk"]].iloc[0]) != tuple(key[at[0]]):
                done.append(close(held))
                held = []
            held.append(pdf.iloc[at[0] : at[-1] + 1])
        if done:
            yield pd.concat(done, ignore_index=True)
    if held:
        yield close(held)


def _piece_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (log, chunk, first), where ``chunk`` is the place where pieces begin that belong together.
    Only the open run is kept from batch to batch."""
    held: dict[str, np.ndarray] | None = None
    rep: Masked | None = None
    for pdf in batches:
        if not len(pdf):
            continue
        g = _arrays(pdf)
        if held is not None:
            g = {k: np.concatenate([held[k], g[k]]) for k in held}
        cuts = np.flatnonzero((g["log"][1:] != g["log"][:-1]) | (g["chunk"][1:] != g["chunk"][:-1])) + 1
        keys, starts = _keys(g), []
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            own, seen = starts_of(keys[lo:hi], rep if lo == 0 and held is not None else None)
            if lo == 0 and held is not None:
                own = [0, *(x for x in own if x)]
            starts += [lo + x for x in own]
        g = _merge(g, np.asarray(starts))
        rep = seen
        n = len(starts) - 1
        held = _take(g, slice(n, n + 1))
        if n:
            yield _frame(_take(g, slice(0, n)), 0)
    if held is not None:
        yield _frame(held, 0)


def collapse_runs(
    events: DataFrame,
    log: str,
    first: str,
    last: str,
    text: str,
    t0: str,
    t1: str,
    count: Column | None = None,
    grouped: bool = False,
    chunk: int = CHUNK,
) -> DataFrame:
    """One row for each run: ``log, first_idx, last_idx, events, count, first_ts,
    last_ts, duration_s, text`` (the text of its first event); a single event is a run of one.

    ``count`` gives how often an event stands for itself (null or below 1 means
    1).  With ``grouped`` prefix and repeat note are taken off the texts first.
    Repeated deliveries (same log and first) count once, the least row in order
    of text.  Null texts are empty texts, and empty ones equal each other.  Rows
    without log or position are left out, null times are passed over, and a
    duration without any time is null.  An empty table gives an empty result;
    other columns, whatever their names, are not read.

    No chunk has more than ``chunk`` positions, so a log with a third of all
    rows spreads over many tasks; what joins the chunks are the rows around their
    ends up to the next certain boundary, equal neighbours as one row, and they are
    read in order with one open run in memory.
    """
    n = F.greatest(F.coalesce((count if count is not None else F.lit(1)).cast("long"), F.lit(1)), F.lit(1))
    bare = F.coalesce(F.col(text), F.lit(""))
    if grouped:
        bare = F.regexp_replace(F.regexp_replace(bare, r"\s*[(（](?:连续)?重复\s*\d+\s*次[)）]\s*$", ""), r"^\s*(?:\[[^\]]*\]\s*)+:\s*", "")
    src = events.select(
        F.col(log).cast("long").alias("log"), F.col(first).cast("long").alias("first"), F.col(last).cast("long").alias("last"),
        n.alias("count"), F.col(t0).cast("timestamp_ntz").alias("t0"), F.col(t1).cast("timestamp_ntz").alias("t1"), bare.alias("text"),
    ).where("log is not null and first is not null")
    src = src.withColumn("chunk", F.floor(F.col("first") / chunk)).repartition("log", "chunk")
    src = src.groupBy("log", "chunk", "first").agg(F.min(F.struct("text", "last", "count", "t0", "t1")).alias("x")).select("log", "chunk", "first", "x.*")
    src = src.withColumn("events", F.lit(1).cast("long")).withColumns(masked_columns(F.col("text")))
    rows = stage_table(src.sortWithinPartitions("log", "chunk", "first").mapInPandas(_chunk_runs, _ROW), "runs")

    # What goes on over the ends of chunks: a piece before a chunk's first boundary belongs to the last piece
    # behind a boundary before it.  One row a chunk tells where that is.
    opened = rows.where("piece = 2").groupBy("log", "chunk").agg(F.min("first").alias("begin"))
    chunks = rows.where("piece > 0").select("log", "chunk").distinct().join(opened, ["log", "chunk"], "left")
    w = Window.partitionBy("log").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("log", "chunk", F.coalesce(F.last("begin", True).over(w), F.lit(-1)).alias("begin"))
    head = rows.where("piece = 1").join(chunks, ["log", "chunk"])
    tail = rows.where("piece = 2").join(opened, ["log", "chunk"])
    pieces = head.unionByName(tail).withColumn("chunk", F.col("begin")).select(*rows.columns)
    joined = pieces.repartition("log", "chunk").sortWithinPartitions("log", "chunk", "first").mapInPandas(_piece_runs, _ROW)
    g = rows.where("piece = 0").unionByName(joined)
    secs = (F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 1e6
    return g.select("log", F.col("first").alias("first_idx"), F.col("last").alias("last_idx"), "events", "count", F.col("t0").alias("first_ts"), F.col("t1").alias("last_ts"), secs.alias("duration_s"), "text")
