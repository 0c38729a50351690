"""Usage totals, state and limits as batch operators; ``now`` is a parameter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400


def _amounts(r: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return r.withColumns({"input": zero("input"), "output": zero("output"), "ts": F.coalesce(F.col("ts"), F.lit(0.0)).cast("double")})


def retained(records: DataFrame, now: float, days: int = 90) -> DataFrame:
    """T4: records not older than ``days``."""
    return records.where(F.coalesce(F.col("ts"), F.lit(0.0)) >= now - days * DAY)


def usage_totals(records: DataFrame, now: float) -> DataFrame:
    """A1: one row of totals: all, the last 30 days, yesterday (from the start
    of the day before ``now``'s, one day long) and the last 6 hours."""
    ts = F.col("ts")
    yesterday = now - ((int(now) % DAY) + DAY)
    spans = {"total": F.lit(True), "month": ts >= now - 30 * DAY, "yesterday": (ts >= yesterday) & (ts < yesterday + DAY), "six_hour": ts >= now - 6 * 3600}
    cols = []
    for name, c in spans.items():
        i, o = (F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0)).alias(f"{name}_{x}") for x in ("input", "output"))
        cols += [i, o]
    return _amounts(records).agg(*cols, F.count(F.lit(1)).alias("record_count"))


def usage_by(records: DataFrame, key: str, most: int | None = 20, order: str = "ts") -> DataFrame:
    """A2: totals by user or session, the greatest first, ties by first
    appearance, then key; empty keys are left out.  ``most`` is the report's length."""
    g = _amounts(records).where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key)
    g = g.agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.min(order).alias("first_seen")).withColumn("sum", F.col("input") + F.col("output"))
    g = g.orderBy(F.desc("sum"), "first_seen", key)
    return g.limit(most) if most else g


def usage_events(events: DataFrame) -> DataFrame:
    """Events with a usage that isn't 0 and 0."""
    return _amounts(events.where("input is not null or output is not null")).where("input + output <> 0")


def accept_rate(events: DataFrame, user: str, ts: str, limit: float) -> DataFrame:
    """Whether each event is accepted: the limit isn't positive, the user is
    empty, or ``limit`` seconds have gone since the user's last accepted event.

    A greedy rule: refused events don't move the clock.  A user's distinct times are
    read in order from sorted partitions, with the last accepted time as the only state,
    so a user may have any number of events; of events of equal time the first one in
    the order of all columns is the accepted one."""
    if limit <= 0:
        return events.withColumn("accepted", F.lit(True))
    e = events.withColumns({"u": F.coalesce(F.col(user).cast("string"), F.lit("")), "t": F.col(ts).cast("double")})
    times = e.where("u <> '' and t is not null").groupBy("u", "t").agg(F.count(F.lit(1)).alias("_n")).drop("_n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, last = None, 0.0
        for pdf in batches:
            u, t = pdf["u"].to_list(), pdf["t"].to_list()
            take = []
            for k in range(len(u)):
                if u[k] != who or t[k] - last >= limit:
                    who, last = u[k], t[k]
                    take.append(k)
            yield pdf.iloc[take]

    taken = times.repartition("u").sortWithinPartitions("u", "t").mapInPandas(run, "u string, t double").withColumn("hit", F.lit(True))
    e = e.withColumn("nth", F.row_number().over(Window.partitionBy("u", "t").orderBy(*[F.col(c) for c in events.columns if dict(events.dtypes)[c] not in ("map", "variant")])))
    out = e.join(taken, ["u", "t"], "left")
    ok = (F.col("u") == "") | (F.coalesce(F.col("hit"), F.lit(False)) & (F.col("nth") == 1))
    return out.select(*events.columns, ok.alias("accepted"))


def live_entries(entries: DataFrame, key: str, stored_at: str, now: float, ttl: float, most: int = 10, tie: str | None = None) -> DataFrame:
    """Entries not older than ``ttl``, the newest ``most`` of each key."""
    order = [F.desc(stored_at)] + ([F.desc(tie)] if tie else [])
    w = Window.partitionBy(key).orderBy(*order)
    return entries.where(F.lit(now) - F.col(stored_at) <= ttl).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def has_recent(entries: DataFrame, key: str, stored_at: str, now: float, within: float = 600) -> DataFrame:
    """Whether each key has an entry of the last ``within`` seconds (inclusive)."""
    return entries.groupBy(key).agg((F.lit(now) - F.max(stored_at) <= within).alias("recent"))


def within_quota(calls: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """The first ``limit`` calls of each key are granted."""
    return calls.withColumn("granted", F.row_number().over(Window.partitionBy(key).orderBy(order)) <= limit)


def filter_sessions(events: DataFrame, candidates: str, listed: DataFrame, mode: str) -> DataFrame:
    """block list: none of an event's candidates is listed; allow list: one
    is, or the list is empty.  ``listed`` has a column ``session``; null candidates
    and null sessions match nothing.

    The distinct candidate arrays meet the list by an equi-join on single ids, and
    the events meet the arrays that were hit, so neither side is gathered in a row."""
    ids = listed.select(F.col("session").alias("_s")).where("_s is not null").distinct()
    sets = events.select(F.array_sort(F.array_distinct(F.col(candidates))).alias("_c")).where("_c is not null").distinct()
    hits = sets.select("_c", F.explode("_c").alias("_s")).join(ids, "_s", "left_semi").select("_c").distinct()
    e = events.withColumn("_c", F.array_sort(F.array_distinct(F.col(candidates))))
    if mode == "blacklist":
        return e.join(hits, "_c", "left_anti").select(*events.columns)
    # One bit of the list: an empty allow list allows all.
    if ids.limit(1).count() == 0:
        return events
    return e.join(hits, "_c", "left_semi").select(*events.columns)


def session_candidates(session: Column, origin: Column, platform: Column, group: Column) -> Column:
    """the ids under which a session may be listed."""
    hub = F.nullif(F.regexp_extract(F.coalesce(session, F.lit("")), "^[^%]*%(.+)$", 1), F.lit(""))
    composed = F.when(session.isNotNull() & platform.isNotNull(), F.concat(platform, F.lit(":"), session))
    both = F.when(group.isNotNull() & platform.isNotNull(), F.concat(platform, F.lit(":"), group))
    return F.array_distinct(F.filter(F.array(session, origin, hub, composed, both), lambda x: x.isNotNull() & (x != "")))
