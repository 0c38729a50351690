"""Rolling totals over trailing periods, days without activity included.

The work per entity is done by a two-stack monoid queue: elements of the active
window sit on a back stack (newest) and a front stack whose entries hold the
running combination from that element to the newest of the front.  Pushing,
evicting and querying are O(1) amortised and need no inverse, so maxima work as
well as sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TwoStackQueue:
    """A sliding window of (position, value) under an associative ``combine``."""

    __slots__ = ("combine", "identity", "front", "back", "back_total")

    def __init__(self, combine: Callable, identity):
        self.combine, self.identity = combine, identity
        self.front: list = []
        self.back: list = []
        self.back_total = identity

    def push(self, pos: int, value) -> None:
        self.back.append((pos, value))
        self.back_total = self.combine(self.back_total, value)

    def evict_before(self, pos: int) -> bool:
        """Drop what lies before ``pos``; true if anything went."""
        gone = False
        while True:
            if not self.front:
                if not self.back or self.back[-1][0] < pos:
                    gone = gone or bool(self.back)
                    self.back.clear()
                    self.back_total = self.identity
                    return gone
                if self.back[0][0] >= pos:
                    return gone
                total = self.identity
                while self.back:
                    p, v = self.back.pop()
                    total = self.combine(v, total)
                    self.front.append((p, total))
                self.back_total = self.identity
            while self.front and self.front[-1][0] < pos:
                self.front.pop()
                gone = True
            if self.front:
                return gone

    def total(self):
        return self.combine(self.front[-1][1], self.back_total) if self.front else self.back_total


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 from an epoch number in s, ms, us or ns, told apart
    by magnitude (1e11 s is the year 5138; 1e11 ms is 1973)."""
    a = F.abs(ts)
    return (
        F.when(a < 1e11, ts).when(a < 1e14, ts / 1e3).when(a < 1e17, ts / 1e6).otherwise(ts / 1e9)
    )


def _sum_max(a: tuple, b: tuple) -> tuple:
    return (a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] if a[3] >= b[3] else b[3])


def _windows(periods: tuple[int, ...]):
    """mapInPandas function over rows sorted by (entity, day)."""
    columns = ["entity", "day", "input", "output", "calls"] + [
        f"{n}_{p}" for p in periods for n in ("input", "output", "calls", "max_total")
    ]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entity, last, queues, sums = None, 0, [], []
        for pdf in batches:
            out: list[tuple] = []
            for e, d, i, o, c in zip(
                pdf["entity"].to_list(), pdf["day"].to_list(), pdf["input"].to_list(), pdf["output"].to_list(), pdf["calls"].to_list(), strict=True
            ):
                if e != entity:
                    entity, last = e, d - 1
                    queues = [(p, TwoStackQueue(_sum_max, (0, 0, 0, 0))) for p in periods]
                    sums = [(0, 0, 0, 0)] * len(periods)
                for day in range(last + 1, d + 1):
                    active = day == d
                    for k, (p, q) in enumerate(queues):
                        gone = q.evict_before(day - p + 1)
                        if active:
                            q.push(day, (i, o, c, i + o))
                        if gone or active:
                            sums[k] = q.total()
                    row = (e, day, i, o, c) if active else (e, day, 0, 0, 0)
                    for s in sums:
                        row += s
                    out.append(row)
                last = d
                if len(out) >= 20_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=columns)

    schema = "entity string, day int, input long, output long, calls long, " + ", ".join(
        f"{n}_{p} long" for p in periods for n in ("input", "output", "calls", "max_total")
    )
    return run, schema


def rolling_totals(
    records: DataFrame,
    entity: str = "uid",
    ts: str = "ts",
    inp: str = "input",
    out: str = "output",
    periods: tuple[int, ...] = (7, 30),
) -> DataFrame:
    """One row for each entity and UTC day from its first to its last record.

    Columns: ``entity, day (DATE), input, output, calls`` of the day and, for
    each period p, ``input_p, output_p, calls_p, max_total_p`` (the largest
    daily total) of the p days ending with it and ``avg_input_p, avg_output_p``
    (total / p).

    Rows equal in all columns count once.  The entity is trimmed of white
    space; rows whose entity is null or blank or whose ts is null, NaN or 0 are
    left out.  Null amounts mean 0; a record with 0 tokens is a record.  An
    empty table gives an empty result.  Other columns, whatever their names,
    only take part in the comparison of whole rows.

    Rows are summed to entity-days before they are shuffled by entity, so an
    entity with a third of all rows brings no more than one row a day.
    """
    spaces = r"^[\s 　]+|[\s 　]+$"
    secs = epoch_seconds(F.col(ts).cast("double"))
    daily = (
        records.distinct()
        .select(
            F.regexp_replace(F.col(entity), spaces, "").alias("entity"),
            F.when(~F.isnan(F.col(ts).cast("double")) & (F.col(ts) != 0), F.floor(secs / 86400).cast("int")).alias("day"),
            F.coalesce(F.col(inp), F.lit(0)).cast("long").alias("input"),
            F.coalesce(F.col(out), F.lit(0)).cast("long").alias("output"),
        )
        .where((F.col("entity") != "") & F.col("day").isNotNull())
        .groupBy("entity", "day")
        .agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.count(F.lit(1)).alias("calls"))
    )
    run, schema = _windows(tuple(periods))
    rolled = daily.repartition("entity").sortWithinPartitions("entity", "day").mapInPandas(run, schema)
    averages = {f"avg_{n}_{p}": F.col(f"{n}_{p}") / F.lit(float(p)) for p in periods for n in ("input", "output")}
    return rolled.withColumn("day", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day"))).withColumns(averages)
