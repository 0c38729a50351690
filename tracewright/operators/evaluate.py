"""How well extracts keep what they should: recalls and their means."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "array<string>"


def _share(items: Column, hit: Callable[[Column], Column], empty: float) -> Column:
    a = F.coalesce(items, F.array().cast(NONE))
    return F.when(F.size(a) == 0, F.lit(empty)).otherwise(F.size(F.filter(a, hit)) / F.size(a))


def regex_recall(patterns: Column, text: Column) -> Column:
    """A3: the share of patterns found (in any case, ^ and $ at lines); 1 without patterns."""
    return _share(patterns, lambda p: F.regexp_like(text, F.concat(F.lit("(?im)"), p)), 1.0)


def culprit_recall(names: Column, text: Column) -> Column:
    """A4: the share of names that the text holds in any case; 1 without names."""
    return _share(names, lambda c: F.contains(F.lower(text), F.lower(c)), 1.0)


def noise_leak(patterns: Column, text: Column) -> Column:
    """A5: the share of noise patterns found; 0 without patterns."""
    return _share(patterns, lambda p: F.regexp_like(text, F.concat(F.lit("(?im)"), p)), 0.0)


def evaluate(cases: DataFrame, extract: Column) -> DataFrame:
    """A3 to A6 for each gold case; ``extract`` is the extractor's text."""
    t = F.coalesce(extract, F.lit(""))
    r = cases.withColumns(
        {
            "root_recall": regex_recall(F.col("gold_root_regexes"), t), "support_recall": regex_recall(F.col("gold_support_regexes"), t), "signature_recall": regex_recall(F.col("gold_signature_regexes"), t),
            "culprit_recall": culprit_recall(F.col("culprit_ids"), t), "noise_leak": noise_leak(F.col("forbidden_noise_regexes"), t),
        }
    )
    ok = (F.col("root_recall") == 1) & (F.col("signature_recall") == 1) & (F.col("culprit_recall") == 1) & (F.col("noise_leak") <= 0.25)
    return r.withColumn("success", ok)


def summarize(rows: DataFrame) -> DataFrame:
    """Macro means and the rate of success over all cases, by loader and by
    kind, in one pass by grouping sets."""
    m = ("root_recall", "support_recall", "signature_recall", "culprit_recall", "noise_leak")
    aggs = [F.round(F.avg(c), 9).alias(c) for c in m] + [F.round(F.avg(F.col("success").cast("double")), 9).alias("success_rate"), F.count(F.lit(1)).alias("cases"), F.grouping_id().alias("gid")]
    g = rows.groupingSets([[], ["loader"], ["kind"]], "loader", "kind").agg(*aggs)
    scope = F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "loader").otherwise("kind")
    return g.select(scope.alias("scope"), F.when(scope == "loader", F.col("loader")).when(scope == "kind", F.col("kind")).alias("value"), *m, "success_rate", "cases")
