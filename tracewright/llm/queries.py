"""Queries of the text-corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import bpe, langid, mojibake, packing, pii, runs
from tracewright.session import stage_table, table


def p4_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event sequence with its runs collapsed."""
    rec = table(spark, sf_dir, "strategy_c_line_record")
    grp = table(spark, sf_dir, "output_line_group")
    a = runs.collapse_runs(rec, "log_id", "line_idx", "line_idx", "normalized", "event_ts", "event_ts")
    b = runs.collapse_runs(grp, "log_id", "start_idx", "end_idx", "text", "first_ts", "last_ts", F.col("repeat_count"), grouped=True)
    return a.withColumn("src", F.lit("record")).unionByName(b.withColumn("src", F.lit("group"))).withColumnRenamed("log", "log_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more successive rows."""
    return p4_runs(spark, sf_dir).where("events >= 2").select("src", "log_id", "first_idx", "last_idx")


def _texts(spark: SparkSession, sf_dir: str, *sources: str) -> DataFrame:
    """The free texts as (source, rec_id, text)."""
    found = {
        "line": ("parsed_log_line", "line_id", "raw"),
        "gold": ("strategy_c_gold_cases", "case_id", "text"),
        "changelog": ("changelog_item", "item_id", "changelog"),
    }
    parts = [table(spark, sf_dir, t).select(F.lit(s).alias("source"), F.col(k).alias("rec_id"), F.col(c).alias("text")) for s, (t, k, c) in found.items() if s in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with personal data: its kinds and the text with placeholders."""
    return pii.redact(_texts(spark, sf_dir, "line", "gold", "changelog"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of personal data in each record."""
    return p1_redacted(spark, sf_dir).select(F.col("source").alias("src"), "rec_id", F.explode("kinds").alias("kind"))


def p3_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with foreign characters: its chain and its restored text."""
    return mojibake.repair(_texts(spark, sf_dir, "line", "gold"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records damaged by a wrong decoding."""
    return p3_repair(spark, sf_dir).where("damaged").select(F.col("source").alias("src"), "rec_id").distinct()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of each document."""
    return bpe.encode_corpus(table(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document encoded and decoded again."""
    return p6_ids(spark, sf_dir).select("doc_id", bpe.decode_ids(F.col("ids")).alias("text"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each text, or of each of its parts, for each capacity."""
    sizes = stage_table(bpe.encode_corpus(table(spark, sf_dir, "documents"), sizes=True), "packing-sizes")
    return packing.fill_containers(sizes, table(spark, sf_dir, "context_window"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each capacity: containers used, the fewest possible and the share filled."""
    c = p7_containers(spark, sf_dir).where("container is not null").groupBy("window_id", "capacity", "container").agg(F.sum("n_tokens").alias("tokens"))
    g = c.groupBy("window_id", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return g.withColumns({"fewest": F.ceil(F.col("tokens") / F.col("capacity")), "filled": F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6)})


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document lies whole in the containers of each capacity, with no container above its
    capacity, and no more containers than one in fifty above the fewest possible."""
    c = stage_table(p7_containers(spark, sf_dir), "containers")
    whole = c.groupBy("window_id", "doc_id").agg(F.sum("n_tokens").alias("n"), F.countDistinct("part").alias("parts"), F.count(F.lit(1)).alias("rows"), (F.max("part") + 1).alias("last"))
    sizes = bpe.encode_corpus(table(spark, sf_dir, "documents"), sizes=True)
    per_doc = whole.join(sizes, "doc_id").groupBy("window_id").agg(F.count(F.lit(1)).alias("documents"), F.bool_and((F.col("n") == F.col("n_tokens")) & (F.col("parts") == F.col("rows")) & (F.col("parts") == F.col("last"))).alias("whole"))
    filled = c.where("container is not null").groupBy("window_id", "capacity", "container").agg(F.sum("n_tokens").alias("n"))
    per_bin = filled.groupBy("window_id").agg(F.bool_and(F.col("n") <= F.col("capacity")).alias("within"), (F.count(F.lit(1)) <= F.ceil(F.sum("n") / F.max("capacity")) * 1.02 + 1).alias("tight"))
    return per_doc.join(per_bin, "window_id")


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages and the stretches of each document."""
    return langid.identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "language_list"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of documents whose label is missing or wrong, or that have several."""
    d = p8_languages(spark, sf_dir)
    d = d.where((F.size("langs") > 1) | F.col("code").isNull() | ~F.array_contains("langs", F.col("code")))
    return d.select("doc_id", F.explode("langs").alias("lang"))


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p3_found": p3_found, "p3_repair": p3_repair, "p4_found": p4_found, "p4_runs": p4_runs, "p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_containers": p7_containers, "p7_fill": p7_fill, "p7_invariants": p7_invariants, "p8_found": p8_found, "p8_languages": p8_languages}
SQL: dict[str, str] = {
    # Encoding and decoding gives every text back.
    "p7_invariants": "SELECT window_id, (SELECT count(*) FROM documents) AS documents, true AS whole, true AS within, true AS tight FROM context_window",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
