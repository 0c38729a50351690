"""Look-ups, resolution cascades, as-of filters and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text as T


def _name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^/]*)/*$", 1))


def resolve_paths(requests: DataFrame, files: DataFrame) -> DataFrame:
    """The file that each request of an archive means.

    ``requests``: (archive, requested), ``files``: (archive, path).  The tiers are
    the exact path, the path in any case, the base name, the end of the path; the
    first tier with one file counts, more than one in the last two is ambiguous.
    Requests meet files by archive and base name, which all tiers share, so the
    join is an equi-join.  Result: (archive, requested, path, tier, candidates, status), tier 0 where no file is meant."""
    f = files.select("archive", "path", _name(F.col("path")).alias("name"))
    r = requests.select("archive", "requested", _name(F.col("requested")).alias("name"))
    j = r.join(f, ["archive", "name"], "left")
    low, want = F.lower("path"), F.lower("requested")
    tiers = {1: F.col("path") == F.col("requested"), 2: low == want, 3: F.col("path").isNotNull(), 4: F.endswith(low, F.concat(F.lit("/"), want))}
    aggs = [x for k, c in tiers.items() for x in (F.count_if(c).alias(f"n{k}"), F.min(F.when(c, F.col("path"))).alias(f"p{k}"))]
    g = j.groupBy("archive", "requested").agg(*aggs)
    tier = F.when(F.col("n1") >= 1, 1).when(F.col("n2") == 1, 2).when(F.col("n3") >= 1, 3).when(F.col("n4") >= 1, 4)
    pick = F.when(F.col("n1") >= 1, F.col("p1")).when(F.col("n2") == 1, F.col("p2")).when(F.col("n3") == 1, F.col("p3")).when((F.col("n3") == 0) & (F.col("n4") == 1), F.col("p4"))
    status = F.when(pick.isNotNull(), "found").when((F.col("n3") > 1) | (F.col("n4") > 1), "ambiguous").otherwise("missing")
    return g.select("archive", "requested", pick.alias("path"), F.when(pick.isNotNull(), tier).otherwise(0).alias("tier"), F.greatest("n3", "n4").alias("candidates"), status.alias("status"))


def cite_evidence(judgements: DataFrame, changelogs: DataFrame) -> DataFrame:
    """The cited change notes of each judgement: ``judgement_id, pos,
    evidence_id, source, version_number, url, quote, generic``; unknown ids are
    dropped and the first 4 kept (the report's length)."""
    e = judgements.select("judgement_id", F.posexplode("evidence").alias("pos", "e"))
    e = e.select("judgement_id", "pos", T.strip(F.coalesce(F.col("e.evidence_id"), F.lit(""))).alias("evidence_id"), T.clean_text(F.col("e.quote"), 240).alias("quote"))
    c = changelogs.select("evidence_id", "source", "version_number", "url", "changelog")
    j = e.join(c, "evidence_id").withColumn("generic", T.only_generic(F.col("changelog"))).drop("changelog")
    w = Window.partitionBy("judgement_id").orderBy("pos")
    return j.withColumn("n", F.row_number().over(w)).where("n <= 4").drop("n")


def current_version(mods: DataFrame, versions: DataFrame) -> DataFrame:
    """The anchor version of each mod: by matched id, else by number, else
    by file name (nested); of several the first by ``ord``."""
    j = mods.join(versions, "project_id")
    low = lambda c: F.lower(T.strip(F.coalesce(F.col(c), F.lit(""))))
    tier = (
        F.when(F.coalesce(F.col("matched_version_id"), F.lit("")) == F.col("version_id"), 1)
        .when((low("version_number") != "") & (low("version_number") == low("version")), 2)
        .when((low("filename") != "") & F.coalesce(F.exists("files", lambda f: F.lower(T.strip(f)) == F.lower(T.strip(F.col("filename")))), F.lit(False)), 3)
    )
    w = Window.partitionBy("mod_id").orderBy("tier", "ord")
    return j.withColumn("tier", tier).where("tier is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def newer_than(items: DataFrame, anchors: DataFrame, key: str, when: str, id_col: str, most: int | None = None) -> DataFrame:
    """Per key the items strictly newer than the anchor's, without the
    anchor, the newest first (``rank``); ``most`` keeps the newest of them."""
    a = anchors.select(F.col(key), F.col(when).alias("_at"), F.col(id_col).alias("_id"))
    j = items.join(a, key).where((F.col(when) > F.col("_at")) & (F.col(id_col) != F.col("_id"))).drop("_at", "_id")
    r = j.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(when), id_col)))
    return r.where(F.col("rank") <= most) if most else r


def correlated_releases(releases: DataFrame, wanted: DataFrame, most: int = 4) -> DataFrame:
    """Releases of each project whose text holds one of its version tokens,
    or the game version and a word of its loader, after ``since``.

    ``wanted``: one row a project (project_id, tokens, game_version, loader, since)."""
    t = F.lower(F.concat_ws(" ", "tag_name", "name", F.substring("body", 1, 1200)))
    j = releases.withColumn("text", t).join(wanted, "project_id").where(F.col("published_at") > F.col("since"))
    mc = F.lower("game_version")
    game = F.contains(F.col("text"), mc)
    load = F.exists(T.loader_words(F.col("loader")), lambda w: F.contains(F.col("text"), w))
    hit = F.exists("tokens", lambda v: (v != "") & F.contains(F.col("text"), v)) | (game & load)
    w = Window.partitionBy("project_id").orderBy(F.desc("published_at"), "release_id")
    return j.where(hit).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("text")


def compatible(loaders: Column, versions: Column, loader: Column, game_version: Column) -> Column:
    """a project supports a loader and a game version; an empty list supports all."""
    low = F.transform(F.coalesce(loaders, F.array().cast("array<string>")), F.lower)
    v = F.coalesce(versions, F.array().cast("array<string>"))
    return ((F.size(low) == 0) | F.array_contains(low, loader)) & ((F.size(v) == 0) | F.array_contains(v, game_version))


def resolve_mods(mods: DataFrame, projects: DataFrame) -> DataFrame:
    """The project of each mod: by file hash, else by its id, its file name
    or its name as a slug of a compatible project."""
    m = mods.withColumns({"k_hash": F.coalesce("sha512", "sha1"), "k_id": T.slug(F.col("mod_id")), "k_file": T.slug_from_filename(F.col("filename")), "k_name": T.slug(F.col("name"))})
    keys = m.select("mod_key", "loader", "game_version", F.posexplode(F.array("k_hash", "k_id", "k_file", "k_name")).alias("tier", "key")).where("key is not null and key <> ''")
    p = projects.select("project_id", "loaders", "game_versions", F.explode(F.array_distinct(F.concat(F.coalesce("hashes", F.array().cast("array<string>")), F.array(T.slug(F.col("slug")))))).alias("key")).where("key <> ''")
    j = keys.join(p, "key").where((F.col("tier") == 0) | compatible(F.col("loaders"), F.col("game_versions"), F.col("loader"), F.col("game_version")))
    w = Window.partitionBy("mod_key").orderBy("tier", "project_id")
    return j.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("mod_key", "project_id", "tier", "key")


def first_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key; not dropDuplicates, as the order counts."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def top_per_key(rows: DataFrame, key: str, most: int, *order: Column | str) -> DataFrame:
    """L1, L3, L4: the first ``most`` rows of each key."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= most)


def greedy_dedupe(items: DataFrame) -> DataFrame:
    """D3: per query the items kept across sources, in the order of (source_rank, pos).

    An item whose url_key, else whose title_key, a kept item has is dropped and
    its source noted with that item; only kept items register their keys.  The
    rule depends on the order, so it is folded over each query's sorted items (a
    query brings some 15).  Columns: ``query_id, source, url_key, title_key, pos,
    also_seen_in``."""
    item = F.struct("source_rank", "pos", "source", F.coalesce("url_key", F.lit("")).alias("url_key"), F.coalesce("title_key", F.lit("")).alias("title_key"))
    seen = F.array().cast("array<string>")
    start = F.array().cast("array<struct<source_rank:int,pos:int,source:string,url_key:string,title_key:string,also_seen_in:array<string>>>")

    def step(kept: Column, x: Column) -> Column:
        by_url = F.filter(kept, lambda k: (x["url_key"] != "") & (k["url_key"] == x["url_key"]))
        by_title = F.filter(kept, lambda k: (x["title_key"] != "") & (k["title_key"] == x["title_key"]))
        # Of several kept items of one title the last registered it.
        win = F.coalesce(F.try_element_at(by_url, F.lit(-1)), F.try_element_at(by_title, F.lit(-1)))
        note = lambda k: F.when((k["source"] != x["source"]) & ~F.array_contains(k["also_seen_in"], x["source"]), F.concat(k["also_seen_in"], F.array(x["source"]))).otherwise(k["also_seen_in"])
        same = lambda k: (k["source_rank"] == win["source_rank"]) & (k["pos"] == win["pos"])
        marked = F.transform(kept, lambda k: F.when(same(k), F.struct(k["source_rank"], k["pos"], k["source"], k["url_key"], k["title_key"], note(k).alias("also_seen_in"))).otherwise(k))
        added = F.concat(kept, F.array(F.struct(x["source_rank"].alias("source_rank"), x["pos"].alias("pos"), x["source"].alias("source"), x["url_key"].alias("url_key"), x["title_key"].alias("title_key"), seen.alias("also_seen_in"))))
        return F.when(win.isNotNull(), marked).otherwise(added)

    i = items.withColumns({"source_rank": F.col("source_rank").cast("int"), "pos": F.col("pos").cast("int")})
    g = i.groupBy("query_id").agg(F.aggregate(F.array_sort(F.collect_list(item)), start, step).alias("kept"))
    return g.select("query_id", F.explode("kept").alias("k")).select("query_id", "k.*")


def dedupe_stats(items: DataFrame, kept: DataFrame) -> DataFrame:
    """Raw, kept and dropped items of each query and source."""
    raw = items.groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("raw_count"))
    k = kept.groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("kept_count"))
    j = raw.join(k, ["query_id", "source"], "left").withColumn("kept_count", F.coalesce("kept_count", F.lit(0)))
    return j.withColumn("deduped_out", F.col("raw_count") - F.col("kept_count"))


def display_names(files: DataFrame) -> DataFrame:
    """Equal display names of an archive get [2], [3] and so on, by ``ord``."""
    n = F.row_number().over(Window.partitionBy("archive", "display").orderBy("ord"))
    return files.withColumn("n", n).withColumn("display", F.when(F.col("n") > 1, F.concat("display", F.lit(" ["), "n", F.lit("]"))).otherwise(F.col("display"))).drop("n")


# Which files of an archive are read first.
PRIORITY_NAMES = (("hs_err",), ("crash",), ("latest", "游戏崩溃"), ("日志",), ("log",), ("debug",), ("fcl",), ("pcl",))


def priority_file(files: DataFrame) -> DataFrame:
    """The file to read of each archive (archive, name, chars, ord): the
    first group of names with any file; in it the longest text, then the longest
    matching key, then the first."""
    n = F.lower(F.regexp_extract("name", r"([^/]*)$", 1))
    group, length = F.lit(None).cast("int"), F.lit(0)
    for k, keys in reversed(list(enumerate(PRIORITY_NAMES))):
        hit = F.lit(False)
        size = F.lit(0)
        for key in keys:
            hit = hit | F.contains(n, F.lit(key))
            size = F.greatest(size, F.when(F.contains(n, F.lit(key)), len(key)).otherwise(0))
        group, length = F.when(hit, k).otherwise(group), F.when(hit, size).otherwise(length)
    r = files.withColumns({"group": group, "key_length": length}).where("group is not null")
    w = Window.partitionBy("archive").orderBy("group", F.desc("chars"), F.desc("key_length"), "ord")
    return r.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
