"""Log files as tables: routing, safe expansion of archives, decoding; sinks.

Reading and decoding bytes are the only places that need Python; they sit at
the edge, so that all after them is native.
"""

from __future__ import annotations

import gzip
import io
import re
import stat
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.text import normalize_member, redact

# Which names are archives and which are texts, and the caps.
ARCHIVE_WORDS = ("错误报告", "clash", "crash", "日志", "log")
TEXT_WORDS = ("crash", "hs_err", "latest", "debug", "fcl", "pcl", "游戏崩溃", "日志", "log")
MAX_INPUT = 32 << 20
MAX_ENTRIES = 160
MAX_ENTRY = 12 << 20
MAX_TOTAL = 32 << 20
MAX_GZIP = 16 << 20


def route(name: Column) -> Column:
    """S1: 'archive', 'text' or null for a file name."""
    n = F.lower(F.coalesce(name, F.lit("")))
    ext = F.regexp_extract(n, r".(\.[^./]+)$", 1)
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(n, w))
    return F.when(ext.isin(".zip", ".gz") & has(ARCHIVE_WORDS), "archive").when(ext.isin(".txt", ".log") & has(TEXT_WORDS), "text")


def pick_file(components: DataFrame, key: str, name: str, pos: str) -> DataFrame:
    """The first file of each message that is an archive or a text."""
    r = components.withColumn("route", route(F.col(name))).where("route is not null")
    return r.groupBy(key).agg(F.min_by(F.struct(name, "route"), pos).alias("x")).select(key, "x.*")


def resolve_name(name: Column, file: Column, url: Column, raw_names: Column) -> Column:
    """Name, else base name of the file, else of the address' path, else the first name in the raw message."""
    base = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"([^/\\]*)$", 1), F.lit(""))
    first = F.get(F.filter(raw_names, lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), F.lit(0))
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), base(file), base(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*", 0)), first, F.lit(""))


def read_files(spark: SparkSession, path: str, cap: int = MAX_INPUT) -> DataFrame:
    """Files up to ``cap`` bytes as (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= cap)


HINTS = re.compile(r"(?i)minecraft|\bINFO\b|\bWARN\b|\bERROR\b|exception|caused by|\bat [\w.$]+\(|\[\d\d:\d\d:\d\d")


def _common(c: str) -> bool:
    o = ord(c)
    return 0x20 <= o <= 0x7E or 0x3000 <= o <= 0x30FF or 0x3400 <= o <= 0x4DBF or 0x4E00 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7AF or 0xFF01 <= o <= 0xFFEE


def quality(text: str) -> float:
    """How much a decoded text looks like a log: common characters add,
    rare and control characters take off, log words add."""
    if not text:
        return float("-inf")
    common = rare = bad = 0
    for c, n in pd.Series(list(text)).value_counts().items():
        if c in "\r\n\t" or _common(c):
            common += n
        elif c < " " or "\x7f" <= c < "\xa0" or c == "�":
            bad += n
        else:
            rare += n
    return (common * 100.0 - rare * 25.0 - bad * 80.0) / len(text) + min(len(HINTS.findall(text[:4000])), 12) * 3.0


def utf16_hint(raw: bytes) -> bool:
    """Zero bytes on one side of most byte pairs of the first 4096 bytes."""
    s = raw[:4096]
    s = s[: len(s) // 2 * 2]
    if len(s) < 4:
        return False
    low, high = sorted((s[0::2].count(0), s[1::2].count(0)))
    return high >= max(2, len(s) // 2 // 20) and (high >= 3 * low or high - low >= 2)


# Byte order marks and what they tell.
MARKS = ((b"\xff\xfe\x00\x00", "utf-32", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8-sig", "utf-8"), (b"\xff\xfe", "utf-16", "utf-16"), (b"\xfe\xff", "utf-16", "utf-16"))


def decode_bytes(raw: bytes | None) -> dict:
    """(text, encoding, bom, utf16_hint, used_replace, raw_bytes, char_count)."""
    raw = raw or b""
    hint = False
    for mark, enc, bom in MARKS:
        if raw.startswith(mark):
            text = raw.decode(enc, "replace")
            return {"text": text, "encoding": enc, "bom": bom, "utf16_hint": False, "used_replace": False, "raw_bytes": len(raw), "char_count": len(text)}
    hint = utf16_hint(raw)
    best = None
    for enc in ("utf-8-sig", "utf-8", "gb18030", *(("utf-16-le", "utf-16-be") if hint else ())):
        try:
            text = raw.decode(enc)
        except UnicodeDecodeError:
            continue
        q = quality(text)
        if best is None or q > best[0]:
            best = (q, enc, text)
    enc, text, lost = (best[1], best[2], False) if best else ("utf-8-replace", raw.decode("utf-8", "replace"), True)
    return {"text": text, "encoding": enc, "bom": "", "utf16_hint": hint, "used_replace": lost, "raw_bytes": len(raw), "char_count": len(text)}


DECODED = T.StructType(
    [T.StructField(n, t) for n, t in (("text", T.StringType()), ("encoding", T.StringType()), ("bom", T.StringType()), ("utf16_hint", T.BooleanType()), ("used_replace", T.BooleanType()), ("raw_bytes", T.LongType()), ("char_count", T.LongType()))]
)


def decode(content: Column) -> Column:
    """S6 as a column: the decoded text and how it was read."""

    @F.pandas_udf(DECODED)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_bytes(b) for b in s], columns=[f.name for f in DECODED])

    return run(content)


def _expand(raw: bytes, is_zip: bool) -> Iterator[tuple[str | None, bytes | None, str]]:
    if not is_zip:
        with gzip.GzipFile(fileobj=io.BytesIO(raw)) as g:
            out = g.read(MAX_GZIP + 1)
        yield (None, out, "") if len(out) <= MAX_GZIP else (None, None, "gzip output too large")
        return
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        infos, total = z.infolist(), 0
        if len(infos) > MAX_ENTRIES:
            yield None, None, "too many entries"
            return
        for i in infos:
            mode = i.external_attr >> 16
            special = mode and stat.S_IFMT(mode) not in (0, stat.S_IFREG)
            if i.is_dir() or special or i.file_size > MAX_ENTRY:
                continue
            total += i.file_size
            if total > MAX_TOTAL:
                yield None, None, "archive too large"
                return
            with z.open(i) as f:
                data = f.read(MAX_ENTRY + 1)
            if len(data) > MAX_ENTRY:
                yield None, None, "entry too large"
                return
            yield i.filename, data, ""


def expand_archives(files: DataFrame) -> DataFrame:
    """(archive, member, pos, content, error) of zip and gz files.

    Directories, links, too large entries and unsafe paths are passed over; an
    archive beyond a cap, or one that can't be read, ends with a row that has an
    error.  A gz file's member is its name without the ending."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    for k, (name, data, error) in enumerate(_expand(raw, path.lower().endswith(".zip"))):
                        rows.append((path, name if name is not None or error else re.sub(r"\.gz$", "", path.rpartition("/")[2], flags=re.I), k, data, error))
                except (zipfile.BadZipFile, OSError, EOFError, NotImplementedError, RuntimeError) as e:
                    rows.append((path, None, 0, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["archive", "member", "pos", "content", "error"])

    out = files.select("path", "content").mapInPandas(run, "archive string, member string, pos int, content binary, error string")
    return out.withColumn("member", normalize_member(F.col("member"))).where("member is not null or error <> ''")


def write_metrics(rows: DataFrame, path: str, limit: int = 4000) -> None:
    """K1: append rows as JSON lines, texts redacted and cut at ``limit``."""
    cols = []
    for name, kind in rows.dtypes:
        c = F.col(name)
        if kind == "string":
            c = redact(c)
            c = F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("...[truncated]"))).otherwise(c)
        cols.append(c.alias(name))
    rows.select(*cols).write.mode("append").json(path)


def write_usage(records: DataFrame, path: str) -> None:
    """K2: append usage records by UTC day."""
    day = F.to_date(F.timestamp_seconds(F.floor("ts")))
    records.withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """Usage records of a JSON store ({"records": [...]}) or of JSON lines."""
    rec = "ts double, uid string, session_id string, input bigint, output bigint, source string"
    raw = spark.read.schema(f"records array<struct<{rec.replace(' double', ':double').replace(' string', ':string').replace(' bigint', ':bigint')}>>, {rec}").option("multiLine", "true").json(path)
    own = F.array(F.struct("ts", "uid", "session_id", "input", "output", "source"))
    return raw.select(F.explode(F.coalesce("records", F.when(F.col("ts").isNotNull(), own))).alias("r")).select("r.*")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold cases of JSON lines; a missing list is empty."""
    lists = ("gold_root_regexes", "gold_support_regexes", "culprit_ids", "forbidden_noise_regexes", "gold_signature_regexes")
    schema = "name string, loader string, kind string, text string, " + ", ".join(f"{c} array<string>" for c in lists)
    return spark.read.schema(schema).json(path).withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in lists})


def newest(files: DataFrame) -> DataFrame:
    """K5: the path modified last."""
    return files.agg(F.max_by("path", "modificationTime").alias("path"))
