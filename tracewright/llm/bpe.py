"""Encoding of a corpus with a byte-level BPE tokenizer, inside the JVM.

Method: texts are cut into words by the tokenizer's pattern; the distinct words
of the corpus are encoded once each by Spark higher-order functions that fold
the ranked merges over the array of the word's bytes, ranks coming from a
literal map; then every text looks its words up.  Decoding concatenates the
binary pieces of the ids.

Bytes are handled as characters U+0000 to U+00FF (ISO 8859-1), so that pieces
are strings.  Literal maps are hash tables in a few literal arrays, as looking up a plain map literal reads all its keys.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import accumulate
from pathlib import Path

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.session import stage_table

DEFAULT_DIR = "/opt/tokenizers"
# Fixed value: the pattern of the public tokenizer, with white space spelled out (Unicode White_Space).
_S = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: So many of the most frequent words, of at most ``HOT_LENGTH`` characters, are looked up in a literal; the rest are joined.
HOT_WORDS = 20_000
HOT_LENGTH = 64
#: Words of more bytes are merged with a heap, as the fold takes steps in the square of a word's length.
LONG_WORD = 400
NONE = 2**31 - 1


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    """Byte pieces and ranks of a rank file (default: byte_bpe_50k)."""
    f = Path(path or f"{DEFAULT_DIR}/byte_bpe_50k.tiktoken")
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read_bytes().splitlines()) if a}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hash_table(entries: list[tuple[str, object]], value_type: str) -> Column:
    """A literal hash table of (key, value): entries in the order of their
    buckets, and where each bucket starts; a key's bucket is the low bits of its
    hash.  The size of ``entries`` is the caller's to check."""
    buckets = 1 << max(1, len(entries).bit_length())
    rows = sorted((xxhash.xxh64_intdigest(k.encode("utf-8"), seed=42) & (buckets - 1), k, v) for k, v in entries)  # as Spark's xxhash64
    start = [0] * (buckets + 1)
    for b, _, _ in rows:
        start[b + 1] += 1
    start = list(accumulate(start))
    table = {"mask": buckets - 1, "start": start, "key": [k for _, k, _ in rows], "value": [v for _, _, v in rows]}
    return F.from_json(F.lit(json.dumps(table, ensure_ascii=False, separators=(",", ":"))), f"struct<mask: bigint, start: array<int>, key: array<string>, value: array<{value_type}>>")


def look_up(table: Column, key: Column) -> Column:
    """The value of ``key`` in a hash table; null without one."""

    def probe(b: Column) -> Column:
        lo = F.get(table["start"], b)
        own = F.slice(table["key"], lo + 1, F.get(table["start"], b + 1) - lo)
        return let(F.array_position(own, key).cast("int"), lambda p: F.when(p > 0, F.get(table["value"], lo + p - 1)))

    return let(F.xxhash64(key).bitwiseAND(table["mask"]).cast("int"), probe)


def as_bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text as characters below U+0100."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def fold_merges(word: Column, rank: Column) -> Column:
    """The ids of a word (as bytes): the pair of lowest rank merges, the
    leftmost first, until no pair has a rank."""

    def rank_of(piece: Column) -> Column:
        return F.coalesce(look_up(rank, piece), F.lit(NONE))

    none = F.array().cast("array<int>")
    parts = F.filter(F.split(word, ""), lambda c: c != "")
    pair_ranks = F.when(F.length(word) > 1, F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: rank_of(F.substr(word, i, F.lit(2))))).otherwise(none)

    def merge(acc: Column, i: Column) -> Column:
        p, r = acc["p"], acc["r"]

        def put(merged: Column) -> Column:
            left = F.when(i > 1, F.array(rank_of(F.concat(F.get(p, i - 2), merged)))).otherwise(none)
            right = F.when(i < F.size(r), F.array(rank_of(F.concat(merged, F.get(p, i + 1))))).otherwise(none)
            return F.struct(
                F.concat(F.slice(p, F.lit(1), i - 1), F.array(merged), F.slice(p, i + 2, F.size(p))).alias("p"),
                F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), left, right, F.slice(r, i + 2, F.size(p))).alias("r"),
            )

        return let(F.concat(F.get(p, i - 1), F.get(p, i)), put)

    def step(acc: Column, _: Column) -> Column:
        r = acc["r"]
        return let(F.array_min(r), lambda low: F.when(low < NONE, let(F.array_position(r, low).cast("int"), lambda i: merge(acc, i))).otherwise(acc))

    start = F.struct(parts.alias("p"), pair_ranks.alias("r"))
    done = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), start, step)
    whole = look_up(rank, word)
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(done["p"], lambda x: look_up(rank, x)))


def rank_table(path: str | None = None) -> Column:
    """The ranks as a literal hash table; its size is that of the vocabulary."""
    return hash_table([(k.decode("latin-1"), v) for k, v in load_ranks(path).items()], "int")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids that ``fold_merges`` gives, with the pairs in a heap: the pair of lowest rank, the leftmost first."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapify(heap)
    gone = bytearray(n + 1)
    while heap:
        _, i, stop = heappop(heap)
        j = after[i] if i < n and not gone[i] else n
        if j >= n or gone[i] or end[j] != stop:
            continue
        gone[j], end[i], after[i] = 1, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : end[after[i]]])) is not None:
                heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : stop])) is not None:
            heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


def encode_words(words: DataFrame, path: str | None = None, long_word: int = LONG_WORD) -> DataFrame:
    """``word, n, ids`` for the distinct words of a column ``word``, with their
    numbers of rows; null and empty words are left out.  Words above ``long_word``
    bytes get the same ids by a heap instead of the fold."""
    w = words.where("word is not null and word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks = None
        for pdf in batches:
            if len(pdf):
                ranks = ranks or load_ranks(path)
                yield pdf.assign(ids=[merge_long(x.encode("utf-8"), ranks) for x in pdf["word"]])

    short = F.octet_length("word") <= long_word
    ids = F.when(short, let(rank_table(path), lambda rank: fold_merges(as_bytes(F.col("word")), rank)))
    # Written once, so that the words aren't counted again for the long ones.
    folded = stage_table(w.select("word", "n", ids.alias("ids")), "bpe-words")
    long = stage_table(folded.where("ids is null").select("word", "n").mapInPandas(run, "word string, n long, ids array<int>"), "bpe-long-words")
    return folded.where("ids is not null").unionByName(long)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, hot_words: int = HOT_WORDS, sizes: bool = False) -> DataFrame:
    """``key, ids`` for each row: the token ids of its text, without special tokens.

    With ``sizes`` it is ``key, n_tokens``: only numbers of ids are looked up and added up.
    Null and empty texts have no ids (an empty list); a blank text has the ids
    of its white space; strings of special tokens in a text are ordinary text.
    Repeated rows are encoded each for itself; an empty table gives an empty
    result; other columns, whatever their names, are not read.

    The encoded words are written once.  The ``hot_words`` most frequent of
    them are looked up in a literal hash table, without any shuffle.  Only if
    there are more, the texts' other words, each of which is rarer than any of
    those, are joined with theirs and handed back to the texts, so no key of
    that join is hot.
    """
    d = documents.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    encoded = encode_words(d.select(F.explode(words_of(F.col("text"))).alias("word")), path)
    short = F.length("word") <= HOT_LENGTH
    hot = encoded.where(short).orderBy(F.desc("n"), "word").limit(hot_words).select("word", "ids").collect()
    total = encoded.count()
    table = hash_table([(r.word, len(r.ids) if sizes else list(r.ids)) for r in hot], "int" if sizes else "array<int>")
    value = F.size("ids") if sizes else F.col("ids")
    together = (lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b).alias("n_tokens")) if sizes else (lambda x: F.flatten(x).alias("ids"))
    words = words_of(F.col("text"))
    if total == len(hot):
        found = let(table, lambda t: F.transform(words, lambda w: look_up(t, w)))
        return d.select(F.col(key), together(found))
    # A text is known by its digest in the join; copies share one row of it.
    d = d.withColumn("digest", F.sha2(F.col("text"), 256))
    cold = let(table, lambda t: F.filter(F.array_distinct(words), lambda w: look_up(t, w).isNull()))
    need = d.select("digest", F.explode(cold).alias("word")).distinct()
    got = need.join(encoded.select("word", value.alias("v")), "word").groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("word", "v"))).alias("m"))
    out = d.join(got, "digest", "left")
    found = let(table, lambda t: F.transform(words, lambda w: F.coalesce(look_up(t, w), F.try_element_at("m", w))))
    return out.select(F.col(key), together(found))


def decode_ids(ids: Column, path: str | None = None) -> Column:
    """The text of a list of ids: the binary pieces are concatenated and read as UTF-8."""
    ranks = load_ranks(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        pieces[v] = k.decode("latin-1")
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    whole = let(table, lambda t: F.array_join(F.transform(ids, lambda i: F.get(t, i)), ""))
    return F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8")
