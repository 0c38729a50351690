"""Texts read in the wrong character encoding: found and repaired.

Method: expectation-maximisation over latent encoding chains.  A chain says
"written in T, read as W" (once or twice over); undoing it encodes with W and
decodes with T.  Each line with a character that damage can leave behind has a
latent chain, and each stretch that the chain can undo is latently damaged or
not.  The likelihood is that of the undone line in a language model of pairs of
character classes, which falls back on scripts.  The model and the chains'
shares per source are unknown at first; each round the posteriors of all lines
and stretches (E) give expected, fractional counts of chains and of class pairs
(M), so weak evidence in single records is pooled.  Rounds go on until the log
likelihood a line settles.

The readings of the lines are worked out once and written as arrays of pair
numbers; a round is a few array operations over them.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import stage_table

# The chains tried, (read as, written in).
CHAINS = (
    ("cp1252", "utf-8"), ("cp1252", "utf-8", "cp1252", "utf-8"), ("cp437", "utf-8"), ("cp850", "utf-8"), ("cp866", "utf-8"), ("cp1251", "utf-8"),
    ("koi8_r", "utf-8"), ("mac_roman", "utf-8"), ("gb18030", "utf-8"), ("cp932", "utf-8"), ("cp949", "utf-8"), ("big5", "utf-8"),
    ("cp1252", "gb18030"), ("cp1252", "cp949"), ("cp1252", "cp932"), ("cp1252", "big5"), ("cp1252", "euc_jp"),
    ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "cp866"), ("cp1251", "koi8_r"), ("cp1251", "cp866"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp866", "koi8_r"),
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("cp850", "cp1251"), ("cp437", "cp1251"),
    ("latin-1", "utf-16-le"), ("latin-1", "utf-16-be"), ("ascii", "utf-7"),
)
SINGLE = ("cp1252", "cp1251", "cp437", "cp850", "cp866", "koi8_r", "mac_roman")

#: Valid UTF-8 of two bytes and more, in a text whose characters are bytes.
_UTF8 = re.compile("(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3})+")
_SOUND = "sound"
#: Between the names of the chains of a record that has several.
BOTH = " + "
#: The chain that leaves replacement characters behind and can't be undone.
_LOST = "lost"
NAMES = (*("|".join(c) for c in CHAINS), _LOST)


def _byte_table(codec: str) -> dict[int, str]:
    """Code point -> the byte it was read from, as a character below 256.
    Bytes that the codec leaves undefined stand for themselves; characters
    below 256 that no byte gives become U+FFFF."""
    out = {i: "\uffff" for i in range(128, 256)}
    for i in range(128, 256):
        try:
            c = bytes([i]).decode(codec)
        except UnicodeDecodeError:
            c = chr(i)
        out[ord(c)] = chr(i)
    if codec == "cp1252":  # ISO 8859-1 reads the same bytes as control characters
        for i in range(128, 160):
            out[i] = chr(i)
    return out


TABLES = {c: _byte_table(c) for c in SINGLE}
#: The characters that each codec reads from the bytes above 127; those among
#: them that begin a UTF-8 sequence, and those that go on with one.
MAPPED = {c: frozenset(chr(i) for i, b in t.items() if "\x80" <= b <= "\xff") for c, t in TABLES.items()}
LEADS = {c: frozenset(chr(i) for i, b in t.items() if "\xc2" <= b <= "\xf4") for c, t in TABLES.items()}
FOLLOW = {c: frozenset(chr(i) for i, b in t.items() if "\x80" <= b <= "\xbf") for c, t in TABLES.items()}

# Groups of characters, and how many a group has (for an even share of its probability).
GROUPS = {
    "nul": 28, "space": 1, "low": 26, "up": 26, "digit": 10, "mark": 32, "c1": 32, "latin": 260, "LATIN": 260, "cyr": 120, "CYR": 120, "greek": 60, "GREEK": 60, "quote": 30, "sign": 34, "symbol": 3000,
    "box": 160, "cjk_mark": 64, "hira": 86, "kata": 90, "half_kata": 63, "wide": 94, "hangul": 2350, "rare_hangul": 8800, "han": 4800, "rare_han": 24000, "private": 6400, "lost": 1, "other": 40000, "emoji": 2000,
}
_GROUP = tuple(GROUPS)
#: Groups whose characters are told apart by the model; the others are one class each.
_SPELT = frozenset(("space", "low", "mark", "latin", "LATIN", "cyr", "CYR", "greek", "GREEK", "quote", "sign", "symbol", "box", "cjk_mark"))


def _group(c: str) -> str:
    o = ord(c)
    if o < 128:
        return "space" if c in " \t" else "low" if c.islower() else "up" if c.isupper() else "digit" if c.isdigit() else "nul" if o < 32 or o == 127 else "mark"
    if o < 0xA0:
        return "c1"
    if o in (0xAB, 0xBB) or 0x2010 <= o <= 0x203A:
        return "quote"
    if o <= 0xBF or o in (0xD7, 0xF7, 0x20AC, 0x2122):
        return "sign" if c not in "ªº" else "latin"
    if o < 0x250 or 0x1E00 <= o < 0x1F00 or o in (0xFB01, 0xFB02):
        return "LATIN" if c.isupper() else "latin"
    if 0x370 <= o < 0x400:
        return "GREEK" if c.isupper() else "greek"
    if 0x400 <= o < 0x530:
        return "CYR" if c.isupper() else "cyr"
    if 0x2500 <= o < 0x25A0:
        return "box"
    if 0x2070 <= o < 0x2E00:
        return "symbol"
    if 0x3000 <= o < 0x3040:
        return "cjk_mark"
    if 0x3040 <= o < 0x30A0:
        return "hira"
    if 0x30A0 <= o < 0x3100:
        return "kata"
    if 0xFF61 <= o <= 0xFF9F:
        return "half_kata"
    if 0xFF00 <= o < 0xFF61:
        return "wide"
    if 0xAC00 <= o <= 0xD7A3:
        try:
            c.encode("euc_kr")
            return "hangul"
        except UnicodeEncodeError:
            return "rare_hangul"
    if 0x3400 <= o <= 0x9FFF:
        for codec, top in (("gb2312", 0xD7), ("euc_jp", 0xCF)):
            try:
                if 0xB0 <= c.encode(codec)[0] <= top:
                    return "han"
            except UnicodeEncodeError:
                pass
        return "rare_han"
    if o == 0xFFFD:
        return "lost"
    return "private" if 0xE000 <= o < 0xF900 else "emoji" if o >= 0x1F000 else "other"


class _Classes(dict):
    """A character -> (class, group), both numbers; worked out when first asked for."""

    def __missing__(self, c: str) -> tuple[int, int]:
        g = _group(c)
        k = _GROUP.index(g)
        v = self[c] = (ord(" ") if g == "space" else ord(c) if g in _SPELT else 0x110000 + k, k)
        return v


CLASSES = _Classes()
_LOST_CLASS = 0x110000 + _GROUP.index("lost")


def _class_group(k: int) -> int:
    return k - 0x110000 if k >= 0x110000 else CLASSES[chr(k)][1]


def pair_key(two: str) -> int:
    """The number of a pair of classes."""
    return CLASSES[two[0]][0] << 21 | CLASSES[two[1]][0]


class Model:
    """Language model of class pairs, which falls back on pairs of groups, and the shares of the chains by source."""

    BACK, GROUP_BACK, CLASS_BACK = 30.0, 20.0, 20.0
    #: Before any data two lines in a hundred are damaged, by any chain alike; half of a share rests on that.
    DAMAGED = 0.02

    #: So many stretches that a line's chain can undo are damaged before any data, and how many stretches that is worth.
    TOUCHED, WORTH = 0.3, 20.0

    def __init__(self, pairs: dict[int, float], shares: dict[str, dict[str, float]] | None = None, touched: dict[str, dict[str, float]] | None = None):
        self.pairs, self.shares, self.touched = pairs, shares or {}, touched or {}
        n = len(_GROUP)
        self.left, one = Counter(), Counter()
        groups = np.zeros((n, n))
        for key, v in pairs.items():
            a, b = key >> 21, key & 0x1FFFFF
            self.left[a] += v
            one[b] += v
            groups[_class_group(a), _class_group(b)] += v
        into = groups.sum(axis=0) + 0.5
        into /= into.sum()
        self.trans = np.log((groups + self.GROUP_BACK * into) / (groups.sum(axis=1, keepdims=True) + self.GROUP_BACK))
        in_group = Counter()
        for b, v in one.items():
            in_group[_class_group(b)] += v
        self.one, self.in_group = one, in_group
        self.memo: dict[int, float] = {}

    def logp(self, key: int) -> float:
        """log P(second character | first character)."""
        v = self.memo.get(key)
        if v is None:
            a, b = key >> 21, key & 0x1FFFFF
            ga, gb = _class_group(a), _class_group(b)
            size = GROUPS[_GROUP[gb]]
            back = math.exp(self.trans[ga, gb])
            if b < 0x110000:
                back *= (self.one.get(b, 0.0) + self.CLASS_BACK / size) / (self.in_group.get(gb, 0.0) + self.CLASS_BACK)
            v = math.log((self.pairs.get(key, 0.0) + self.BACK * back) / (self.left.get(a, 0.0) + self.BACK))
            v = self.memo[key] = v if b < 0x110000 else v - math.log(size)
        return v

    def score(self, text: str) -> float:
        return sum(self.logp(pair_key(text[i : i + 2])) for i in range(len(text) - 1))

    def share(self, source: str, chain: str) -> float:
        """The log share of a chain (or of sound lines) in a source."""
        own = self.shares.get(source, {})
        n = sum(own.values())
        start = 1 - self.DAMAGED if chain == _SOUND else self.DAMAGED / len(NAMES)
        return math.log(0.5 * own.get(chain, 0.0) / n + 0.5 * start) if n else math.log(start)

    def touch(self, chain: str) -> float:
        """The share of damaged ones among the stretches that the chain of a line can undo."""
        own = self.touched.get(chain, {})
        return (own.get("touched", 0.0) + self.TOUCHED * self.WORTH) / (own.get("touchable", 0.0) + self.WORTH)


_MAPPED = re.compile("[\x01-\t\x0b\x0c\x0e-\xff]*[\x80-\xff][\x01-\t\x0b\x0c\x0e-\xff]*")
_HIGH = re.compile("[\x80-\xff]")
_WORD = re.compile("[!-\xff]*[\x80-\xff][!-\xff]*")
_INNER = re.compile("[а-џґ](?=[Ѐ-ЯҐ])")
_WIDE = re.compile("[\x80-￼]+")
_LOSS = re.compile("�+")
_NULS = re.compile("(?:[\x01-\xff]\x00){2,}|(?:\x00[\x01-\xff]){2,}")
_UTF7 = re.compile(r"\+[A-Za-z0-9+/]{3,}-")
#: What damage can leave behind; lines without it can't be changed by any chain.
TRACE = "[\x80-\U0010ffff]|\x00|" + _UTF7.pattern
_TRACE = re.compile(TRACE)


def _decodable(b: str, lo: int, hi: int, written: str) -> list[tuple[int, int, str]]:
    """The pieces of a line that ``written`` decodes, from one undecodable byte to the next."""
    out = []
    while m := _HIGH.search(b, lo, hi):
        lo = m.start()
        raw = b[lo:hi].encode("latin-1")
        try:
            out.append((lo, hi, raw.decode(written)))
            break
        except UnicodeDecodeError as e:
            if e.start:
                out.append((lo, lo + e.start, raw[: e.start].decode(written)))
            lo += e.start + 1
    return out


def _undo_once(text: str, read_as: str, written: str) -> list[tuple[int, int, str]]:
    """Replacements (start, end, restored) that undo one misreading."""
    out = []
    if read_as in TABLES:
        b = text.translate(TABLES[read_as])
        if written == "utf-8":
            return [(m.start(), m.end(), m[0].encode("latin-1").decode("utf-8")) for m in _UTF8.finditer(b)]
        if written in SINGLE:
            # Word by word, as a text may be damaged in part; a capital behind a small letter may begin the damage, too.
            for m in _WORD.finditer(b):
                word = text[m.start() : m.end()]
                cuts = [0, *(x.start() + 1 for x in _INNER.finditer(word)), len(word)]
                out += [(m.start() + i, m.start() + j, m[0][i:j].encode("latin-1").decode(written, "replace")) for i, j in zip(cuts, cuts[1:], strict=False)]
            return out
        for m in _MAPPED.finditer(b):
            out += _decodable(b, m.start(), m.end(), written)
        return out
    if read_as in ("latin-1", "ascii"):
        for m in (_NULS if read_as == "latin-1" else _UTF7).finditer(text):
            try:
                out.append((m.start(), m.end(), m[0].encode(read_as).decode(written)))
            except UnicodeError:
                continue
        return out
    for m in _WIDE.finditer(text):
        try:
            b = m[0].encode(read_as).decode("latin-1")
        except UnicodeError:
            continue
        good = "".join(x[0] for x in _UTF8.finditer(b))
        # Bytes at the edges of the run may have been lost.
        if good and len(good) * 10 >= len(b) * 6:
            out.append((m.start(), m.end(), good.encode("latin-1").decode("utf-8") + "�" * (len(good) < len(b))))
    return out


def _undo(text: str, chain: tuple[str, ...]) -> list[tuple[int, int, str]]:
    """Replacements that undo a whole chain; of two misreadings the line is one stretch."""
    first = [x for x in _undo_once(text, chain[0], chain[1]) if x[2] != text[x[0] : x[1]]]
    if len(chain) == 2 or not first:
        return first
    for k in range(0, len(chain), 2):
        spans = _undo_once(text_now, chain[k], chain[k + 1]) if k else first
        if not spans:
            return []
        text_now = _spliced(text if not k else text_now, spans)
    return [(0, len(text), text_now)]


def _spliced(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for lo, hi, new in spans:
        parts += [text[at:lo], new]
        at = hi
    return "".join([*parts, text[at:]])


def _possible(foreign: frozenset[str], chain: tuple[str, ...], wide: bool, plain: bool) -> bool:
    """False where undoing the chain can't change a text with these non-ASCII characters."""
    if chain[0] in ("latin-1", "ascii"):
        return plain
    if chain[0] not in TABLES:
        return wide
    if chain[1] == "utf-8":
        return not LEADS[chain[0]].isdisjoint(foreign) and not FOLLOW[chain[0]].isdisjoint(foreign)
    return not MAPPED[chain[0]].isdisjoint(foreign)


def readings(text: str) -> list[tuple[int, int, int, str]]:
    """All stretches that some chain can undo: (number of the chain, start, end, restored)."""
    foreign = frozenset(c for c in text if c > "\x7f")
    wide = any(c >= "⺀" for c in foreign)
    plain = "\x00" in text or "+" in text
    out, once = [], False
    for k, chain in enumerate(CHAINS):
        if _possible(foreign, chain, wide, plain) and (len(chain) == 2 or once):
            found = _undo(text, chain)
            out += [(k, *x) for x in found]
            once = bool(found) if k == 0 else once
    if "�" in foreign:
        out += [(len(CHAINS), m.start(), m.end(), m[0]) for m in _LOSS.finditer(text)]
    return out


#: Marks of texts that hardly are as they were written: letters joined with box
#: drawing, four foreign Latin characters in a row, capitals within Cyrillic
#: words, control and private characters, UTF-8 read as two characters.  Such lines don't count before the first round.
_ODD = re.compile("[^\\W\\d_][─-▟]|[─-▟][^\\W\\d_]|[\xa1-ſƒˆ˜–-›€™]{4}|[а-џ][А-Я]|[\x00\x80-\x9f-�]|[\xc2-\xf4][\xa0-\xbfŒœŠšŸŽžƒˆ˜–-›€™]|[√\xac‚][^\\s\\w]")
#: Log probability of a run of replacement characters under the chain that left them, and of each further one.
_LOSS_COST = (3.0, 1.0)
#: What a character counts for that a multi-byte chain lost at the end of a stretch.
_LOSS_GAIN = 5.0


def _seq_type(pairs: int) -> type:
    """Of the places in an array of so many pairs."""
    return np.uint16 if pairs <= 1 << 16 else np.int32


class _Blob:
    """Lines and their readings as arrays of pair numbers."""

    def __init__(self) -> None:
        self.records: list = []
        self.units: list = []
        self.spans: list = []
        self.seq: list[int] = []
        self.lengths: list[int] = []
        self.local: dict[str, int] = {}

    def _put(self, text: str) -> None:
        local = self.local
        self.seq += [local.setdefault(text[i : i + 2], len(local)) for i in range(len(text) - 1)]
        self.lengths.append(max(0, len(text) - 1))

    def add(self, source: str, rec_id, text: str) -> None:
        at = 0
        self.records.append((source, rec_id, text))
        for line in text.split("\n"):
            hits = [m.span() for m in _TRACE.finditer(line)]
            if hits:
                # All that can change lies between the first and the last trace and a few characters after it.
                lo, hi = max(0, hits[0][0] - 2), min(len(line), hits[-1][1] + 2)
                part = line[lo:hi]
                t = f" {part} "
                self.units.append((len(self.records) - 1, at + lo, at + hi, _ODD.search(part) is not None))
                self._put(t)
                for k, a, b, new in readings(part):
                    # Both readings of the stretch, between the characters around it.
                    self._put(t[a] + part[a:b] + t[b + 1])
                    self._put("" if k == len(CHAINS) else t[a] + new + t[b + 1])
                    extra = -_LOSS_COST[0] - _LOSS_COST[1] * (b - a) if k == len(CHAINS) else _LOSS_GAIN * new.endswith("�")
                    self.spans.append((len(self.units) - 1, k, at + lo + a, at + lo + b, new, extra))
            at += len(line) + 1

    def row(self) -> dict:
        """The arrays as bytes, the texts apart from them."""
        u, s = self.units, self.spans
        kinds = sorted({r[0] for r in self.records})
        return {
            "sources": kinds,
            "unit": np.array([[kinds.index(self.records[x[0]][0]), x[3]] for x in u], dtype=np.int32).tobytes(),
            "span": np.array([[x[0], x[1]] for x in s], dtype=np.int32).tobytes(),
            "extra": np.array([x[5] for x in s], dtype=np.float64).tobytes(),
            "pairs": np.array([pair_key(p) for p in self.local], dtype=np.int64).tobytes(),
            "seq": np.array(self.seq, dtype=_seq_type(len(self.local))).tobytes(),
            "lengths": np.array(self.lengths, dtype=np.int32).tobytes(),
            "texts": json.dumps([self.records, [x[:3] for x in u], [x[2:5] for x in s]]),
        }


_ARRAYS = "sources array<string>, unit binary, span binary, extra binary, pairs binary, seq binary, lengths binary"


class _Posterior:
    """Posteriors of the chains of each line and of each stretch, under a model."""

    def __init__(self, row, model: Model):
        unit = np.frombuffer(row["unit"], dtype=np.int32).reshape(-1, 2)
        span = np.frombuffer(row["span"], dtype=np.int32).reshape(-1, 2)
        self.keys = np.frombuffer(row["pairs"], dtype=np.int64)
        self.seq = np.frombuffer(row["seq"], dtype=_seq_type(len(self.keys)))
        self.lengths = np.frombuffer(row["lengths"], dtype=np.int32)
        self.sources, self.odd, self.source = list(row["sources"]), unit[:, 1] > 0, unit[:, 0]
        n, c = len(unit), len(NAMES)
        logp = np.fromiter((model.logp(k) for k in self.keys.tolist()), dtype=np.float64, count=len(self.keys))
        ends = np.cumsum(self.lengths)
        sums = np.concatenate([[0.0], np.cumsum(logp[self.seq])])
        sums = sums[ends] - sums[ends - self.lengths]
        # Sequences come in the order in which they were put: a line, then both readings of each of its stretches.
        self.span_unit, self.chain = span[:, 0], span[:, 1]
        per = np.bincount(self.span_unit, minlength=n) if n else np.zeros(0, dtype=np.int64)
        self.base = np.arange(n) + 2 * (np.cumsum(per) - per)
        self.old = np.arange(len(span)) * 2 + self.span_unit + 1
        gain = sums[self.old + 1] - sums[self.old] + np.frombuffer(row["extra"], dtype=np.float64) if len(span) else np.zeros(0)
        self.gain = gain
        t = np.array([model.touch(x) for x in NAMES])[self.chain]
        touched = np.where(gain > 300, gain + np.log(t), np.log1p(t * np.expm1(np.minimum(gain, 300))))
        group, self.of = np.unique(self.span_unit.astype(np.int64) * c + self.chain, return_inverse=True)
        self.g_unit, self.g_chain = group // c, group % c
        share = np.array([[model.share(s, x) for x in NAMES] for s in self.sources]).reshape(-1, c)
        sound = np.array([model.share(s, _SOUND) for s in self.sources])
        at = self.source[self.g_unit] if n else np.zeros(0, dtype=np.int64)
        self.log_odds = share[at, self.g_chain] - sound[at] + np.bincount(self.of, weights=touched, minlength=len(group))
        top = np.zeros(n)
        np.maximum.at(top, self.g_unit, self.log_odds)
        total = np.exp(-top) + np.bincount(self.g_unit, weights=np.exp(self.log_odds - top[self.g_unit]), minlength=n)
        self.p_chain = np.exp(self.log_odds - top[self.g_unit]) / total[self.g_unit]
        self.p_damaged = np.bincount(self.g_unit, weights=self.p_chain, minlength=n) if n else np.zeros(0)
        self.p_span = 1 / (1 + np.exp(-np.clip(gain + np.log(t / (1 - t)), -500.0, 500.0)))
        self.log_likelihood = float(sums[self.base].sum() + (top + np.log(total)).sum() + (sound[self.source].sum() if n else 0))

    def counts(self, plain: bool) -> tuple[np.ndarray, dict[tuple[str, str, str], float]]:
        """Expected counts of the pairs, of (source, chain) and of stretches; ``plain`` counts the lines that look sound as they are."""
        w = np.zeros(len(self.lengths))
        chains: dict[tuple[str, str, str], float] = {}
        if plain:
            w[self.base] = np.where(self.odd, 0.0, 1.0)
        else:
            w[self.base] = 1.0
            v = self.p_chain[self.of] * self.p_span
            w[self.old], w[self.old + 1] = -v, v
            # What lost characters leave of a line tells nothing.
            for s, name in enumerate(self.sources):
                own = self.source[self.g_unit] == s
                for k, x in enumerate(np.bincount(self.g_chain[own], weights=self.p_chain[own], minlength=len(NAMES))):
                    chains[("chain", name, NAMES[k])] = float(x)
                chains[("chain", name, _SOUND)] = float((1 - self.p_damaged[self.source == s]).sum())
            for what, weights in (("touched", v), ("touchable", self.p_chain[self.of])):
                for k, x in enumerate(np.bincount(self.chain, weights=weights, minlength=len(NAMES))):
                    chains[(what, "", NAMES[k])] = float(x)
        return np.maximum(np.bincount(self.seq, weights=np.repeat(w, self.lengths), minlength=len(self.keys)), 0.0), chains

    def restore(self, texts: str) -> Iterator[tuple]:
        """(source, rec_id, chain, damaged, probability, restored) of each record."""
        records, units, spans = json.loads(texts)
        by_unit: dict[int, list[int]] = {}
        for k in np.flatnonzero((self.p_span > 0.5) & (self.p_damaged[self.span_unit] > 0.5)).tolist():
            by_unit.setdefault(int(self.span_unit[k]), []).append(k)
        by_record: dict[int, list[int]] = {}
        for u, x in enumerate(units):
            by_record.setdefault(x[0], []).append(u)
        for r, (source, rec_id, text) in enumerate(records):
            names, take, p = [], [], 0.0
            for u in by_record.get(r, ()):
                p = max(p, float(self.p_damaged[u]))
                # The likeliest chain goes first; another one takes stretches that are left, if they alone make it likelier than not.
                free, groups = [], {}
                for k in by_unit.get(u, ()):
                    groups.setdefault(int(self.of[k]), []).append(k)
                for n, (g, own) in enumerate(sorted(groups.items(), key=lambda x: -self.log_odds[x[0]])):
                    own = [k for k in own if all(spans[k][1] <= lo or spans[k][0] >= hi for lo, hi in free)]
                    prior = self.log_odds[g] - sum(self.gain[k] for k in groups[g])
                    if own and (n == 0 or prior + sum(self.gain[k] for k in own) > 0):
                        free += [(spans[k][0], spans[k][1]) for k in own]
                        take += own
                        names.append(NAMES[self.g_chain[g]])
            names = list(dict.fromkeys(names))
            fixed = _spliced(text, sorted(tuple(spans[k]) for k in take))
            yield source, rec_id, BOTH.join(sorted(names, key=lambda x: x == _LOST)) if p > 0.5 and names else _SOUND, p > 0.5, p, fixed


def posterior(text: str, source: str, model: Model) -> tuple[str, str, float]:
    """(chains, restored text, probability that the text is damaged) of one text."""
    blob = _Blob()
    blob.add(source, 0, text)
    row = blob.row()
    _, _, chain, _, p, fixed = next(_Posterior(row, model).restore(row["texts"]))
    return chain, fixed, p


def _start() -> Model:
    """Before any data: how scripts, letters, quotation marks and signs are put together."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    low = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýßœšžčćđłńśźżąęěřůťďňőűğışţășțðþ"
    common = "àáâäåæçèéêíñóôöøúüß"
    cyr = "абвгдежзийклмнопрстуфхцчшщъыьэюяіїєґё"
    greek = "αβγδεζηθικλμνξοπρστυφχψωάέήίόύώς"
    pairs: Counter = Counter()

    def put(a: str, b: str, n: float) -> None:
        for x in a:
            for y in b:
                pairs[pair_key(x + y)] += n

    put(letters, letters, 5)
    put(letters, " ", 40)
    put(" ", letters, 40)
    put(letters, ",.", 8)
    put(letters, "!?:;)'\"-/", 1)
    put("(\"'-/", letters, 2)
    put(",.:;!?)", " ", 60)
    put(" ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 10)
    put("ABCDEFGHIJKLMNOPQRSTUVWXYZ", letters, 3)
    put("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.5)
    put("0123456789", "0123456789", 20)
    put(" ", "0123456789", 20)
    put("0123456789", " .,:", 20)
    put(letters, low, 0.15)
    put(low, letters, 0.15)
    put(letters, common, 1)
    put(common, letters, 1)
    put(" ", common, 2)
    put(common, " ", 2)
    put(common, ",.!?", 0.5)
    put(low, low, 0.05)
    put(" ", low.upper().replace("SS", ""), 1.0)
    put(" ", common.upper().replace("SS", ""), 2.0)
    put(common.upper().replace("SS", ""), " ", 1.0)
    put(common.upper().replace("SS", ""), common.upper().replace("SS", ""), 0.5)
    put(low.upper().replace("SS", ""), low.upper().replace("SS", "") + "A", 0.05)
    put(low.upper().replace("SS", ""), letters, 0.3)
    put("ABCDEFGHIJKLMNOPQRSTUVWXYZ", common.upper().replace("SS", ""), 0.5)
    put(common.upper().replace("SS", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.5)
    for small, n in ((cyr, 3.0), (greek, 1.0)):
        put(small, small, n)
        put(" ", small, 4 * n)
        put(small, " ", 4 * n)
        put(small, ",.!?:", n)
        put(" ", small.upper(), n)
        put(small.upper(), small, n / 6)
        put(small.upper(), small.upper(), n / 8)
        put(small.upper(), " ,.!?:", n)
    wide = "的いア한，。、"
    put(wide, wide, 200)
    put(wide, "ｱ龘\U0001f600", 1)
    put("ｱ", "ｱ", 50)
    put(" ", wide, 50)
    put(wide, " ", 50)
    put(wide, letters + "0A", 10)
    put(letters + "0A", wide, 10)
    # Quotation marks, apostrophes, dashes, dots.
    put(letters + common, "’", 6)
    put("’", letters + common + "A", 4)
    put("A", "’", 6)
    put(" (", "“„‘«»", 15)
    put(" (", "‚‹›", 4)
    put("“„‘‚«‹»", letters + cyr, 2)
    put("“„‘‚«‹»", "AAAAAAAAAA0" + common, 2)
    put("«»–—‹›", " ", 20)
    put(" ", "–—…•", 20)
    put(" ", "·", 4)
    put("•·", " ", 20)
    put(letters + cyr + greek, "”“’»…", 2)
    put(".,!?0", "”“’»", 10)
    put("”“’»", " ", 60)
    put("”“’»", ".,!?:;)", 10)
    put("…", " .\"”»", 30)
    put("0", "–°€%′″½×™…", 15)
    put("–°±×€£≈≤≥", "0", 15)
    put("°", "A ", 5)
    put(" ", "°±×€£§©®µ½¼¾→←↑↓★✓■●", 3)
    put("°±×€£©®µ½¼¾²³→←↑↓★✓■●", " ", 4)
    put("0", "²³½", 4)
    put(letters, "™®²³", 2)
    put("™®²³", " .,", 15)
    put("§", "0 ", 40)
    put("§", "abcdefklmnor", 10)
    put(" ", "¡¿", 30)
    put("¡¿", "A" * 20 + letters, 2)
    for lead, line, end in (("╔╚╠║", "═", "╗╝╣║"), ("┌└├│", "─", "┐┘┤│"), ("█▓▒░■", "█▓▒░■", "█▓▒░■")):
        put(" ", lead + line + end, 10)
        put(lead, line, 40)
        put(line, line, 60)
        put(line, end + " ", 20)
        put(end, " ", 20)
    put(" ", "\U0001f600", 10)
    put("\U0001f600", "\U0001f600 ", 10)
    return Model(dict(pairs))


def _blobs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    blob = _Blob()
    for pdf in batches:
        for s, i, t in zip(pdf["source"].to_list(), pdf["rec_id"].to_list(), pdf["text"].to_list(), strict=True):
            blob.add(s, i, t)
            if len(blob.seq) > 400_000:
                yield pd.DataFrame([blob.row()])
                blob = _Blob()
    if blob.records:
        yield pd.DataFrame([blob.row()])


def _expect(model: Model, plain: bool):
    """Expected counts under ``model``: rows (what, source or null, name, pair, n)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs: Counter = Counter()
        other: Counter = Counter()
        for pdf in batches:
            for row in pdf.to_dict("records"):
                p = _Posterior(row, model)
                n, chains = p.counts(plain)
                for k in np.flatnonzero(n).tolist():
                    pairs[int(p.keys[k])] += float(n[k])
                for k, x in chains.items():
                    other[k] += x
                other[("total", "", "")] += p.log_likelihood
                other[("lines", "", "")] += len(p.base)
        rows = [("pair", "", "", k, n) for k, n in pairs.items()] + [(*k, 0, n) for k, n in other.items()]
        yield pd.DataFrame(rows, columns=["what", "a", "b", "pair", "n"])

    return run


#: Rounds end where the mean log likelihood of a line moves by less, or here.
SETTLED, ROUNDS = 0.02, 8


def fit(blobs: DataFrame, rounds: int = ROUNDS) -> Model:
    """EM over the written readings, begun with the lines that look sound, as they are.  At most ``rounds``
    rounds; fewer once the log likelihood a line settles.  What reaches the driver is bounded by the chains
    times the sources and by the square of the some 900 classes."""
    start = _start()
    model, before = start, None
    for k in range(rounds + 1):
        rows = blobs.drop("texts").mapInPandas(_expect(model, k == 0), "what string, a string, b string, pair long, n double").groupBy("what", "a", "b", "pair").agg(F.sum("n").alias("n")).collect()
        pairs, shares, touched, total = dict(start.pairs), {}, {}, {}
        for r in rows:
            if r.what == "pair":
                # A lost character tells nothing of the language.
                if _LOST_CLASS not in (r.pair >> 21, r.pair & 0x1FFFFF):
                    pairs[r.pair] = pairs.get(r.pair, 0.0) + r.n
            elif r.what == "chain":
                shares.setdefault(r.a, {})[r.b] = r.n
            elif r.what.startswith("touch"):
                touched.setdefault(r.b, {})[r.what] = r.n
            else:
                total[r.what] = r.n
        model = Model(pairs, shares, touched)
        now = total.get("total", 0.0) / max(1.0, total.get("lines", 0.0))
        if k and before is not None and abs(now - before) < SETTLED:
            break
        before = now if k else None
    return model


def repair(records: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``source, rec_id, chain, damaged, probability, restored`` for each record
    of ``source, rec_id, text`` that holds a character beyond ASCII, a zero
    character or a run in UTF-7; no chain can change any other, so they are
    sound and have no row.

    ``damaged`` holds where a line is likelier damaged than not; ``restored`` is
    the text with each damaged line's likeliest chain undone wherever that is
    likelier than not.  The stretches that this chain leaves may have chains of
    their own; ``chain`` then names all of them with " + " between; "lost" is the
    chain that left replacement characters.
    Null and empty texts have no row; equal records count once; an empty table
    gives an empty result; other columns, whatever their names, are not read.
    """
    some = records.select("source", "rec_id", "text").where(F.col("text").rlike(TRACE)).distinct()
    blobs = stage_table(some.mapInPandas(_blobs, _ARRAYS + ", texts string"), "mojibake", wide=True)
    model = fit(blobs, rounds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                yield pd.DataFrame(list(_Posterior(row, model).restore(row["texts"])), columns=["source", "rec_id", "chain", "damaged", "probability", "restored"])

    return blobs.mapInPandas(run, "source string, rec_id long, chain string, damaged boolean, probability double, restored string")
