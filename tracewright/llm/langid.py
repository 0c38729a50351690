"""The language of each document and of each stretch of it.

Method: rank-order profiles.  The character n-grams of a sentence are ranked by
how often they occur in it (equal ones share a rank) and compared with the ranked
n-grams of each language by their out-of-place distance, in every script alike.
The profiles are fitted on a bounded sample of labelled documents
(``PER_LANGUAGE`` documents of each language of the list, ``SENTENCES`` sentences
of those), first by label, then twice more without the documents and sentences
that the profiles so far place nearer to another language, as some labels are wrong.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_LANGUAGE = 200
SENTENCES = 2000
PROFILE = 6000
LONGEST_GRAM = 4
SLACK = 1.1
#: Below this confidence a sentence goes with the others of its script.
UNSURE = 0.62

# Three-letter codes and own names of languages.
OTHER_NAMES = {
    "eng": "en", "zho": "zh", "chi": "zh", "cmn": "zh", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "ita": "it", "nld": "nl", "dut": "nl",
    "rus": "ru", "ukr": "uk", "jpn": "ja", "kor": "ko", "deutsch": "de", "français": "fr", "francais": "fr", "español": "es", "espanol": "es", "português": "pt", "portugues": "pt",
    "italiano": "it", "nederlands": "nl", "русский": "ru", "українська": "uk", "日本語": "ja", "中文": "zh", "汉语": "zh", "한국어": "ko", "mandarin": "zh", "castilian": "es", "brazilian": "pt", "flemish": "nl",
}
# Cyrillic letters as they are typed on a Latin keyboard.
TYPED = dict(zip("абвгґдеєёжзиіїйклмнопрстуфхцчшщъыьэюя", "a b v g g d e ye yo zh z i i yi y k l m n o p r s t u f kh ts ch sh shch _ y _ e yu ya".replace("_", "").split(" "), strict=True))


def label_code(label: Column, languages: list[tuple[str, str]]) -> Column:
    """The code that a label stands for, whatever its case, region or spelling; null if it names no language."""
    names = {c.lower(): c for c, _ in languages} | {n.lower(): c for c, n in languages}
    names |= {k: v for k, v in OTHER_NAMES.items() if v in {c for c, _ in languages}}
    lookup = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    t = F.lower(F.trim(F.regexp_replace(label, r"[\s ]+", " ")))
    return F.coalesce(F.try_element_at(lookup, t), F.try_element_at(lookup, F.regexp_extract(t, r"^([^-_\s(.@]+)", 1)))


# Lines that hold no language: log lines, stack frames, code, tables of keys, indented fields, speakers.
_NO_LANGUAGE = re.compile(
    r"^\s*(?:```|\[?\d\d:\d\d:\d\d|\[\d|\x1b\[|\d{2,4}-\d\d(?:-\d\d)?[ T]\d\d:|\d{10,}\||[\w.-]+-\d+ +\| |\{|\}|<\?|</|"
    r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) +\d|time=|at [\w.$]+\(|Caused by:|Suppressed:|\.\.\. \d+ more|\|- |-- .* --$|"
    r"(?-i:(?:[a-z][\w$]*\.){2,}\w+)|(?-i:(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|SEVERE|FATAL|FINE|FINER|FINEST|CONFIG)\b:? )|@\S+ \(\d+\):|\"[\w@.]+\": |[0-9a-f]{8}[:\s]|#{1,6} |> \[)|^[ \t]+\w[\w ]{0,30}: ",
    re.I,
)
#: A line of a dump; the line above the first one is its caption.
_DUMP = re.compile(r"\s*[0-9a-f]{8}[:\s]")
_FENCE = re.compile(r"^\s*```")
_BULLET = re.compile(r"^\s*(?:[-*•>]|\d+[.)])\s+")
_END = re.compile(r"(?<=[.!?…。！？])[\s]+|(?<=[。！？])")
#: Words of a language; not paths, versions, handles and names with capitals or digits inside.
_WORDS = re.compile(r"(?<![^\s\"'“„«»‘(¿¡—–-])[^\W\d_]['’]?[^\W\d_A-ZА-Я]*(?:['’-][^\W\d_]*)*(?![^\s\"'”“»’)\].,;:!?…—–-]|[.:]\w)")
#: Runs of letters of scripts that are written without spaces or with particles joined to other words.
_RUNS = re.compile(r"[ぁ-ゖァ-ヺー一-鿿㐀-䶿々]+|[가-힣]+")
_CYR = re.compile(r"[Ѐ-ӿ]")
_LAT = re.compile(r"[A-Za-zÀ-ɏ]")


def stretches(text: str) -> list[tuple[int, int, str]]:
    """(start, end, sentence) of all that may have a language."""
    out, at, fenced, log = [], 0, False, False
    lines = text.splitlines(keepends=True)
    for line, below in zip(lines, [*lines[1:], ""], strict=False):
        lo, at = at, at + len(line)
        if _FENCE.match(line):
            fenced = not fenced
            continue
        body = line.rstrip()
        # An indented or empty line below a log line belongs to it.
        if log and (not body or body[0] in " \t"):
            continue
        log = _NO_LANGUAGE.match(line) is not None or _DUMP.match(below) is not None
        if fenced or log:
            continue
        m = _BULLET.match(body)
        k = m.end() if m else 0
        for e in [*(m.end() for m in _END.finditer(body, k)), len(body)]:
            if e > k:
                out.append((lo + k, lo + e, body[k:e]))
            k = e
    return out


def script_of(word: str) -> str:
    c = word[0]
    return "latin" if _LAT.match(c) else "cyrillic" if _CYR.match(c) else "hangul" if "가" <= c <= "힣" else "cjk" if _RUNS.match(c) else "other"


def words_of(sentence: str) -> tuple[str, list[str]]:
    """(script, words in lower case) of a sentence, without names, numbers and signs: those of the script with
    the most letters, where a letter of a script without spaces counts for two."""
    if sentence.upper() == sentence or sum(map(str.isupper, sentence)) * 2 > sum(map(str.isalpha, sentence)):
        sentence = sentence.lower()
    by: dict[str, list[str]] = {}
    for w in _WORDS.findall(sentence) + ([] if sentence.isascii() else _RUNS.findall(sentence)):
        k = script_of(w)
        if k in ("cjk", "hangul") and not _RUNS.fullmatch(w):
            continue
        by.setdefault(k, []).append(w.lower())
    runs = {k: [w for w in own if _RUNS.fullmatch(w)] if k in ("cjk", "hangul") else own for k, own in by.items()}
    if not runs:
        return "none", []
    return max(runs.items(), key=lambda x: (sum(map(len, x[1])) * (2 if x[0] in ("cjk", "hangul") else 1), x[0]))


def typed(word: str) -> str:
    """A Cyrillic word in Latin letters."""
    return "".join(TYPED.get(c, c) for c in word)


def grams(word: str) -> list[str]:
    """The character n-grams of a word with the spaces around it."""
    t = f" {word} "
    return [t[i : i + n] for n in range(1, LONGEST_GRAM + 1) for i in range(len(t) - n + 1) if n > 1 or t[i] != " "]


class Profiles:
    """Ranked n-grams of each language; a language may have several columns, one a way of writing it."""

    def __init__(self, counts: list[tuple[str, Counter]]):
        self.langs = tuple(dict.fromkeys(lang for lang, _ in counts))
        self.columns = np.array([self.langs.index(lang) for lang, _ in counts])
        self.ids: dict[str, int] = {}
        ranks = [[g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:PROFILE]] for _, c in counts]
        for own in ranks:
            for g in own:
                self.ids.setdefault(g, len(self.ids))
        #: One more row, for n-grams of no profile.
        self.rank = np.full((len(self.ids) + 1, len(counts)), PROFILE, dtype=np.int32)
        for k, own in enumerate(ranks):
            for r, g in enumerate(own):
                self.rank[self.ids[g], k] = r
        self.words: dict[str, list[int]] = {}
        self.sentences: dict[str, tuple[str | None, float]] = {}

    def word(self, w: str) -> list[int]:
        """The numbers of a word's n-grams; those of no profile share the last one."""
        found = self.words.get(w)
        if found is None:
            if len(self.words) > 200_000:
                self.words.clear()
            none = len(self.ids)
            found = self.words[w] = [self.ids.get(x, none) for x in grams(w)]
        return found

    def distances(self, words: list[str]) -> np.ndarray:
        """Mean out-of-place distance to each language, as a share of the greatest one: how far the rank of an
        n-gram among those of the words is from its rank in the profile."""
        ids = np.array([i for w in words for i in self.word(w)])
        known, n = np.unique(ids, return_counts=True)
        lost = int(n[-1]) if known[-1] == len(self.ids) else 0
        if lost:  # n-grams of no profile are out of place altogether, each for itself
            known, n = known[:-1], n[:-1]
        size = len(known) + lost
        # Ranked by number of occurrences; equally frequent ones share the first of their ranks.
        above = np.concatenate([[0], np.cumsum(np.bincount(n)[::-1])])[::-1] if len(n) else np.zeros(2)
        own = above[n + 1] if len(n) else np.zeros(0)
        d = np.abs(self.rank[known] - own[:, None]).sum(axis=0) + lost * PROFILE
        each = np.full(len(self.langs), np.inf)
        np.minimum.at(each, self.columns, d / (size * PROFILE))
        return each


class LanguageModel:
    def __init__(self, profiles: Profiles):
        self.profiles = profiles

    def sentence(self, raw: str) -> tuple[str | None, float, str]:
        """(language, confidence, script) of one sentence; (None, 0, script) if it is shorter than a sentence."""
        script, words = words_of(raw)
        letters = sum(map(len, words))
        short = letters < 4 if script in ("cjk", "hangul") else len(words) < 3 or letters < 8
        return (None, 0.0, script) if short else (*self.closest(words), script)

    def closest(self, words: list[str]) -> tuple[str | None, float]:
        p, key = self.profiles, " ".join(words)
        found = p.sentences.get(key)
        if found is None:
            if len(p.sentences) > 100_000:
                p.sentences.clear()
            d = p.distances(words)
            k = int(d.argmin())
            best = float(d[k])
            second = float(np.delete(d, k).min()) if len(d) > 1 else 1.0
            # Beyond 0.9 hardly an n-gram is of any language.
            found = p.sentences[key] = (None, 0.0) if best > 0.9 else (p.langs[k], min(1.0, 0.5 + (second - best) / max(second, 1e-6) * 2))
        return found

    def document(self, text: str) -> list[tuple[int, int, str, float]]:
        """Stretches (start, end, language, confidence); neighbours of one language are joined."""
        found = [(lo, hi, *self.sentence(s)) for lo, hi, s in stretches(text)]
        found = [x for x in found if x[2]]
        # A sentence that could be either is given to the language of the surer sentences of its script around it.
        weight: dict[str, Counter] = {}
        for lo, hi, lang, c, script in found:
            weight.setdefault(script, Counter())[lang] += (hi - lo) * c
        out: list[list] = []
        for lo, hi, lang, c, script in found:
            if c < UNSURE and len(weight[script]) > 1:
                lang = weight[script].most_common(1)[0][0]
            if out and out[-1][2] == lang:
                n, m = out[-1][1] - out[-1][0], hi - lo
                out[-1][3] = (out[-1][3] * n + c * m) / (n + m)
                out[-1][1] = hi
            else:
                out.append([lo, hi, lang, c])
        return [tuple(x) for x in out]


def _nearest(p: Profiles, words: list[str], code: str, slack: float) -> bool:
    d = p.distances(words)
    return code in p.langs and d[p.langs.index(code)] <= d.min() * slack


def fit(rows: list[tuple[str, str]]) -> LanguageModel:
    """Profiles from (code, text) of labelled documents, in three rounds: the later
    ones leave out documents that are nearer to another language than to their
    label, and sentences that are clearly nearer to another one.  A language has a
    profile for the script that most of its sentences have, and one for the same
    words as they are typed in Latin letters, if that script is Cyrillic."""
    every: dict[str, list[tuple[str, list[list[str]]]]] = {}
    scripts: dict[str, Counter] = {}
    taken: Counter = Counter()
    for code, text in rows:
        own = [words_of(s) for _, _, s in stretches(text)]
        own = [(k, w) for k, w in own if sum(map(len, w)) >= (4 if k in ("cjk", "hangul") else 16) and (k in ("cjk", "hangul") or len(w) > 3)]
        if own and taken[code] < SENTENCES:
            taken[code] += len(own)
            every.setdefault(code, []).append(own)
            scripts.setdefault(code, Counter()).update(k for k, _ in own)
    pool = {code: [d for own in docs if (d := [w for k, w in own if k == scripts[code].most_common(1)[0][0]])] for code, docs in every.items()}
    model = None
    for _ in range(3):
        counts: list[tuple[str, Counter]] = []
        for code in sorted(pool):
            words: Counter = Counter()
            for document in pool[code]:
                if model is not None and not _nearest(model.profiles, [x for w in document for x in w], code, 1.0):
                    continue
                for w in document:
                    if model is None or _nearest(model.profiles, w, code, SLACK):
                        words.update(w)
            ways = [lambda w: w] + ([typed] if scripts[code].most_common(1)[0][0] == "cyrillic" else [])
            for way in ways:
                c: Counter = Counter()
                for w, n in words.items():
                    for g in grams(way(w)):
                        c[g] += n
                counts.append((code, c))
        model = LanguageModel(Profiles(counts)) if counts else LanguageModel(Profiles([("", Counter())]))
    return model


def training_rows(documents: DataFrame, languages: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The labelled sample: at most ``PER_LANGUAGE`` documents of 80 to 4000
    characters of each language, the first by the hash of their id."""
    d = documents.select("doc_id", "text", label_code(F.col("lang"), languages).alias("code")).where("code is not null and length(text) between 80 and 4000")
    w = Window.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id")
    return [(r.code, r.text) for r in d.withColumn("n", F.row_number().over(w)).where(F.col("n") <= PER_LANGUAGE).orderBy("code", "n").select("code", "text").collect()]


def identify(documents: DataFrame, languages: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """``doc_id, label, code, langs, segments`` for each document.

    ``code`` is what its label stands for (null: it names no language);
    ``segments`` are its stretches as (start, end, lang, confidence) in code
    points, neighbours of one language joined; ``langs`` are their languages,
    the longest first.  Null, empty and blank texts, and texts of log lines,
    code, names and stretches shorter than a sentence have empty arrays.  Each
    row is a document, repeated ones too; an empty table gives an empty
    result; other columns, whatever their names, are not read.
    """
    known = [(r.lang_code, r.lang_name) for r in languages.select("lang_code", "lang_name").collect()]
    model = model or fit(training_rows(documents, known))
    allowed = {c for c, _ in known}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            langs, segs = [], []
            for t in pdf["text"].to_list():
                found = [x for x in model.document(t) if x[2] in allowed] if t else []
                size: Counter = Counter()
                for lo, hi, lang, _ in found:
                    size[lang] += hi - lo
                langs.append([x for x, _ in size.most_common()])
                segs.append([{"start": a, "end": b, "lang": c, "confidence": p} for a, b, c, p in found])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "code": pdf["code"], "langs": langs, "segments": segs})

    d = documents.select("doc_id", F.col("lang").alias("label"), label_code(F.col("lang"), known).alias("code"), "text")
    return d.mapInPandas(run, "doc_id long, label string, code string, langs array<string>, segments array<struct<start: int, end: int, lang: string, confidence: double>>")
