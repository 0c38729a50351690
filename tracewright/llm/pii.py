"""Personal information in free text: found and replaced by typed placeholders.

Method: semi-Markov conditional random field.  Candidate segments (spans of a
line) of the five types compete with each other and with plain text.  Whole-span
features (form, digits, names, words on either side) give each segment a score,
features of neighbouring segments (their types and what stands between) one for
each transition, and a dynamic program over segments of bounded length chooses
boundaries and types together.  The weights are trained here, by maximum
conditional likelihood on sentences made of general frames; names of the frames
are listed ones and made-up ones, and the list of given names is hidden from a
part of the sentences, so that forms and contexts must carry a name, too.

Candidates are looked for only behind gates, plain patterns that mean the same
to Spark and to Python; a text that passes no gate has no candidate, so Spark
keeps such texts from Python (``may_hold``).
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "person")
#: No entity is longer than this many characters.
LONGEST = 120

# Common given names, in lower case.
GIVEN = """adam adrian agnes aleksander alexander alexei alice alina amelia ana anastasia andrea andreas andrei anna anton
antonio antonia astrid beatriz benjamin bianca bruno camille carla carlos carmen caroline catherine charlotte christian
christine clara claudia daniel daria david diana diego dmitri dominik edith eduardo elena elias elise elisabeth elizabeth
ella ellen emil emilia emily emma erik eva evelyn fabian felix fernando filip florian francesca francois frank franz
freya gabriel georg george gerard giovanni giulia greta gustav hannah hans heinrich helena helga henri henry hugo ida
ignacio igor ines ingrid irene irina isabel ivan jakob jan jana javier jean johan johanna john jonas jonathan joseph
juan julia julian karin karl katarina klara konrad kristina lars laura lea lena leo leon leonie linda lisa lorenz louis
louise luca lucas lucia ludwig luis lukas magdalena manuel marco marek margot maria marie marina mario mark marta martha
martin mateo matteo matthias maximilian mia michael miguel mikael milena mira miriam nadia natalia nicolas nikola nina nora
olaf olga oliver oscar oskar otto pablo patrick paul paula pavel pedro peter petra philipp pierre rafael ricardo robert
roman rosa sabine samuel sara selma sergei simon sofia sonja stefan stella susanne sven sylvia tamara theo theresa
thomas tomas ursula valentina vera veronika victor viktor vincent vladimir walter wilhelm xenia yvonne zoe""".split()
_GIVEN = frozenset(GIVEN)
# Chinese family names of two characters, and common ones of one.
DOUBLE_SURNAMES = "欧阳 太史 端木 上官 司马 东方 独孤 南宫 万俟 闻人 夏侯 诸葛 尉迟 公羊 赫连 澹台 皇甫 宗政 濮阳 公冶 太叔 申屠 公孙 慕容 仲孙 钟离 长孙 宇文 司徒 鲜于 司空 闾丘 子车 亓官 司寇 巫马 公西 颛孙 壤驷 公良 漆雕 乐正 宰父 谷梁 拓跋 夹谷 轩辕 令狐 段干 百里 呼延 东郭 南门 羊舌 微生 公户 公玉 公仪 梁丘 公仲 公上 公门 公山 公坚 左丘 公伯 西门 公祖 第五 公乘 贯丘 公皙 南荣 东里 东宫 仲长 即墨 达奚 褚师".split()
SINGLE_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林郑谢罗梁宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"

# ---------------------------------------------------------------- gates

#: Moments as programs write them; no candidate overlaps one.
STAMP = (
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]{1,9})?|[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}[.,][0-9]{3} +[0-9]+ +[0-9]+ [A-Z] "
    r"|[0-9]{1,2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]{1,9})?|[0-9]{10,19}\|[A-Za-z]{1,7}\||\[[0-9]+[.,][0-9]+s\]"
)
# The words before identity numbers, as patterns of ASCII case folding.
ID_KEYS = (
    "ssn", r"social security(?: number| no\.?)?", "nino", r"ni number", r"national insurance(?: number| no\.?)?", r"tax[ _-]?(?:id|number|no\.?)", "tin", r"steuer-?(?:id|nummer)(?: ?nr\.?)?", r"(?:driver'?s? ?|driving ?)?licen[cs]e(?: no\.?| number)?",
    r"f(?:[üÜu]|ue)hrerschein(?: ?nr\.?|nummer)?", r"passport(?: no\.?| number)?", r"reisepass(?: ?nr\.?|nummer)?", r"passeport(?: n[°o]\.?)?", r"pasaporte(?: n[°ºo]\.?)?", r"personalausweis(?: ?nr\.?|nummer)?", r"(?:national )?id(?:entity)? card(?: no\.?| number)?", "id[- ]?number",
    "documento", "dni", "nie", "nif", "codice fiscale", "cpf", "bsn", "nir", "(?:居民)?身份证号?码?", "护照号?码?", "驾驶证号?", "社保号?", "[Пп]аспорт", "ИНН", "СНИЛС",
)
_KEYS = "(?:" + "|".join(ID_KEYS) + ")"
_UP = "A-ZÀ-ÖØ-ÞŁŚŻČŠŽĐ"
_CAP = rf"[{_UP}][^\s,;:\"()<>\[\]]*"
_EN = r"(?:Street|St\.?|Lane|Ln\.?|Drive|Dr\.?|Boulevard|Blvd\.?|Close|Road|Rd\.?|Avenue|Ave\.?|Court|Ct\.?|Way|Terrace|Crescent|Place|Square)"
_DE = r"(?:stra(?:ß|ss)e|str\.|weg|gasse|allee|platz|ufer|damm|ring|steig|pfad|hof)"
_AM = r"(?:Am|An der|Im|In der|Auf dem|Zum|Zur)"
_FR = r"(?:rue|avenue|av\.|impasse|boulevard|bd|place|chemin|quai|allée|route|cours|passage|square)"
_ES = r"(?:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Paseo|Camino|Ronda|Travesía|Via|Viale|Piazza|Corso|Rua|Travessa|Largo)"
_NL = r"(?:straat|laan|gracht|plein|kade|dijk)"
_RU = r"(?:ул\.|улица|вул\.|вулиця|пр\.|проспект|пер\.)"


def _trie(words: list[str]) -> str:
    """A pattern of words that share their beginnings, so that few are tried at a place."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    parts = [c + _trie(rest) for c, rest in sorted(heads.items())]
    body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")" if parts else ""
    return f"(?:{body})?" if "" in words and body else body


def _any_of(patterns: tuple[str, ...]) -> str:
    """Alternatives grouped by their first character, so that few are tried at a place."""
    heads: dict[str, list[str]] = {}
    for p in patterns:
        plain = p[0] not in "([\\" and p[1:2] not in ("?", "*", "+", "{")
        heads.setdefault(p[0] if plain else "", []).append(p[1:] if plain else p)
    return "(?:" + "|".join(x for c, rest in heads.items() for x in ([c + "(?:" + "|".join(rest) + ")"] if c else rest)) + ")"


_LEVEL = "(?:TRACE|DEBUG|INFO|WARN|ERROR|FATAL)"
# What several gates need; it is tested first, being cheap.
_FIVE, _SEVEN, _THEN_DIGIT, _NUMBER = r"[0-9](?:[ -]?[A-Za-z]?[0-9]){4}", r"[0-9](?:[ ./()-]{0,3}[0-9]){6}", r"[ \t][0-9]", r"[a-zß.][ \t]{1,3}[0-9]"
#: Gates by candidate family: patterns that must all be found, the last with ASCII case folded or not.  Explicit
#: classes only, so Java and Python agree; of the seven digits also once moments are left out.
GATES = {
    "caps": ((r"[A-ZÀ-ÖØ-ÞА-ЯІЇЄ][a-zß-ÿа-яіїє'’-]+[ \t]+(?:[A-ZА-Я]\.?[ \t]*)?(?:(?:de|del|di|da|van|von|der|den|la|le|al|bin|zu)[ \t]+)*[A-ZÀ-ÖØ-ÞА-ЯІЇЄ](?:[a-zß-ÿ]*+(?![ \t]?#?[0-9]*/|[ \t]?#[0-9])|[a-zß-ÿ]*+/" + _LEVEL + r"\])",), False),
    "initial": ((r"[A-Z]\.[ \t]?[A-ZÀ-ÖØ-Þ]|[^ \t],[ \t][A-Z]\.",), False),
    "given": ((r"(?<![A-Za-z])(?:" + re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", _trie(list(GIVEN))) + r")(?![A-Za-z])",), False),
    "sign": ((r"[@＠]|[A-Za-z0-9][ \t]{0,3}[ \t(\[{][ \t]*at[)\]} \t][ \t]*[A-Za-z0-9-]{1,41}[ \t]*(?:\.|[ \t(\[{]dot[ \t)\]}])",), True),
    "digits": ((_SEVEN,), False),
    "key": ((_FIVE, r"(?<![A-Za-z])" + _any_of(ID_KEYS) + r"[^0-9\n]{0,16}[0-9]"), True),
    "street_en": ((rf"[0-9][a-zA-Z]?[ \t]+(?:{_CAP.replace(chr(92) + 's', ' ' + chr(92) + 't' + chr(92) + 'n')}[ \t]+){{1,4}}{_EN}",), False),
    "street_de": ((_NUMBER, rf"{_DE}[ \t]+[0-9]|(?<![A-Za-z]){_AM}[ \t][{_UP}][^ \t\n]*[ \t](?:[^ \t\n]+[ \t])?[0-9]|{_NL}[ \t]+[0-9]"), False),
    "street_fr": ((rf"[0-9][ \t]?(?:bis|ter|quater)?[ \t]?[a-zA-Z]?,?[ \t]+{_FR}[ \t]",), False),
    "street_es": ((_THEN_DIGIT, rf"(?<![A-Za-z]){_ES}[ \t]*[^0-9\n]{{1,80}}[ \t][0-9]"), False),
    "street_cjk": ((rf"[路街道巷弄][0-9]|[市区町村][^0-9\n]{{1,10}}[0-9]|[로길] ?[0-9]|{_RU}[ \t]",), False),
    "han": (("[一-鿿]{2}", rf"(?:{_trie(DOUBLE_SURNAMES)})[一-鿿]|[{SINGLE_SURNAMES}][一-鿿]",), False),
}
_GATES = {k: tuple(re.compile(p, re.A | re.I if fold and p is ps[-1] else re.A) for p in ps) for k, (ps, fold) in GATES.items()}
_STAMP = re.compile(STAMP, re.A)


def _passes(gate: str, line: str) -> bool:
    return all(p.search(line) for p in _GATES[gate]) and (gate != "digits" or _GATES["digits"][0].search(_STAMP.sub("T", line)) is not None)


def gates(line: str) -> set[str]:
    """The gates that a text passes."""
    return {k for k in _GATES if _passes(k, line)}


def may_hold(text: Column) -> Column:
    """False only for texts without a candidate segment: those that pass no gate."""
    foreign = F.octet_length(text) > F.length(text)
    out = F.lit(False)
    for k, (ps, fold) in GATES.items():
        c = reduce(lambda a, b: a & b, [text.rlike(("(?i)" if fold and p is ps[-1] else "") + p) for p in ps])
        if k == "digits":
            c = c & F.regexp_replace(text, STAMP, "T").rlike(ps[0])
        out = out | (foreign & c if k in ("street_cjk", "han") else c)
    return out


# ---------------------------------------------------------------- candidates

_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?"
_AT = r"(?:[ \t]*[@＠][ \t]*|[ \t]*[(\[{][ \t]*(?:at|AT|At)[ \t]*[)\]}][ \t]*|[ \t]+(?:at|AT)[ \t]+)"
_DOT = r"(?:[ \t]*[(\[{][ \t]*(?:dot|DOT|Dot)[ \t]*[)\]}][ \t]*|[ \t]+(?:dot|DOT)[ \t]+|\.)"
EMAIL = re.compile(rf"(?<![\w@]){_LOCAL}{_AT}[A-Za-z0-9][A-Za-z0-9-]{{0,40}}(?:{_DOT}[A-Za-z0-9-]{{1,40}}){{1,4}}(?![\w@])")
PHONE = re.compile(r"(?<![\w.+/-])(?:\+[ \t]?|00)?\(?[0-9](?:[ ./()-]{0,3}[0-9]){6,14}(?:[ \t]?(?:ext\.?|x|Durchwahl)[ \t]?[0-9]{1,5})?(?![\w-]|\.[0-9])")
ID = re.compile(rf"(?<![A-Za-z])(?:({_KEYS})[ \t]{{0,3}}(?:[:：=#№]|no\.?|Nr\.?)?[ \t]{{0,3}}#?)?((?<![\w-])[A-Z]{{0,3}}(?:[ -]?[0-9]){{2,18}}(?:[ -]?[A-Z](?:[0-9]{{0,2}}))?)(?![\w]|[-.][0-9])", re.I)
_NAME = rf"[{_UP}](?:[\w-]|['’](?=\w))*"
_TOWNS = rf"{_NAME}(?:(?:-(?:on|sur|am|de|upon)-|[ \t]){_NAME}){{0,2}}"
_TOWN = rf"(?:,?[ \t]*[0-9]{{4,6}}[ \t]+{_TOWNS}|(?:,[ \t]*(?:Apt|Unit|Suite|Flat|No)\.? ?[0-9]+\w?)?(?:,[ \t]*{_TOWNS}(?:,?[ \t]+(?:[A-Z]{{2}}[ \t]+)?[0-9]{{4,6}})?)?)"
ADDRESS = {
    "street_en": (re.compile(rf"(?:(?:Flat|Apt|Unit)\.? ?[0-9]+\w?,[ \t]*)?(?<![\w.,-])[0-9]{{1,5}}[a-zA-Z]?[ \t]+(?:{_NAME}[ \t]+){{1,4}}{_EN}(?![A-Za-z]){_TOWN}"),),
    "street_de": (
        re.compile(rf"(?<![\w-])\w*{_DE}[ \t]+[0-9]{{1,4}}[ \t]?[a-z]?(?![\w])(?:,[ \t]*[0-9]{{4,5}}[ \t]+{_TOWNS})?"),
        re.compile(rf"(?<![\w-]){_AM}[ \t]+{_NAME}(?:[ \t]{_NAME})?[ \t]+[0-9]{{1,4}}[ \t]?[a-z]?(?![\w])(?:,[ \t]*[0-9]{{4,5}}[ \t]+{_TOWNS})?"),
        re.compile(rf"(?<![\w-]){_NAME}(?:{_NL}|weg)[ \t]+[0-9]{{1,4}}[ \t]?[a-z]?(?![\w])(?:,[ \t]*[0-9]{{4}}[ \t]?[A-Z]{{2}}[ \t]+{_NAME})?"),
    ),
    "street_fr": (re.compile(rf"(?<![\w.-])[0-9]{{1,4}}(?:[ \t]?(?:bis|ter|quater))?[ \t]?[a-zA-Z]?,?[ \t]+{_FR}[ \t]+[\w'’ À-ÿ-]{{2,40}}?(?:,[ \t]*[0-9]{{5}}[ \t]+{_TOWNS}|(?=[,\"'\].<;]|$|[ \t]+(?!(?:de|du|des|la|le|les)\b)[a-z]{{2,}}[ \t]))"),),
    "street_es": (re.compile(rf"(?<![\w-]){_ES}[ \t]+(?:[\w'’À-ÿ]+[ \t]+){{1,5}}[0-9]{{1,4}}(?![\w])(?:,[ \t]*[0-9]{{1,2}}\.?º[ \t]?[A-Z]?)?(?:,[ \t]*[0-9]{{4,5}}[ \t]+{_TOWNS})?"),),
    "street_cjk": (
        re.compile(rf"{_RU}[ \t]+[А-ЯЇІЄ][\w-]+(?:[ \t][\w-]+)?,?[ \t]+(?:д\.|дом|буд\.)?[ \t]?[0-9]{{1,4}}[ \t]?[а-я]?(?:,[ \t]*(?:кв\.)[ \t]?[0-9]+)?"),
        re.compile(r"(?:[一-鿿]{2,8}(?:省|自治区))?(?:[一-鿿]{2,8}[市州县])?(?:[一-鿿]{1,8}[区县镇])?[一-鿿]{1,8}[路街道巷弄][0-9]{1,5}号(?:[0-9]+(?:单元|栋|幢|号楼))?(?:[0-9]+室)?"),
        re.compile(r"(?:[一-龠]{2,4}[都道府県])?[一-龠ぁ-んァ-ヶ]{1,8}[市区町村][一-龠ぁ-んァ-ヶ]{1,10}[0-9]{1,3}(?:丁目|[-－])[0-9]{1,3}(?:[-－番][0-9]{1,3})?"),
        re.compile(r"[가-힣]{1,8}(?:시|도)[ \t](?:[가-힣]{1,8}(?:구|군|시)[ \t])?[가-힣0-9]{1,12}(?:로|길)[ \t]?[0-9]{1,4}(?:-[0-9]{1,3})?"),
    ),
}
_G = _trie(list(GIVEN))
_TITLES = r"(?:Dr|Mr|Mrs|Ms|Prof|Herr|Frau|Sr|Sra|Mme|Mlle|M)\.?[ \t]+"
_PART = r"(?:(?:de|del|di|da|van|von|der|den|la|le|al|bin|zu)[ \t]+)*"
_FAM = r"[A-ZÀ-ÖØ-Þ][\w'’]+(?:-[A-ZÀ-ÖØ-Þ][\w'’]+)?"
_fam = r"[^\W\d_][\w'’]+(?:-[^\W\d_][\w'’]+)?"
_LEFT, _RIGHT = r"(?<![\w@./+:#$-])", r"(?![\w@]|\.\w|[-+]\w|/(?!(?:TRACE|DEBUG|INFO|WARN|ERROR|FATAL)\])\w|[ \t]?(?:[@＠]|\(at\)|\[at\]))"
# (gate, name of the form, pattern with an optional title, given name and family name).
PERSON = (
    ("given", "given_family", re.compile(rf"{_LEFT}({_TITLES})?((?i:{_G}))(?:[ \t]+(?:[A-Z]\.[ \t]*){{1,2}}|[ \t]+)({_PART}{_fam}){_RIGHT}")),
    ("given", "family_given", re.compile(rf"{_LEFT}()({_fam}),[ \t]+((?i:{_G}))(?:[ \t]+[A-Z]\.)?{_RIGHT}")),
    ("initial", "initial_family", re.compile(rf"{_LEFT}({_TITLES})?((?:[A-Z]\.[ \t]?){{1,2}})[ \t]?({_FAM}){_RIGHT}")),
    ("initial", "family_initial", re.compile(rf"{_LEFT}()({_FAM}),[ \t]([A-Z]\.(?:[ \t]?[A-Z]\.)?)(?!\w)")),
    ("caps", "two_capitals", re.compile(rf"{_LEFT}(?=(({_TITLES})?([A-ZÀ-ÖØ-ÞА-ЯІЇЄ][a-zß-ÿа-яіїє'’-]+)(?:[ \t]+[A-ZА-Я]\.)?[ \t]+({_PART}[A-ZÀ-ÖØ-ÞА-ЯІЇЄ][\w'’]+(?:-[A-ZÀ-ÞА-Я][\w'’]+)?)){_RIGHT}(?![ \t]?#[0-9]|[ \t]?[0-9]*/(?!{_LEVEL})))")),
    ("han", "double_surname", re.compile(rf"()((?:{_trie(DOUBLE_SURNAMES)})[一-鿿]{{1,2}})()(?![一-鿿])")),
    ("han", "single_surname", re.compile(rf"(?<![一-鿿ぁ-ヿ｡-ﾟ�])()([{SINGLE_SURNAMES}][一-鿿]{{1,2}})()(?![一-鿿ぁ-ヿ｡-ﾟ�])")),
)
_BEFORE = re.compile(r"(?:([^\W_]+)[ \t]+)?([^\W_]+|[^\w\s])[^\w]{0,2}$")
_AFTER = re.compile(r"^\W{0,2}?([^\W_]+|[^\w\s])")
# Words that stand before or after persons, in lower case.
PERSONAL = frozenset("by from author authors contact maintainer owner manager mr mrs ms dr herr frau señor señora madame monsieur dear hello hi hallo hola thanks thank regards sincerely signed name named guardian tutor parent mother father brother sister wife husband customer client patient holder sender recipient employee colleague attn von an für an de por par pour door van от для 作者 译者 翻译 负责人 联系人 姓名 先生 女士 автор".split())


_FOLD = dict.fromkeys(map(ord, "123456789"), "0")
_CAMEL = re.compile(r"[a-z](?:[A-Z]|[0-9])(?<!Mc[A-Z])(?<!Mac[A-Z])")


def _shape(t: str) -> str:
    return "lower" if t.islower() else "upper" if t.isupper() else "title" if t[:1].isupper() else "mixed"


def candidates(text: str, known: bool = True) -> list[tuple[int, int, str, tuple[str, ...]]]:
    """Candidate segments: (start, end, kind, features).  Without ``known`` the list of given names isn't used."""
    passed = gates(text)
    if not passed:
        return []
    out = []
    stamps = [m.span() for m in _STAMP.finditer(text)]

    def add(lo: int, hi: int, kind: str, *own: str) -> None:
        if hi - lo > LONGEST or any(a < hi and lo < b for a, b in stamps):
            return
        # Digits of the context are folded: which ones they are tells nothing.
        w = _BEFORE.search(text[max(0, lo - 32) : lo].translate(_FOLD))
        v = _AFTER.search(text[hi : hi + 20].translate(_FOLD))
        one, two = (w[2].lower()[-12:], (w[1] or "").lower()[-12:]) if w else ("", "")
        after = v[1].lower()[:12] if v else ""
        f = [f"{kind}:bias", *(f"{kind}:{x}" for x in own), f"{kind}:<{one}", f"{kind}:<<{two} {one}", f"{kind}:>{after}"]
        if kind == "person":
            if not PERSONAL.isdisjoint((one, two)):
                f.append("person:personal_before")
            before, behind = text[:lo].rstrip(), text[hi:].strip()
            f.append("person:left_" + ("start" if not before else "mark" if not before[-1].isalnum() else "word"))
            f.append("person:right_" + ("end" if not behind else "mark" if not behind[0].isalnum() else "word"))
        out.append((lo, hi, kind, tuple(f)))

    if "sign" in passed:
        for m in EMAIL.finditer(text):
            t = m[0]
            at = "sign" if re.search("[@＠]", t) else "bracket" if re.search(r"[(\[{][ \t]*at", t, re.I) else "upper" if re.search(r"[ \t]AT[ \t]", t) else "lower"
            end = re.split(_DOT, t)[-1].lower()
            ends = "file" if end in ("jar", "zip", "json", "toml", "java", "py", "txt", "log", "class", "yml") else "digit" if any(c.isdigit() for c in end) else "short" if len(end) < 2 else "word"
            domain = re.split(_AT, t)[-1]
            dots = "spelt" if re.search(r"dot[ \t)\]}]", domain, re.I) else "sign"
            number = "domain_number" if re.match(r"[0-9]+(?:\.|$)", domain) else "domain_name"
            add(m.start(), m.end(), "email", f"at_{at}", f"{at}_{dots}", f"end_{ends}", number)
    numbers = [m for m in ID.finditer(text)] if "digits" in passed or "key" in passed else []
    keyed = {m.start(2) for m in numbers if m[1]}
    if "digits" in passed:
        for m in PHONE.finditer(text):
            t = m[0]
            bare = re.sub(r"(?i)[ \t]?(?:ext\.?|x|Durchwahl)[ \t]?[0-9]+$", "", t)
            d = sum(c.isdigit() for c in bare)
            groups = re.findall(r"[0-9]+", bare)
            start = "plus" if t[0] == "+" else "000" if t[:3] == "000" else "00" if t[:2] == "00" else "0" if t[0] == "0" else "bracket" if t[0] == "(" else "other"
            plain = len(groups) == 1
            seps = "".join(sorted(set(re.sub(r"[0-9+]", "", bare))))[:3]
            add(
                m.start(), m.end(), "phone", f"start_{start}", f"{start}_{'plain' if plain else 'split'}", f"digits_{min(d, 15)}", f"{start}_groups_{min(len(groups), 6)}", f"seps_{start}_{seps}",
                "largest_" + str(min(max(map(len, groups)), 9)), "ext" if bare != t else "no_ext", f"ends_{len(groups[-1])}", "lengths_" + "-".join(str(len(g)) for g in groups[:5]), "key" if m.start() in keyed else "no_key",
            )
    for m in numbers:
        key, v = m[1], m[2]
        d = sum(c.isdigit() for c in v)
        k = "key" if key else "no_key"
        if d >= (5 if key else 8):
            add(m.start(2), m.end(2), "id_number", k, f"{k}_{'letters' if any(c.isalpha() for c in v) else 'digits'}", f"{k}_{'split' if re.search('[ -]', v) else 'plain'}", f"{k}_{min(d, 18)}")
    for gate, forms in ADDRESS.items():
        for i, p in enumerate(forms if gate in passed else ()):
            for m in p.finditer(text):
                town = "town" if re.search(r"[0-9]{4,5}|, [A-Z]", m[0][3:]) else "no_town"
                add(m.start(), m.end(), "address", f"form_{gate}{i}", town, "short" if len(m[0]) < 25 else "long")
    for gate, name, p in PERSON:
        if gate not in passed or not known and gate == "given":
            continue
        for m in p.finditer(text):
            lo, hi = m.span()
            if name == "two_capitals":
                (title, a, b), (lo, hi) = m.groups()[1:], m.span(1)
                if known and a.lower() in _GIVEN:
                    continue
                own = [name, "title" if title else "no_title", f"caps_{len(b.split())}", "particle" if b[0].islower() else "no_particle", "hyphen" if "-" in b else "no_hyphen", "camel" if _CAMEL.search(b) else "no_camel"]
            elif name.endswith("surname"):
                own = [name]
            else:
                title, a, b = m.groups()
                if name in ("family_given", "family_initial"):
                    a, b = b, a
                sa, sb = _shape(a), _shape(b)
                own = [name, f"{name}_{sa}_{sb}", "title" if title else "no_title", f"{name}_{'short' if len(b) < 4 else 'long'}", "agree" if sa == sb else "differ"]
            add(lo, hi, "person", *own)
    return out


class SemiCRF:
    """Weights of features of whole segments and of their transitions; plain text scores 0."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.w = weights or {}

    def score(self, feats: tuple[str, ...]) -> float:
        w = self.w
        return sum(w.get(f, 0.0) for f in feats)

    @staticmethod
    def between(text: str, a: tuple, b: tuple) -> tuple[str, ...]:
        """Features of the transition from segment ``a`` to ``b`` behind it, if they are close."""
        gap = text[a[1] : b[0]]
        if len(gap) > 12:
            return ()
        mark = re.sub(r"\s+", " ", re.sub(r"\w+", "w", gap))
        return (f"{a[2]}>{b[2]}", f"{a[2]}>{b[2]}:{mark}")

    def _lattice(self, text: str, cands: list) -> tuple[list, list[list[int]], dict]:
        """Segments by end, the ones that may precede each, and the transitions' scores of the close ones."""
        cands = sorted(cands, key=lambda c: (c[1], c[0]))
        before = [[i for i in range(j) if cands[i][1] <= c[0]] for j, c in enumerate(cands)]
        close = {(i, j): f for j, c in enumerate(cands) for i in before[j] if (f := self.between(text, cands[i], c))}
        return cands, before, close

    def decode(self, text: str) -> list[tuple[int, int, str]]:
        """The best segmentation: semi-Markov Viterbi over segments."""
        cands = candidates(text)
        if not cands:
            return []
        cands, before, close = self._lattice(text, cands)
        best, back = [], []
        for j, c in enumerate(cands):
            v, b = 0.0, None
            for i in before[j]:
                x = best[i] + (self.score(close[i, j]) if (i, j) in close else 0.0)
                if x > v:
                    v, b = x, i
            best.append(v + self.score(c[3]))
            back.append(b)
        j = max(range(len(cands)), key=lambda k: best[k])
        if best[j] <= 0:
            return []
        out = []
        while j is not None:
            out.append(cands[j][:3])
            j = back[j]
        return out[::-1]

    def gradient(self, text: str, gold: set[tuple[int, int, str]], grad: dict[str, float], known: bool = True) -> float:
        """Add the gradient of the conditional log likelihood (forward-backward
        over segmentations); gives the log likelihood."""
        cands = candidates(text, known)
        if not cands:
            return 0.0
        cands, before, close = self._lattice(text, cands)
        n = len(cands)
        own = [self.score(c[3]) for c in cands]
        step = {k: self.score(f) for k, f in close.items()}

        def lse(xs: list[float]) -> float:
            m = max(xs)
            return m + math.log(sum(math.exp(x - m) for x in xs))

        fwd, bwd = [0.0] * n, [0.0] * n
        behind: list[list[int]] = [[] for _ in range(n)]
        for j in range(n):
            fwd[j] = own[j] + lse([0.0, *(fwd[i] + step.get((i, j), 0.0) for i in before[j])])
            for i in before[j]:
                behind[i].append(j)
        for i in range(n - 1, -1, -1):
            bwd[i] = lse([0.0, *(own[j] + bwd[j] + step.get((i, j), 0.0) for j in behind[i])])
        z, ll = lse([0.0, *fwd]), 0.0
        hit = [c[:3] in gold for c in cands]

        def put(feats: tuple[str, ...], d: float) -> None:
            if abs(d) > 1e-4:
                for f in feats:
                    grad[f] = grad.get(f, 0.0) + d

        for j, c in enumerate(cands):
            ll += own[j] * hit[j]
            put(c[3], hit[j] - math.exp(fwd[j] + bwd[j] - z))
        for (i, j), f in close.items():
            # Neighbours in the truth: no true segment ends between them.
            y = hit[i] and hit[j] and not any(hit[k] and cands[i][1] <= cands[k][0] and cands[k][1] <= cands[j][0] for k in range(n))
            ll += step[i, j] * y
            put(f, y - math.exp(fwd[i] + step[i, j] + own[j] + bwd[j] - z))
        return ll - z


# ---------------------------------------------------------------- training sentences

# Common family names of several languages.
FAMILY = "Smith Jones Taylor Brown Wilson Evans Walker Wright Hughes Edwards Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Schäfer Bauer Martin Bernard Dubois Moreau Laurent Lefèvre Roux Fournier García Fernández González Rodríguez Sánchez Romero Navarro Rossi Russo Ferrari Esposito Bianchi Silva Santos Oliveira Pereira Costa Jansen Visser Bakker Mulder Novak Svoboda Kowalski Nowak Ivanov Petrov Smirnova Kuznetsova Nguyen Kim Park Chen Singh Patel Khan Haddad Cohen Okafor Mensah Johansson Nielsen Andersen Virtanen Papadopoulos Popescu Horvat Yilmaz Demir O'Neill MacDonald".split()
_ONSET = "b br c ch cl d dr f fl g gr h j k kh kl l m n p pr r s sh st t tr v w y z".split()
_VOWEL = "a e i o u ai ea ie ou".split()
_CODA = " n r l s m th nd rt ck sh ng".split(" ")


def _made_up(r: random.Random, syllables: int) -> str:
    return "".join(r.choice(_ONSET) + r.choice(_VOWEL) + (r.choice(_CODA) if r.random() < 0.5 else "") for _ in range(syllables)).capitalize()


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _family(r: random.Random) -> str:
    return r.choice(FAMILY) if r.random() < 0.4 else _made_up(r, r.choice((2, 2, 3)))


def _given(r: random.Random) -> str:
    return r.choice(GIVEN).capitalize() if r.random() < 0.75 else _made_up(r, 2)


def _person(r: random.Random) -> str:
    g, fam, x = _given(r), _family(r), r.random()
    if x < 0.08:
        return r.choice(DOUBLE_SURNAMES) + "".join(r.choice("伟敏建国晓明丽华文静志强海燕思远若兰子轩") for _ in range(r.choice((1, 2))))
    if x < 0.12:
        return r.choice(SINGLE_SURNAMES) + "".join(r.choice("伟敏建国晓明丽华文静志强海燕思远若兰子轩") for _ in range(2))
    if x < 0.20:
        return f"{fam}, {g}"
    if x < 0.28:
        return f"{g} {r.choice('ABCDEFGHJKLMNPRSTVW')}. {fam}"
    if x < 0.35:
        return f"{g[0]}. {fam}"
    if x < 0.41:
        return f"{r.choice(['Dr.', 'Mr.', 'Mrs.', 'Ms', 'Herr', 'Frau', 'Mme'])} {g} {fam}"
    if x < 0.53:
        return (f"{r.choice(GIVEN)} {fam}").lower()
    if x < 0.57:
        return (f"{r.choice(GIVEN)} {fam}").upper()
    if x < 0.63:
        return f"{g} {fam}-{_family(r)}"
    if x < 0.66:
        return f"{g} {r.choice(['van', 'de', 'von', 'da'])} {fam}"
    return f"{g} {fam}"


def _email(r: random.Random) -> str:
    g, fam = r.choice(GIVEN), re.sub(r"[^a-z]", "", _family(r).lower()) or "x"
    local = r.choice([f"{g}.{fam}", f"{g}{_digits(r, r.choice((2, 4)))}", f"{g}+list", f"{g[0]}{fam}", f"{fam}_{_digits(r, 2)}", f"{fam}-{g}", "support", "info"])
    if r.random() < 0.15:
        local = r.choice([local.upper(), local.capitalize()])
    name = _made_up(r, 2).lower()
    dom = r.choice([f"{name}.org", f"mail.{name}.com", f"{name}.co.uk", f"{name}-online.de", f"{name}.example", f"{name}.invalid", "example.com", f"dept.{name}.edu", f"{name}.net"])
    x = r.random()
    if x < 0.45:
        return f"{local}{r.choice('@@@@＠')}{dom}"
    if x < 0.6:
        return f"{local}{r.choice(['(at)', ' (at) ', '[at]', '{at}'])}{dom}"
    if x < 0.8:
        return f"{local} {r.choice(['[at]', '(at)'])} {dom.replace('.', r.choice([' [dot] ', ' (dot) ']))}"
    return f"{local} {r.choice(['AT', 'at'])} {dom.replace('.', r.choice([' DOT ', ' dot ']))}"


def _phone(r: random.Random) -> str:
    """Numbers of the usual national forms, with random digits."""
    n = lambda k: _digits(r, k)
    area = r.choice([n(2), n(3), n(4)]).replace("0", "7")
    s = r.choice([" ", " ", "-", ".", " / "])
    x = r.choice(
        [
            f"+{r.randint(1, 98)} {area} {n(3)} {n(3)}", f"+{r.randint(1, 98)} {area} {n(r.choice((5, 6, 7)))}", f"+{r.randint(1, 98)}{area}{n(7)}", f"00{r.randint(20, 98)}{area} {n(r.choice((4, 5, 6)))}", f"00{r.randint(20, 98)} {area} {n(7)}",
            f"0{area}{s}{n(r.choice((4, 5, 6)))}", f"0{area}{s}{n(5)}-{n(r.choice((2, 3)))}", f"0{n(4)} {n(6)}", f"0{n(4)} {n(3)} {n(3)}", f"0{n(1)} {n(2)} {n(2)} {n(2)} {n(2)}", f"+{r.randint(1, 98)} {n(1)} {n(2)} {n(2)} {n(2)} {n(2)}",
            f"{r.randint(2, 9)}{n(2)}-{n(3)}-{n(4)}", f"{r.randint(2, 9)}{n(2)}.{n(3)}.{n(4)}", f"({r.randint(2, 9)}{n(2)}) {n(3)}-{n(4)}", f"+1 ({r.randint(2, 9)}{n(2)}) {n(3)}-{n(4)}", f"+{r.randint(1, 98)} (0){n(2)} {n(4)} {n(4)}",
            f"1{n(2)} {n(4)} {n(4)}", f"0{n(2)}-{n(4)}-{n(4)}", f"0{n(2)}-{n(8)}", f"+{r.randint(1, 98)} {n(2)} {n(4)} {n(4)}", f"+{r.randint(1, 98)} {n(3)} {n(3)}-{n(2)}-{n(2)}", f"+{r.randint(1, 98)} {n(1)}-{n(4)}-{n(4)}", f"+{r.randint(1, 98)} {n(3)} {n(2)} {n(2)} {n(2)}",
        ]
    )
    return x + (f" {r.choice(['ext.', 'x'])} {_digits(r, r.choice((2, 3)))}" if r.random() < 0.1 else "")


def _id(r: random.Random) -> tuple[str, str]:
    """A keyword and a number of an authority's form."""
    n = lambda k: _digits(r, k)
    letter = lambda: r.choice("ABCDEFGHJKLMNPRSTVWXZ")
    key = r.choice("SSN|ssn|social security number|NINO|NI number|national insurance|tax id|tax_id|TIN|Steuer-ID|Steuernummer|driver licence|licence no.|license no.|driving licence|Führerschein Nr.|passport|passport no.|Reisepass Nr.|passeport|pasaporte|Personalausweis|ID card no.|identity card|ID number|documento|DNI|dni|NIE|codice fiscale|CPF|BSN|身份证|身份证号|护照号|驾驶证号|паспорт|ИНН".split("|"))
    v = r.choice([f"{n(3)}-{n(2)}-{n(4)}", f"{letter()}{letter()} {n(2)} {n(2)} {n(2)} {letter()}", f"{letter()}{letter()}{n(6)}{letter()}", f"{n(2)} {n(3)} {n(3)} {n(3)}", f"{n(8)}{letter()}", f"{n(8)}-{letter()}", f"{letter()}{n(8)}", f"{letter()}{letter()}{n(7)}", f"{letter()}{n(7)}", f"{letter()}{letter()}{n(6)}{letter()}{n(2)}", n(18), n(11), n(9), n(10), f"{n(2)}-{n(5)}", f"{n(4)} {n(6)}"])
    return key + r.choice([" ", ": ", "=", ":", " #", "："] if key[0].isascii() else [" ", ":", "：", ""]), v


def _address(r: random.Random) -> str:
    town = r.choice([_made_up(r, 2), _made_up(r, 2), f"{r.choice(['New', 'Upper', 'Port', 'Bad', 'San'])} {_made_up(r, 2)}", f"{_made_up(r, 2)}-{r.choice(['on', 'sur', 'am'])}-{_made_up(r, 1)}"])
    zip5, no = _digits(r, 5), r.randint(1, 480)
    name = r.choice(["Church", "Station", "Maple", "High", "Park", "Queen's", "Old Mill", "West Hill", _made_up(r, 2), f"{_made_up(r, 2)} {_made_up(r, 1)}"])
    en = f"{no}{r.choice(['', '', '', 'b'])} {name} {r.choice(['Street', 'St.', 'Lane', 'Drive', 'Blvd', 'Close', 'Rd', 'Avenue', 'Road', 'Court', 'Way', 'Ave'])}"
    return r.choice(
        [
            en,
            f"{en}, {town}",
            f"{en}, {town} {zip5}",
            f"{en}, {r.choice(['Apt', 'Unit', 'Flat'])} {r.randint(1, 40)}, {town}, {r.choice(['NY', 'CA', 'TX', 'QC'])} {zip5}",
            f"Flat {r.randint(1, 9)}, {en}, {town}",
            f"{_made_up(r, 2)}{r.choice(['straße', 'str.', 'weg', 'gasse', 'allee', 'platz'])} {no}{r.choice(['', 'a'])}",
            f"{_made_up(r, 2)}{r.choice(['straße', 'str.', 'weg', 'gasse', 'allee', 'platz'])} {no}{r.choice(['', 'a'])}, {zip5} {town}",
            f"{r.choice(['Am', 'Im', 'Zum'])} {_made_up(r, 2)} {no}, {zip5} {town}",
            f"{no % 90 + 1}{r.choice(['', ' bis', ','])} {r.choice(['rue', 'avenue', 'impasse', 'boulevard', 'place', 'quai'])} {r.choice(['de la Gare', 'du Port', 'des Lilas', 'Victor Hugo', 'Saint-Michel'])}, {zip5} {town}",
            f"{r.choice(['Calle', 'Avenida', 'Plaza', 'C/'])} {r.choice(['Mayor', 'de la Luna', 'del Sol', 'Real'])} {no % 90 + 1}, {r.randint(1, 6)}.º {r.choice('ABC')}, {zip5} {town}",
            f"{r.choice(['Via', 'Corso', 'Piazza'])} {r.choice(['Roma', 'Garibaldi', 'della Pace'])} {no % 90 + 1}, {zip5} {town}",
            f"{_made_up(r, 2)}{r.choice(['straat', 'laan', 'gracht'])} {no}, {_digits(r, 4)} AB {town}",
            f"{r.choice(['江苏省苏州市', '四川省成都市', '北京市海淀区', '', ''])}{r.choice(['人民', '中山', '解放', '和平', '长江'])}{r.choice('路街')}{no}号{r.choice(['', f'{r.randint(1, 9)}单元{r.randint(1, 20)}0{r.randint(1, 6)}室'])}",
            f"ул. {r.choice(['Ленина', 'Садовая', 'Мира'])}, д. {no % 90 + 1}",
        ]
    )


# General frames; P E T A stand for a person, an e-mail address, a
# phone number and an address, K V for a keyword and its number, W for the name
# of a thing, N for a number.
FRAMES = """{P}|- {P}|{P}.|By {P}|Written by {P}|Posted by {P} yesterday|Author: {P}|author={P}|Credits go to {P}|Many thanks to {P} for testing|Special thanks to {P}!|Copyright N {P}|Licensed to {P}|Owner: {P}|Maintained by {P}|Reviewed by {P}, merged
Request from {P}|Approved by {P} on Monday|Submitted by {P} for review|My name is {P}|my real name is {P}, ok?|I am {P} and I live at {A}|This is {P} speaking|Dear {P},|Hi {P}, how are you?|Kind regards, {P}|Grüße von {P}|Danke an {P} für alles|Merci à {P} pour son aide|Gracias a {P} por todo|Vielen Dank, {P}
Please call {P}, {T}|Contact: {P}, {T}|Contact {P} / {T}|in emergencies phone {P} / {T}|Parent: {P}|{P} has given {K}{V}|{P} showed {K}{V}|Teacher {P} said so|{P} <{E}>|{P} ({E})|"{P}" <{E}>|{P}, {E}|{P}; {A}|{P}, {A}|{P}, {K}{V}, checked|{P}: {T}|Send it to {P}, {A}|Deliver to {P}, {A}, please|administrator {P} ({E}) resigned|Partner: {P}, mail {E}
联系人:{P}|姓名:{P},电话:{T}|作者 {P}|负责人:{P},请回复|译者:{P}|翻译:{P}|автор: {P}|Спасибо, {P}
email={E}|E-mail: {E}|"email": "{E}",|mail me: {E}|Write to {E} for details|please ask {E}|Reach me at {E} or {T}|account {E} created|user {E} logged in after N ms|message sent to {E}|mailto:{E}|Bitte an {E} senden|邮箱:{E},谢谢|mail {E}, phone {T}|Your address {E} is not verified|address={E} tries=N
Call {T} now|phone: {T}|phone={T}|"phone": "{T}"|Tel. {T}|Tel.: {T}, werktags|mobile {T} did not answer|text me on {T} tonight|hotline is now {T}|our new number is {T}|sms to {T} queued|alert: target={T}|pager {T} failed|电话:{T}|手机 {T} 联系我|fax {T}|Rufnummer {T}
{K}{V}|{K}{V} accepted|form rejected: {K}{V}|please check {K}{V}|printed {K}{V} by mistake|he wanted my {K}{V} for a refund|order N: {K}{V} is valid|verified with {K}{V}|认证 {K}{V} 已提交|Bitte {K}{V} angeben
Address: {A}|address={A}|"address": "{A}"|invoice to [{A}] stored|ship it to {A}|parcel for {A} returned|we meet at {A} on Friday|party at {A} tonight|lookup of '{A}' failed|Treffpunkt: {A}|Treffen wir uns {A}, ja?|Livraison : {A}|地址:{A}|收货地址:{A}|the poster goes to {A}|{A}"""
# General sentences without personal data.
PLAIN = """session N opened|session id -N closed|seed: -N|world seed is N|build N promoted|build N.N.N.N-N done|region N, N, N saved|chunk at -N, N, -N|position (-N.N, N.N, N.N)|item N-N-N is missing|part no. N-N-N|item 000-N-N shown|serial 000-N-N|article N-N-N sold out|model N-NN|port N in use|pid N exited|took N ms (N bytes)|memory N/N bytes used|N of N done|version N.N.N-beta.N|range N-N|ratio N.N/N.N|checksum NN ok|hash 3fN9abN|id 0xN|crc N N N N|ticket N-NN-ab|offset N +N|from N to N|uid N gid N|epoch N|timer N.Ns|frames N N N N N|progress N/N
gave N W to player|dropped N W|spawned W W at N, N, N|renamed W W to W W|W W was slain by W W|player has made the advancement W W|killed by W W|shot by W W using W W|attacked by W W|New boss: W W|Fixed a crash when W W dies|Fixed W in W|Fixed W W in W W|Moved W out of the loop|Moved WW out of W|Renamed W W|Renamed W to W|Fixed WWException in WW|Fixed WError|Changed W W to W W|Improved W handling|Updated W|Ohne W geht es|Mit W W läuft es nicht|Mit der W N.N geht es|In der W N ist das so|Auf dem W W|Die W von gestern ist weg|Der W W fehlt|Beim W hängt es|Das W W geht nicht|Beim W der W stürzt es ab|Im W W|Alle W W sind weg|Kein W W mehr|Les W W sont là|Renamed W W to W W|- Renamed W W to W W|- Removed W W|* Added W W|1. Fixed W W|- Die W W|Sur la W N.N|En la W W|Nach der W W|Sans W tout va bien|Sin W W funciona|Con W W no|Since W N.N the W fails|After W W the W stops|When W W is near|The W W|Every W has W|Better W W|New W W|More W W|W W and W W merged|Added W W and W W|Removed W W|updated to W W N.N|see W W for details|Reloading W W|Loading W W|W W loaded|using W W backend|requires W W N.N.N|W W needs W W|craft N W W|open the W W menu|the W W now drops W|biome W W registered|waypoint 'W W' saved|waypoint 'W W W Street' set|texture W Street loaded|built N W Road segments|N W Lane tiles|N W Drive gears|N W Court blocks placed|laid N W Way pieces|welcome to W W|joined W W|W W joined|» W W « joined|"W W" loaded|“W W” loaded|W W™ N|Suspected Mods: W W|Description: W W|Caused by: W W|Error in W W|enemy W W appeared|W. W|quest W W finished by player|thanks to W W the game runs|from W W to W W|by W
mixin W@HEAD failed|library@N.N.N loaded|package renamed to library@N.N+xN.N.jar|core@N.N+apiN.N.N.zip|install tool@N.N.N|tool@N.N-beta.N|- uses addon@N.N+N|addon@N.N resolved|foo-N.N.jar@main|target com.acme.W@7aN4|hook W @Redirect tick@TAIL|plugin at N.N.N|crash at W.tick|started at N.N|stopped at com.acme.W.run|token @everyone|package at version N.N|config@N.json|profile N@host
at java.lang.Thread.run(Thread.java:N)|\tat com.acme.W.run(W.java:N)|java.lang.IllegalStateException: N|Exception in thread "main"|Exception ticking W at N, N, N|http://N.N.N.N:N/x|GET /api/N/N HTTP/N.N N|Listening on N.N.N.N:N|UUID NN-N-4N-aN-NN|date N-N-N|expires N/N/N|licence key missing|tax applied: N|passport module loaded|document N opened|the license N.N applies|insurance of W W|id card reader N found"""
WORDS = "Ancient Golden Iron Copper Silver Shadow Crystal Frost Ember Storm River Stone Oak Birch Royal Wild Dark Deep Fallen Hidden Lost Burning Frozen Mossy Rusty Pale Crimson Azure Dragon Golem Knight Witch Queen King Hunter Serpent Phantom Titan Wolf Spider Guardian Sentinel Sword Shield Hammer Lantern Anvil Barrel Furnace Ladder Portal Tower Temple Village Forest Ocean Desert Cavern Bridge Render Thread Server Client Worker Loader Runtime Manager Engine Native Library Graphics Driver Memory Shader Resource Pack Config Screen Button".split()


def _head(r: random.Random) -> str:
    """Heads of log lines of general programs."""
    d = lambda k: _digits(r, k)
    clock, day = f"{d(2)}:{d(2)}:{d(2)}", f"20{d(2)}-{d(2)}-{d(2)}"
    return r.choice(
        [
            f"[{clock}] [{r.choice(['main', 'Server thread', 'Render thread', 'Worker-' + d(2), 'Netty Client #' + d(1), 'Render Worker', 'Sound Engine', r.choice(WORDS) + ' ' + r.choice(WORDS)])}/{r.choice(['INFO', 'WARN', 'ERROR'])}]: ", f"[{d(2)}Mar{day[:4]} {clock}.{d(3)}] [main/INFO] [com.acme.App/CORE]: ", f"{day} {clock},{d(3)} INFO  [main] com.acme.App - ",
            f"{d(13)}|INFO|main|com.acme.App|", f"{d(2)}-{d(2)} {clock}.{d(3)}  {d(4)}  {d(4)} I App: ", f"time={day}T{clock}.{d(3)}Z level=info component=app msg=", f"Jun {d(2)} {clock} host-1 app[{d(5)}]: ", f"[{d(4)}.{d(3)}s][info   ][gc] ",
            f'{{"ts": "{day}T{clock}.{d(3)}+00:00", "level": "info", "logger": "com.acme.App", "msg": "', "INFO: ", "* ", "1. ", "  ", "<player> ", f"<User_{d(2)}> ", "[Chat] ",
        ]
    )


def training_set(n: int = 4500, seed: int = 7) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """Sentences with their segments; half of them hold none."""
    r = random.Random(seed)
    frames = [f for line in FRAMES.split("\n") for f in line.split("|")]
    plain = [f for line in PLAIN.split("\n") for f in line.split("|")]

    def fill_plain(t: str) -> str:
        t = re.sub(r"N", lambda _: _digits(r, r.choice((1, 2, 2, 3, 4, 5, 7, 10, 13, 19))), t)
        t = t.replace("WW", "".join(r.choice(WORDS) for _ in range(2))) if "WW" in t else t
        return re.sub(r"\bW(?=Error|Exception|\b)", lambda _: r.choice(WORDS) if r.random() < 0.7 else _made_up(r, 2), t)

    out = []
    for i in range(n):
        if i % 2:
            out.append(((_head(r) if r.random() < 0.5 else "") + fill_plain(r.choice(plain)), set()))
            continue
        k, v = _id(r)
        fill = {"P": (_person(r), "person"), "E": (_email(r), "email"), "T": (_phone(r), "phone"), "A": (_address(r), "address"), "K": (k, None), "V": (v, "id_number")}
        text, gold = _head(r) if r.random() < 0.4 else "", set()
        for part in re.split(r"(\{[PETAKV]\})", r.choice(frames)):
            if len(part) == 3 and part[0] == "{":
                s, kind = fill[part[1]]
                if kind:
                    gold.add((len(text), len(text) + len(s), kind))
                text += s
            else:
                text += re.sub(r"N", lambda _: _digits(r, r.choice((1, 2, 4))), part)
        out.append((text, gold))
    return out


#: So many sentences are read without the list of given names.
HIDDEN = 0.3


def train(n: int = 4500, rounds: int = 7, rate: float = 0.25, l2: float = 2e-3, seed: int = 7) -> SemiCRF:
    """Stochastic gradient ascent with AdaGrad steps on the conditional likelihood."""
    r = random.Random(seed)
    data = [(t, g, r.random() >= HIDDEN) for t, g in training_set(n, seed)]
    model, seen = SemiCRF(), {}
    for _ in range(rounds):
        r.shuffle(data)
        for text, gold, known in data:
            g: dict[str, float] = {}
            model.gradient(text, gold, g, known)
            for f, v in g.items():
                v -= l2 * model.w.get(f, 0.0)
                seen[f] = seen.get(f, 0.0) + v * v
                model.w[f] = model.w.get(f, 0.0) + rate * v / math.sqrt(seen[f] + 1e-6)
    model.w = {f: round(v, 4) for f, v in model.w.items()}
    return model


PLACEHOLDER = {"email": "<EMAIL>", "phone": "<PHONE>", "id_number": "<ID_NUMBER>", "address": "<ADDRESS>", "person": "<PERSON>"}


def redact(texts: DataFrame, model: SemiCRF | None = None) -> DataFrame:
    """``source, rec_id, kinds, redacted`` for each record of ``source, rec_id,
    text`` in which something was found; all other texts stay as they are.

    ``kinds`` are the distinct types found; in ``redacted`` each segment is
    replaced by the placeholder of its type and all else is unchanged.  Lines of
    a text are taken one by one, so a segment that goes on over a line's end is
    found in parts or not at all.  Null and empty texts have no row; equal records
    count once; an empty table gives an empty result; other columns, whatever
    their names, are not read.
    """
    model = model or train()
    some = texts.select("source", "rec_id", "text").where(may_hold(F.col("text"))).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, list] = {}
        for pdf in batches:
            rows = []
            for s, i, t in zip(pdf["source"].to_list(), pdf["rec_id"].to_list(), pdf["text"].to_list(), strict=True):
                parts, kinds = [], set()
                for line in t.splitlines(keepends=True):
                    # Without numbers that may be data, lines that differ in digits alone have the same segments.
                    same = line if _passes("digits", line) or _passes("key", line) else line.translate(_FOLD)
                    segs = memo.get(same)
                    if segs is None:
                        if len(memo) > 100_000:
                            memo.clear()
                        segs = memo[same] = model.decode(same)
                    at = 0
                    for lo, hi, k in segs:
                        parts += [line[at:lo], PLACEHOLDER[k]]
                        kinds.add(k)
                        at = hi
                    parts.append(line[at:])
                if kinds:
                    rows.append((s, i, sorted(kinds), "".join(parts)))
            yield pd.DataFrame(rows, columns=["source", "rec_id", "kinds", "redacted"])

    return some.mapInPandas(run, "source string, rec_id long, kinds array<string>, redacted string")
