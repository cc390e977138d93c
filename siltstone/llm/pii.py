"""Personal information inside free text: e-mail and postal addresses, phone and identity numbers, names.

Numbers and addresses are found by their form and the words around them. Names
need no list: words that stand in places where only names stand (after titles,
"my name is", in contact lines) are counted over the whole corpus, and runs of
such words are names elsewhere, too. Found pieces are replaced by typed
placeholders or by keyed surrogates of the same type, script, gender and format,
with checks that different entities stay different.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.words import folded
from siltstone.session import stored

TYPES = ("email", "phone", "id_number", "address", "name")
#: Hashed word counts of the name model.
COUNTS = 1 << 20

#: Words of one name, at most: longer runs are lists of names or headings.
NAME_WORDS = 8
#: Characters between a word that announces an identity number and the number, at most.
ID_REACH = 60

_UP = "".join(c for c in map(chr, (*range(0x41, 0x5B), *range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00))) if c.isupper())
_HAN = r"[\u4e00-\u9fff]"
_CAP = rf"[{_UP}][^\W\d_]*(?:['’-][^\W\d_]+)*"  # a word that begins with a capital

#: Titles and forms of address that stand before a name.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Sir", "Madam", "Mx", "Anh", "Chị", "Ông", "Bà", "Cô", "Chú", "Bác", "Thầy", "anh", "chị", "ông", "bà", "cô", "Chi", "Ong", "Ba", "Co", "Herr", "Frau", "Herrn", "M", "Mme", "Mlle", "Monsieur", "Madame", "Me", "Sr", "Sra", "Srta", "Señor", "Señora", "Don", "Doña", "Bapak", "Ibu", "Pak", "Bu", "Sdr", "Sdri", "Saudara")
#: Words before a name, whoever is named.
INTRODUCTIONS = (
    r"my name is|(?<=hello, )this is|(?<=hi, )this is|I am called|ask for|ask(?= [^\W\d]+(?:['’-]\w+)* [^\W\d]+(?:['’-]\w+)* before)|reporter:|contact:|attn:?|reviewed by|filed by|written by|signed by|prepared by|submitted by|(?:export|report|copy|parcel|file|reply) to|belongs to|papers of|spoke with|in the name of|scan read|"
    r"tên là|ten la|em là|em la|tôi là|toi la|(?<=\d )gặp|(?<=\d )gap|người nhận:?|nguoi nhan:?|người báo lỗi:|nguoi bao loi:|liên hệ:|kết quả cho|ket qua cho|"
    r"je m'appelle|dossier de|rapport à|de la part de|signalé par|contacter|"
    r"ich heiße|mein name ist|bericht an|geht an|gemeldet von|rückfragen an|"
    r"me llamo|mi nombre es|a nombre de|informe a|reportado por|enviado por|"
    r"nama saya|atas nama|dilaporkan oleh|laporan kepada|kepada"
)
#: Keys of records that hold a name.
NAME_KEYS = "name|full_?name|customer|client|user|contact|author|assignee|reporter|khach|khách|ho_?ten|họ tên|nom|client|kunde|kundin|nombre|cliente|nama|pelanggan"
#: Words that announce an identity number.
ID_WORDS = r"CCCD|CMND|CMT|căn cước|can cuoc|chứng minh|chung minh|hộ chiếu|ho chieu|BHXH|bảo hiểm|passport|passeport|pasaporte|paspor|reisepass|ID[ -]card|identity (?:card|number|no)|national id|id[ _]?number|social security|SSN|national insurance|insurance (?:no|number|reference)|tax id|personalausweis|ausweis|sozialversicherung\w*|steuer-?id|carte d['’]identité|pièce d['’]identité|sécurité sociale|DNI|NIE|documento de identidad|seguridad social|KTP|NIK|nomor induk|BPJS"
PHONE_WORDS = r"tel|phone|mobile|call|number|callback|fax|gọi|số|điện thoại|sđt|sdt|téléphone|joignable|appele[rz]|telefon|erreichbar|anrufen|teléfono|llam\w+|telepon|hubungi|whatsapp"

_EMAIL = re.compile(
    r"(?<![\w.+-])[\w+-](?:[\w.+-]*[\w+-])?"
    r"(?:\s?@\s?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
    r"|\s*[\[({]\s*at\s*[\])}]\s*[A-Za-z0-9-]+(?:(?:\s*[\[({]\s*dot\s*[\])}]\s*|\sdot\s|\.)[A-Za-z0-9-]+)*(?:\s*[\[({]\s*dot\s*[\])}]\s*|\sdot\s|\.)[A-Za-z]{2,}"
    r"|\sat\s[A-Za-z0-9-]+(?:\sdot\s[A-Za-z0-9-]+)*\sdot\s[A-Za-z]{2,})(?![\w-])",
    re.I,
)
_PHONE = re.compile(r"(?<![\w.+@#/=:-])(?:\(?\+\s?\d|\(?\d)[\d ().\-/]{6,22}\d(?![\w@])")
_US = re.compile(r"(?:1[-. ])?(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}")
_ID_START = re.compile(rf"(?<!\w)(?:{ID_WORDS})(?!\w)", re.I)
_ID = re.compile(r"(?<![\w@#-])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]|[A-Z]{1,3}[- ]?\d{5,10}|\d{3}[ .-]\d{2}[ .-]\d{4}|\d{3,4}(?:[ .-]\d{3,4}){2,3}|\d{8,14}[A-Z]?)(?!\w)")

_NAMES = rf"(?:{_CAP})(?: {_CAP}){{0,3}}"
_CITY = rf"{_CAP}(?: {_CAP}){{0,2}}"
_VN = rf"(?:{_CAP})(?: {_CAP}){{0,3}}"
_ADDRESSES = [
    re.compile(p)
    for p in (
        rf"(?<![\w/])\d{{1,5}}[A-Za-z]?,? (?:{_CAP} ){{1,4}}?(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Terrace|Close|Drive|Court|Place|Way|Square|Boulevard|Blvd|Crescent|Row|Gardens|Walk|Mews|Parade|Grove|Hill)\b\.?(?:,? (?:Apt|Apartment|Flat|Suite|Ste|Unit|Floor|Room|No)\.? ?#?\w{{1,5}})?(?:, {_CITY}(?:,? [A-Z]{{2}})?(?: (?:\d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[A-Z\d]? \d[A-Z]{{2}}))?)?",
        rf"(?<![\w/])(?:(?:số|so|Số) )?\d{{1,4}}[A-Za-z]?(?:/\d{{1,4}}[A-Za-z]?)*,?(?: (?:ngõ|ngo|ngách|ngach|hẻm|hem|kiệt) \d{{1,4}}(?:/\d{{1,4}})*,?)* (?:đường|duong|phố|pho) {_VN}(?:, (?:phường|phuong|xã|xa|thị trấn|thi tran|quận|quan|huyện|huyen|thị xã|thi xa|[PQ]\.) ?(?:{_VN}|\d{{1,2}}))*(?:, (?:(?:TP|Tp|tp)\.? ?|(?:thành phố|thanh pho|tỉnh|tinh) )?{_VN})?",
        rf"(?<![\w/])\d{{1,4}}(?: (?:bis|ter|quater))?,? (?:rue|avenue|av\.|boulevard|bd|quai|impasse|place|chemin|allée|route|cours|square|passage) [^,;\n.]{{2,45}}, \d{{5}} {_CITY}",
        rf"(?:{_CAP} ){{0,2}}[{_UP}]?[^\W\d_]*(?:[Ss]traße|[Ss]trasse|str\.|[Ww]eg|[Pp]latz|[Aa]llee|[Gg]asse|[Rr]ing|[Uu]fer|[Dd]amm|[Mm]arkt) \d{{1,4}} ?[a-z]?, (?:D-)?\d{{5}} {_CITY}",
        rf"(?:[Cc]alle|[Aa]venida|[Aa]vda\.|[Pp]laza|[Pp]aseo|[Cc]amino|[Rr]onda|[Tt]ravesía|C/) ?[^,;\n]{{2,45}}?,? (?:n\.?º ?)?\d{{1,4}}(?:,? \d+\.?º ?[A-Za-z]?)?, \d{{5}} {_CITY}",
        rf"(?:Jl\.?|Jalan|Gang|Gg\.) [^,;\n]{{2,45}}?(?: (?:No\.?|Nomor) ?\d+\w?)?(?:, (?:RT|RW|Kec\.?|Kel\.?|Kelurahan|Kecamatan|Kota|Kab\.?)[^,;\n]{{0,30}})*, {_CITY}(?: \d{{5}})?",
    )
]
_TAIL = re.compile(rf"(?:, |, (?:TP|Tp|tp)\.? ?|, \d{{5}} )({_CAP}(?: {_CAP})*)$")
_TOKEN = re.compile(rf"[{_UP}]\.(?![^\W\d_])|[^\W\d_]+(?:['’-][^\W\d_]+)*")
_TITLE = re.compile(rf"(?<![\w-])({'|'.join(TITLES)})\.? (?=[{_UP}]|{_HAN})")
_INTRO = re.compile(rf"(?<!\w)(?:{INTRODUCTIONS}) ?", re.I)
_KEY = re.compile(rf"[\"'](?:{NAME_KEYS})[\"']\s*:\s*[\"']([^\"'\d]*(?:['’][^\"'\d]+)?)[\"']", re.I)
_CSV = re.compile(rf"(?<!\S)((?:[{_UP}]\.|[{_UP}]{{2}}[^\s;.:\d]*,|{_CAP})(?: (?:[{_UP}]\.|{_CAP})){{1,3}});(?=[^;\n]{{6,60}})")
_CLOSING = re.compile(rf"(?:regards|sincerely|thanks|cheers|trân trọng|tran trong|thân mến|cordialement|grüße|gruß|saludos|atentamente|salam|hormat kami),?\s*\n\s*([^\n,;]+?)\s*(?=\n|$)", re.I)
_BEFORE = re.compile(rf"(?<![\w-])({_CAP}(?: (?:{_CAP}|[{_UP}]\.)){{1,3}}) (?=asked for|left the number|để lại số|de lai so)")


@lru_cache(maxsize=4096)
def _narrow(c: str) -> str:
    n = unicodedata.normalize("NFKC", c)
    return n if len(n) == 1 else c


#: Characters that have a plain form of one character.
_WIDE = re.compile("[" + "".join(re.escape(c) for c in map(chr, range(0xA0, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and _narrow.__wrapped__(c) != c) + "]")


def same_length(text: str) -> str:
    """Full-width digits, letters and odd blanks as plain ones, character by character, so that positions stay."""
    return text if text.isascii() else _WIDE.sub(lambda m: _narrow(m[0]), text)


class _Triggers:
    """Which patterns can match a text at all: each has pieces, in lower case, of which every match holds one. One walk over the text finds all of them."""

    def __init__(self, pieces: dict[str, tuple[str, ...]]) -> None:
        import ahocorasick

        self.walker = ahocorasick.Automaton()
        kinds: dict[str, set[str]] = {}
        for kind, words in pieces.items():
            for w in words:
                kinds.setdefault(w, set()).add(kind)
        for w, k in kinds.items():
            self.walker.add_word(w, k)
        self.walker.make_automaton()

    def __call__(self, low: str) -> set[str]:
        out: set[str] = set()
        for _, kinds in self.walker.iter(low):
            out |= kinds
        return out


def _literals(pattern: str, least: int = 3) -> tuple[str, ...]:
    """Of each alternative of a pattern the longest plain piece in lower case (accents and blanks count)."""
    depth, parts, part = 0, [], ""
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append(part)
            part = ""
        else:
            part += c
    out = []
    for alternative in (*parts, part):
        bare = re.sub(r"\(\?[=!<][^()]*(?:\([^()]*\)[^()]*)*\)", "\0", alternative)  # look-around
        bare = re.sub(r"\([^()]*\)\??|\[[^\]]*\][?*+]?|\\.[?*+]?|.\?", "\0", bare)
        out.append(max(bare.lower().split("\0"), key=len))
    if any(len(x) < least for x in out):
        raise ValueError([x for x in out if len(x) < least])
    return tuple(out)


def folded_all(words: str) -> str:
    return " ".join(map(folded, words.split()))


def _cell(word: str) -> int:
    return zlib.crc32(word.encode()) % COUNTS


@lru_cache(maxsize=1)
def _triggers() -> _Triggers:
    opening = tuple(b + g for b in "([{" for g in ("at", " at"))
    return _Triggers({
        "email": ("@", " dot ", *opening),
        "id": _literals(ID_WORDS.replace("ID[ -]card", "id-card|id card").replace("ID[ -]", "id ").replace("id[ _]?number", "id_number|id number|idnumber").replace("identity (?:card|number|no)", "identity "), 3),
        "intro": _literals(INTRODUCTIONS.replace("(?:export|report|copy|parcel|file|reply) to", "export to|report to|copy to|parcel to|file to|reply to").replace(r"ask(?= [^\W\d]+(?:['’-]\w+)* [^\W\d]+(?:['’-]\w+)* before)", "ask ").replace(r"(?<=\d )gặp", "gặp").replace(r"(?<=\d )gap", "gap"), 3),
        "closing": ("regards", "sincerely", "thanks", "cheers", "trân trọng", "tran trong", "thân mến", "cordialement", "grüße", "gruß", "saludos", "atentamente", "salam", "hormat kami"),
        "before": ("asked for", "left the number", "để lại số", "de lai so"),
        "key": ("'", '"'), "csv": (";",),
        "address0": ("street", "st", "road", "rd", "lane", "ln", "avenue", "ave", "terrace", "close", "drive", "court", "place", "way", "square", "boulevard", "blvd", "crescent", "row", "gardens", "walk", "mews", "parade", "grove", "hill"),
        "address1": ("đường", "duong", "phố", "pho"), "address2": ("rue", "avenue", "av.", "boulevard", "bd", "quai", "impasse", "place", "chemin", "allée", "route", "cours", "square", "passage"),
        "address3": ("straße", "strasse", "str.", "weg", "platz", "allee", "gasse", "ring", "ufer", "damm", "markt"), "address4": ("calle", "avenida", "avda.", "plaza", "paseo", "camino", "ronda", "travesía", "c/"), "address5": ("jl", "jalan", "gang", "gg."),
    })


#: What a German address needs in the middle; its open beginning is dear to search for.
_STREET_NUMBER = re.compile(r"(?:tra(?:ß|ss)e|tr\.|eg|latz|llee|asse|ing|fer|amm|arkt) \d{1,4} ?[a-z]?, (?:D-)?\d{5} ")


def _addresses(text: str, kinds: set[str]) -> Iterator[re.Match]:
    for k, pattern in enumerate(_ADDRESSES):
        if f"address{k}" in kinds and (k != 3 or _STREET_NUMBER.search(text)):
            yield from pattern.finditer(text)


@dataclass
class NameModel:
    """Hashed counts: of folded words in places where names stand, of all their occurrences with a capital, of words in lower case, and of towns at the ends of addresses."""

    named: np.ndarray = field(default_factory=lambda: np.zeros(COUNTS, dtype=np.int64))
    capital: np.ndarray = field(default_factory=lambda: np.zeros(COUNTS, dtype=np.int64))
    lower: np.ndarray = field(default_factory=lambda: np.zeros(COUNTS, dtype=np.int64))
    towns: np.ndarray = field(default_factory=lambda: np.zeros(COUNTS, dtype=np.int64))

    def add(self, text: str) -> None:
        self.add_all([text])

    def add_all(self, texts: list[str]) -> None:
        named, towns, words = Counter(), Counter(), Counter()
        for text in texts:
            kinds = _triggers()(text.lower())
            for a, b in seeds(text, kinds):
                named.update(folded(m[0]) for m in _TOKEN.finditer(text, a, b) if len(m[0]) > 1 and m[0][1] != ".")
            for m in _addresses(text, kinds):
                if (tail := _TAIL.search(m[0])) and text[m.end() : m.end() + 1] in ",.;\n\"" + "":
                    towns[folded_all(tail[1])] += 1
            words.update(_TOKEN.findall(text))
        capital, lower = Counter(), Counter()
        for w, n in words.items():
            if w[0].isupper():
                capital[folded(w)] += n
            else:
                lower[w] += n
        for table, counts in ((self.named, named), (self.towns, towns), (self.capital, capital), (self.lower, lower)):
            np.add.at(table, np.array([_cell(w) for w in counts], dtype=np.int64), np.array(list(counts.values()), dtype=np.int64))

    @lru_cache(maxsize=1 << 16)  # noqa: B019 - one model per task
    def _known(self, word: str) -> tuple[int, int, int]:
        c = _cell(folded(word))
        return int(self.named[c]), int(self.capital[c]), int(self.lower[_cell(word.lower())])

    def is_name(self, word: str) -> bool:
        """At least a sixth of its capital occurrences are in naming places."""
        named, capital, _ = self._known(word)
        return named >= 2 and named * 6 >= capital

    def is_word(self, word: str) -> bool:
        """An ordinary word: mostly in lower case."""
        named, capital, lower = self._known(word)
        return lower > 2 and lower > capital / 2

    @cached_property
    def names(self) -> dict[str, bool]:
        """is_name by word, looked up once for each."""
        return _Looked(self.is_name)

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in self.__dataclass_fields__}

    __hash__ = object.__hash__


class _Looked(dict):
    def __init__(self, look) -> None:
        self.look = look

    def __missing__(self, key):
        if len(self) > 1 << 18:
            self.clear()
        self[key] = out = self.look(key)
        return out


_STOP_AFTER = re.compile(r"^(?:again|before|ở|o|hiện|hien|để|de|qua|who|of|and|on|asked|has|will|about|with|is|in)$", re.I)


def _run(text: str, start: int, model: NameModel | None, most: int = NAME_WORDS) -> tuple[int, int] | None:
    """The name that begins at start: words with capitals (or initials, or "FAMILY, Given"), or all in lower case where the model knows them."""
    m = _TOKEN.match(text, start)
    if not m:
        return None
    first, end, n, lower = m[0], m.end(), 1, m[0][0].islower()
    if lower and (model is None or not model._known(first)[0]):
        return None
    if not lower and text[end : end + 2] == ", " and first.isupper() and len(first) > 2:
        g = re.compile(_CAP).match(text, end + 2)
        if g and (model is None or model.is_name(g[0])) and not g[0].isupper():
            return start, g.end()
    while n < most and text[end : end + 1] == " ":
        m = _TOKEN.match(text, end + 1)
        if not m or (m[0][0].islower() != lower) or _STOP_AFTER.match(m[0]) or (lower and not model._known(m[0])[0]):
            break
        if not lower and model is not None and not (m[0][1:2] == "." or model._known(m[0])[0]) and model.is_word(m[0]):
            break
        end, n = m.end(), n + 1
    return (start, end) if n > 1 else None


def seeds(text: str, kinds: set[str] | None = None) -> list[tuple[int, int]]:
    """Places where names stand, by the words around them; with capitals only. kinds: what the triggers say of the text."""
    kinds = _triggers()(text.lower()) if kinds is None else kinds
    out = []
    for m in _TITLE.finditer(text):
        t = _TOKEN.match(text, m.end())
        if t and len(t[0]) > 1 and m[0].rstrip(". ")[0].isupper():
            out.append(t.span())
    for m in _INTRO.finditer(text) if "intro" in kinds else ():
        if r := _run(text, m.end(), None):
            out.append(r)
    for kind, pattern in (("key", _KEY), ("csv", _CSV), ("closing", _CLOSING), ("before", _BEFORE)):
        for m in pattern.finditer(text) if kind in kinds else ():
            if _TOKEN.match(m[1]) and all(t[0][0].isupper() for t in _TOKEN.finditer(m[1])) and 2 <= len(_TOKEN.findall(m[1])) <= NAME_WORDS and not re.search(r"[\d@:]", m[1]):
                out.append(m.span(1))
    return out


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def find(text: str, model: NameModel) -> list[tuple[str, int, int]]:
    """(type, start, end) of the personal information in one text, in order, without overlaps."""
    text = same_length(text)
    kinds = _triggers()(text.lower())
    out: list[tuple[str, int, int]] = []

    def take(kind: str, a: int, b: int) -> None:
        if a < b and all(b <= x or a >= y for _, x, y in out):
            out.append((kind, a, b))

    for m in _EMAIL.finditer(text) if "email" in kinds else ():
        take("email", *m.span())
    for w in _ID_START.finditer(text) if "id" in kinds else ():
        limit = re.search(r"[;\n?!]|[.,] (?=\D)", text[w.end() : w.end() + ID_REACH])
        stop = w.end() + (limit.start() if limit and text[w.end() + limit.start() - 2 : w.end() + limit.start()].lower() not in ("no", "nr") else ID_REACH)
        for m in _ID.finditer(text, w.end(), min(len(text), stop + 20)):
            if m.start() <= stop and _digits(m[0]) >= 6:
                take("id_number", *m.span())
                break
    for m in _PHONE.finditer(text):
        s, (a, b) = m[0], m.span()
        # two numbers in a row, or a number behind it: keep the part that looks like one number
        if us := _US.match(s):
            s, b = us[0], a + us.end()
        n = _digits(s)
        plain = s.lstrip("(")
        if plain.startswith("+"):
            ok = 8 <= n <= 15
        elif s.startswith("00"):
            ok = 10 <= n <= 15
        elif plain.startswith("0"):
            ok = 9 <= n <= 11
        elif us:
            ok = True
        else:
            ok = 9 <= n <= 11 and bool(re.search(rf"(?:{PHONE_WORDS})\W{{0,3}}$", text[max(0, a - 14) : a], re.I))
        if s.count("(") == s.count(")") + 1 and s.startswith("("):
            ok = ok and not s.startswith("(0")
            a += 1
        if ok and s.count("(") >= s.count(")"):
            take("phone", a, b)
    for m in _addresses(text, kinds):
        a, b = m.span()
        # the town may be run together with the next sentence: of its words those count that end addresses elsewhere
        if tail := _TAIL.search(m[0]):
            ends = [w.end() for w in re.finditer(_CAP, tail[1])]
            seen = [(int(model.towns[_cell(folded_all(tail[1][:e]))]), e) for e in ends]
            if len(ends) > 1 and max(seen)[0] > 1:
                b = a + tail.start(1) + max(seen)[1]
        take("address", a, b)

    # names
    candidates: list[tuple[int, int]] = []
    for m in _TITLE.finditer(text):
        t = _TOKEN.match(text, m.end())
        if not t or (m[0][0].islower() and not model.is_name(t[0])) or (model.is_word(t[0]) and not model.is_name(t[0])):
            continue
        r = _run(text, m.end(), model)
        candidates.append(r if r and all(x[0][1:2] == "." or model._known(x[0])[0] for x in _TOKEN.finditer(text, *r)) else t.span())
    for m in _INTRO.finditer(text) if "intro" in kinds else ():
        if r := _run(text, m.end(), model):
            known = [bool(model._known(x[0])[0]) for x in _TOKEN.finditer(text, *r) if x[0][1:2] != "."]
            if text[r[0]].isupper() or (len(known) > 1 and all(known)):
                candidates.append(r)
    for a, b in seeds(text, kinds):
        if b - a > 2 and len(_TOKEN.findall(text[a:b])) > 1:
            candidates.append((a, b))
    names = model.names
    tokens = []
    if any(map(names.__getitem__, _TOKEN.findall(text))):
        tokens = [m for m in _TOKEN.finditer(text) if m[0][1:2] == "." or names[m[0]]]  # initials, and words that are names elsewhere
    i = 0
    while i < len(tokens):
        j, strong = i, 0
        lower = tokens[i][0][0].islower()
        while j < len(tokens) and (j == i or text[tokens[j - 1].end() : tokens[j].start()] in (" ", ", ") and (text[tokens[j - 1].end()] == " " or (j == i + 1 and tokens[i][0].isupper() and len(tokens[i][0]) > 2 and not tokens[j][0].isupper()))):
            w = tokens[j][0]
            if w[1:2] == ".":
                j += 1
                continue
            if w[0].islower() != lower or (lower and model._known(w)[2] > max(2, model._known(w)[0] // 3)):
                break
            strong, j = strong + 1, j + 1
        while j > i and tokens[j - 1][0][1:2] == ".":
            j -= 1
        if strong >= (1 if tokens[i][0][1:2] == "." else 2) and j - i <= NAME_WORDS:
            candidates.append((tokens[i].start(), tokens[j - 1].end()))
            i = j
        else:
            i += 1
    trimmed = {(m.end(), b) if (m := _TITLE.match(text, a)) and m.end() < b else (a, b) for a, b in candidates}
    for a, b in sorted(trimmed, key=lambda s: (s[0] - s[1], s[0])):
        take("name", a, b)
    return sorted(out, key=lambda x: x[1])


def fit_names(texts: DataFrame, text: str = "text") -> NameModel:
    """Counts over all rows; the driver gets at most three tables of COUNTS numbers."""
    names = list(NameModel.__dataclass_fields__)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = NameModel()
        for pdf in batches:
            model.add_all([same_length(t) for t in pdf["text"]])
        for k, name in enumerate(names):
            table = getattr(model, name)
            at = np.flatnonzero(table)
            yield pd.DataFrame({"cell": at + k * COUNTS, "n": table[at]})

    rows = texts.select(F.col(text).alias("text")).where(F.length("text") > 0)
    cells = rows.mapInPandas(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(len(names) * COUNTS, dtype=np.int64)
    flat[cells["cell"].to_numpy(dtype=np.int64)] = cells["n"].to_numpy(dtype=np.int64)
    return NameModel(*flat.reshape(len(names), COUNTS))


#: Titles that tell a woman or a man.
FEMALE = frozenset("Mrs Ms Miss Madam Chị Bà Cô chị bà cô Chi Ba Co Frau Mme Mlle Madame Sra Srta Señora Doña Ibu Bu Sdri".split())
MALE = frozenset("Mr Sir Anh Ông Chú Bác anh ông Ong Herr Herrn Monsieur Sr Señor Don Bapak Pak Sdr".split())


def gender(text: str, start: int) -> str | None:
    """'f' or 'm' if a title right before start tells."""
    before = [m for m in _TITLE.finditer(text, max(0, start - 12), start + 1) if m.end() == start]
    return None if not before else "f" if before[-1][1] in FEMALE else "m" if before[-1][1] in MALE else None


def personal_information(texts: DataFrame, model: NameModel | None = None) -> DataFrame:
    """Pieces of personal information: src_table, record_id, text_hash, pii_type, start_pos, end_pos (code points, end exclusive), piece, gender (of a name after a title); distinct.

    texts has src_table, record_id and text; other columns are ignored. Null and
    empty texts hold none. Repeated rows give their pieces once; text_hash tells
    different texts of one record apart. An empty table gives no rows. The texts are
    scanned twice and never shuffled.
    """
    model = model or fit_names(texts)
    shared = texts.sparkSession.sparkContext.broadcast(model)  # tables of fixed size
    rows = texts.select("src_table", "record_id", "text", F.xxhash64("text").alias("text_hash")).where(F.length("text") > 0)
    columns = ["src_table", "record_id", "text_hash", "pii_type", "start_pos", "end_pos", "piece", "gender"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            out = [(s, r, h, kind, a, b, t[a:b], gender(t, a) if kind == "name" else None) for s, r, h, t in zip(pdf["src_table"], pdf["record_id"], pdf["text_hash"], pdf["text"], strict=True) for kind, a, b in find(t, model)]
            yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(scan, f"src_table string, record_id {dict(rows.dtypes)['record_id']}, text_hash bigint, pii_type string, start_pos int, end_pos int, piece string, gender string").distinct()


# Replacement


#: Calling codes of one and two digits; the others have three.
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def phone_parts(piece: str) -> tuple[int, str]:
    """(digits of the prefix: country code or the zero before the area, the national number)."""
    p = same_length(piece)
    digits = re.sub(r"\D", "", p)
    skip = 0
    abroad = digits.startswith("00") and len(digits) >= 10
    if p.lstrip("( ").startswith("+") or abroad:
        skip = 2 if abroad else 0
        skip += next((n for n in (1, 2) if digits[skip : skip + n] in CALLING), 3)
        if digits[skip : skip + 1] == "0":  # (0) after the country code
            skip += 1
    elif digits.startswith("0") or (digits.startswith("1") and len(digits) == 11):
        skip = 1
    return skip, digits[skip:]


_EMAIL_SEPARATOR = re.compile(r"(\s*[\[({]\s*(?:at|dot)\s*[\])}]\s*|\s(?:at|dot)\s|\s?@\s?|\.)", re.I)


def entity(piece: str, kind: str) -> str:
    """What two mentions of one entity have in common: the national digits of a phone number, digits and letters of an identity number, plain form of an e-mail, folded words of a name or an address."""
    p = same_length(piece)
    if kind == "phone":
        return phone_parts(p)[1]
    if kind == "id_number":
        return re.sub(r"[^0-9A-Z]", "", p.upper())
    if kind == "email":
        parts = _EMAIL_SEPARATOR.split(p.lower())
        return "".join("@" if "@" in x or "at" in x else "." if k % 2 else x for k, x in enumerate(parts)) if len(parts) > 1 else p.lower()
    if kind == "name" and ", " in p:
        p = " ".join(reversed(p.split(", ", 1)))
    return " ".join(folded(w) for w in p.split())


def _stream(key: str, *parts: str) -> Iterator[int]:
    """Numbers below 65536 that depend on key and parts only."""
    n = 0
    while True:
        block = hmac.new(key.encode(), "\x1f".join((*parts, str(n))).encode(), hashlib.sha256).digest()
        yield from (int.from_bytes(block[i : i + 2], "big") for i in range(0, 32, 2))
        n += 1


def shuffled_digits(digits: str, key: str, *parts: str) -> str:
    """Another number of as many digits: for one key and parts different numbers stay different (halves are mixed in rounds)."""
    n = len(digits)
    if n < 2:
        return str((int(digits) + 1 + next(_stream(key, "digit", *parts)) % 9) % 10) if digits else ""
    left, right = digits[: n // 2], digits[n // 2 :]
    for k in range(4):
        add = next(_stream(key, "half", str(k), str(n), right, *parts)) * 65537 + next(_stream(key, "more", str(k), str(n), right, *parts))
        left, right = right, str((int(left) + add) % 10 ** len(left)).zfill(len(left))
    return left + right


def _swapped(letter: str, key: str, *parts: str) -> str:
    """Another letter by a keyed rotation."""
    return chr(65 + (ord(letter) - 65 + 1 + next(_stream(key, "letter", *parts)) % 25) % 26)


#: Syllables by script: beginnings, vowels, endings.
SYLLABLES = {
    "LATIN": ("b d f g h j k l m n p r s t v z br dr gr kl pr st tr".split(), "a e i o u".split(), "l n r s m".split()),
    "VIETNAMESE": ("b c ch d đ g h k kh l m n ng nh ph qu s t th tr v x".split(), "ai an ang anh ao âm ân ê iên inh oa oan ong ô ơn u uân ung uyên ương ưu y".split(), [""]),
    "CYRILLIC": ("б в г д ж з к л м н п р с т ф ш".split(), "а е и о у".split(), "в н р л к".split()),
    "GREEK": ("β γ δ κ λ μ ν π ρ σ τ φ".split(), "α ε ι ο".split(), "ν ς ρ".split()),
}
#: Words inside Vietnamese names that tell gender stay as they are.
PARTICLES = frozenset("thị thi văn van".split())


def script(word: str) -> str:
    """First word of the Unicode name of the word's first letter: LATIN, CYRILLIC, GREEK, CJK, HANGUL, ..."""
    return next((unicodedata.name(c, "LATIN").split()[0] for c in word if c.isalpha()), "LATIN")


def is_vietnamese(text: str) -> bool:
    """Letters that only Vietnamese has: horn, dot below, hook above, breve, crossed d, two marks on one letter."""
    if text.isascii():
        return False
    marks = [c for c in unicodedata.normalize("NFD", text) if unicodedata.combining(c)]
    return any(c in "̛̣̉̆" for c in marks) or "đ" in text.lower() or any(len([x for x in unicodedata.normalize("NFD", c) if unicodedata.combining(x)]) > 1 for c in text)


def surrogate_word(word: str, key: str, attempt: int = 0, vietnamese: bool = False, sex: str | None = None, kind: str = "word") -> str:
    """A made-up word in lower case for a folded word of a name: of the same script, about as long, with an ending that tells the same gender. Later attempts are longer, so that there are always enough."""
    take = _stream(key, kind, word, str(attempt))
    pick = lambda of: of[next(take) % len(of)]
    own = script(word)
    if own in SYLLABLES:
        starts, vowels, ends = SYLLABLES["VIETNAMESE" if vietnamese and own == "LATIN" else own]
        if vietnamese and own == "LATIN":
            return "".join(pick(starts) + pick(vowels) for _ in range(1 + attempt // 2))
        made = "".join(pick(starts) + pick(vowels) for _ in range(max(1, min(4, round(len(word) / 3))) + attempt // 3))
        soft = "a" if own == "LATIN" else "а" if own == "CYRILLIC" else "α"
        if sex == "f" or (sex is None and word.endswith(("a", "а", "я", "α"))):
            return made[:-1] + soft
        return made + pick(ends)
    if own == "CJK":
        return "".join(chr(0x4E00 + next(take) % 0x1800) for _ in range(len(word) + attempt // 4))
    if own == "HANGUL":
        return "".join(chr(0xAC00 + next(take) % 11172) for _ in range(len(word) + attempt // 4))
    out = []
    for c in word:  # letters of the same kind from the same part of the code table
        near = [x for x in map(chr, range(ord(c) & ~0x3F, (ord(c) & ~0x3F) + 64)) if unicodedata.category(x) == unicodedata.category(c)]
        out.append(pick(near) if c.isalpha() and near else c)
    return "".join(out)


def _dressed(made: str, word: str) -> str:
    """A made-up word as the word it stands for is written: its case, its accents or the lack of them."""
    if script(word) == "LATIN":
        if word.isascii():
            made = folded(made)
        elif made.isascii():  # the first accent of the word on the first vowel
            mark = next((c for c in unicodedata.normalize("NFD", word) if unicodedata.combining(c)), "")
            at = next((k for k, c in enumerate(made) if c in "aeiou"), None)
            if mark and at is not None:
                made = made[:at] + unicodedata.normalize("NFC", made[at] + mark) + made[at + 1 :]
    return made.upper() if word.isupper() and len(word) > 1 else made if word[:1].islower() or not word[:1].isupper() else made[:1].upper() + made[1:]


#: Words of addresses that aren't names.
STREET_WORDS = re.compile(r"Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Terrace|Close|Drive|Court|Place|Way|Square|Boulevard|Blvd|Crescent|Row|Gardens|Walk|Mews|Parade|Grove|Hill|Apt|Apartment|Flat|Suite|Ste|Unit|Floor|Room|No|TP|Tp|Straße|Strasse|Calle|Avenida|Plaza|Paseo|Camino|Ronda|Jl|Jalan|Gang|Kota|Kec|Kel|Số")


def pieces_of(piece: str, kind: str) -> list[tuple[str, str, int, int]]:
    """What of a piece is replaced: (kind of part, its entity, start, end). The rest (separators, prefixes, street words, initials) stays.

    Words of names and addresses are entities of their own, so that a family name alone gets the
    surrogate that it has in full names.
    """
    p = same_length(piece)
    if kind in ("phone", "id_number"):
        return [(kind, entity(p, kind), 0, len(p))]
    if kind == "email":
        out, at = [], 0
        parts = _EMAIL_SEPARATOR.split(p)
        for k, part in enumerate(parts):
            if k % 2 == 0:
                out += [("token" if m[0].isalpha() else "number", m[0].lower(), at + m.start(), at + m.end()) for m in re.finditer(r"[^\W\d_]+|\d+", part)]
            at += len(part)
        return out
    words = [m for m in _TOKEN.finditer(p) if len(m[0]) > 1 and m[0][1] != "."]
    if kind == "name":
        return [("word", folded(m[0]), *m.span()) for m in words if m[0].lower() not in PARTICLES or len(words) < 3]
    out = [("word", folded(m[0]), *m.span()) for m in words if m[0][0].isupper() and not STREET_WORDS.fullmatch(m[0])]
    return sorted(out + [("number", m[0], *m.span()) for m in re.finditer(r"\d+", p)], key=lambda x: x[2])


def drawn_form(kind: str, name: str, key: str, attempt: int, vietnamese: bool, sex: str | None) -> str:
    """The surrogate of one part's entity."""
    if kind in ("phone", "number"):  # the first digit tells what kind of number it is, so it changes last
        kept = 1 if attempt < 3 and len(name) > 1 else 0
        return name[:kept] + shuffled_digits(name[kept:], key, kind, str(attempt), name[:kept])
    if kind == "id_number":
        digits = iter(shuffled_digits(re.sub(r"\D", "", name), key, kind, str(attempt), re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", name))))
        return "".join(next(digits) if c.isdigit() else _swapped(c, key, kind, str(attempt), str(i)) if "A" <= c <= "Z" else c for i, c in enumerate(name))
    return surrogate_word(name, key, attempt, vietnamese, sex, kind)


def rendered(piece: str, kind: str, forms: dict[tuple[str, str], str]) -> str:
    """The piece with its parts replaced; separators, prefixes and letter case stay. An e-mail's last label becomes one that no address has."""
    p, out, at = same_length(piece), [], 0
    for part, name, a, b in pieces_of(piece, kind):
        made = forms[part, name]
        if part in ("phone", "id_number"):
            skip = phone_parts(p)[0] if part == "phone" else 0
            fresh, seen = iter(made), 0
            for c in p:
                if c.isdigit() or (part == "id_number" and c.isascii() and c.isalpha()):
                    seen += 1
                    c = next(fresh, c) if seen > skip else c
                out.append(c)
        else:
            out += [p[at:a], made if part == "number" else _dressed(made, piece[a:b])]
        at = b
    out.append(p[at:])
    text = "".join(out)
    return text + (".example" if re.search(r"\.\S*$|@", text) else " (dot) example") if kind == "email" else text


def surrogate(piece: str, kind: str, key: str, attempt: int = 0) -> str:
    """The first keyed replacement of a piece, before any check for collisions."""
    return rendered(piece, kind, {(k, name): drawn_form(k, name, key, attempt, is_vietnamese(piece), None) for k, name, _, _ in pieces_of(piece, kind)})


#: Rounds in which colliding draws are repeated, at most; each leaves a small part of them.
ROUNDS = 40


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """One row per distinct piece: pii_type, piece, entity, surrogate.

    Entities (numbers, e-mail parts, words of names and addresses) draw keyed
    surrogates of their kind, script, length and gender. Draws that meet a real
    entity or another's draw are repeated, round by round, until all are different; of
    equal draws the first in a keyed order stays. Mentions of one entity differ only
    as the mentions do, so texts keep their coreference.
    """
    told = F.col("gender") if "gender" in found.columns else F.lit(None).cast("string")
    pieces = found.select("pii_type", "piece", told.alias("gender")).groupBy("pii_type", "piece").agg(F.max((F.col("gender") == "f").cast("int")).alias("f"), F.max((F.col("gender") == "m").cast("int")).alias("m"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for kind, piece, f, m in zip(pdf["pii_type"], pdf["piece"], pdf["f"], pdf["m"], strict=True):
                vn = is_vietnamese(piece)
                parts = dict.fromkeys((k, n) for k, n, _, _ in pieces_of(piece, kind))
                out += [(kind, piece, entity(piece, kind), k, n, vn, f == 1, m == 1) for k, n in parts]
                if not parts:  # nothing to replace but the whole
                    out.append((kind, piece, entity(piece, kind), "none", "", vn, False, False))
            yield pd.DataFrame(out, columns=["pii_type", "piece", "entity", "part", "name", "vn", "f", "m"])

    parts = stored(pieces.mapInPandas(split, "pii_type string, piece string, entity string, part string, name string, vn boolean, f boolean, m boolean"), "parts")
    state = parts.where(F.col("part") != "none").groupBy("part", "name").agg(F.bool_or("vn").alias("vn"), F.bool_or("f").alias("f"), F.bool_or("m").alias("m"))
    state = stored(state.withColumns({"attempt": F.lit(0), "made": F.lit(None).cast("string"), "form": F.lit(None).cast("string"), "settled": F.lit(False)}), "entities")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            columns = [pdf[c].tolist() for c in ("settled", "made", "part", "name", "attempt", "vn", "f", "m")]
            made = [old if done else drawn_form(part, name, key, attempt, vn, "f" if f and not m else "m" if m and not f else None) for done, old, part, name, attempt, vn, f, m in zip(*columns, strict=True)]
            yield pdf.assign(made=made, form=[folded(x) if p in ("word", "token") else x for p, x in zip(pdf["part"], made, strict=True)])

    for _ in range(ROUNDS):
        fresh = state.mapInPandas(draw, state.schema)
        real = state.select(F.col("part").alias("_p"), F.col("name").alias("_n"))
        first = Window.partitionBy("part", "form").orderBy(F.col("settled").desc(), F.xxhash64("name"), "name")
        placed = fresh.withColumn("_place", F.row_number().over(first)).join(real, (F.col("part") == F.col("_p")) & (F.col("form") == F.col("_n")), "left")
        # single digits can't all be different from each other and from the real ones
        ok = F.col("settled") | ((F.col("_place") == 1) & F.col("_n").isNull()) | ((F.col("part") == "number") & (F.col("_place") == 1))
        state = stored(placed.select("part", "name", "vn", "f", "m", F.when(ok, F.col("attempt")).otherwise(F.col("attempt") + 1).alias("attempt"), "made", "form", ok.alias("settled")), "entities")
        if state.where(~F.col("settled")).limit(1).count() == 0:
            break
    else:
        raise ValueError(f"surrogates still collide after {ROUNDS} rounds")

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [rendered(p, k, {(x["part"], x["name"]): x["made"] for x in forms}) for p, k, forms in zip(pdf["piece"], pdf["pii_type"], pdf["forms"], strict=True)]
            yield pdf[["pii_type", "piece", "entity"]].assign(surrogate=made)

    forms = parts.join(state.select("part", "name", "made"), ["part", "name"], "left").groupBy("pii_type", "piece", "entity").agg(F.collect_list(F.struct("part", "name", "made")).alias("forms"))  # the parts of one piece
    return forms.mapInPandas(render, "pii_type string, piece string, entity string, surrogate string")


def pseudonymised(found: DataFrame, key: str) -> DataFrame:
    """found with the surrogate that each piece gets; pieces that come out as they are would be no finding."""
    made = surrogates(found, key).select("pii_type", "piece", "surrogate")
    return found.join(made, ["pii_type", "piece"]).where(F.col("surrogate") != F.col("piece"))


def replaced(texts: DataFrame, found: DataFrame, replacements: DataFrame | None = None) -> DataFrame:
    """src_table, record_id, text with each piece replaced: by '[TYPE]', or by its surrogate where replacements are given. Null texts stay null."""
    pieces = found.withColumn("put", F.concat(F.lit("["), F.upper("pii_type"), F.lit("]")))
    if "surrogate" in found.columns:
        pieces = found.withColumn("put", F.col("surrogate"))
    elif replacements is not None:
        pieces = found.join(replacements.select("pii_type", "piece", F.col("surrogate").alias("put")), ["pii_type", "piece"])
    own = ["src_table", "record_id", *(["text_hash"] if "text_hash" in found.columns else [])]  # two texts may share a record
    spans = pieces.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "put"))).alias("spans"))  # pieces of one text
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    joined = texts.select("src_table", "record_id", "text", F.xxhash64("text").alias("text_hash")).join(spans, own, "left")
    built = F.aggregate("spans", start, lambda acc, s: F.struct(s["end_pos"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start_pos"] - acc["at"]), s["put"]).alias("out")))
    return joined.withColumn("b", built).select("src_table", "record_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.concat(F.col("b.out"), F.expr("substring(text, b.at + 1)"))).alias("text"))
