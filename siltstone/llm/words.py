"""Words of a text in a form that survives copying: case, accents, punctuation, hyphenation, markup and invisible characters don't matter."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Characters that don't show: soft hyphen, zero-width marks, direction marks, joiners, byte-order mark.
INVISIBLE = "­͏؜᠎​-‏‪-‮⁠-⁤﻿"
_INLINE = r"</?(?:a|abbr|b|big|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strike|strong|sub|sup|u|var|wbr)\b[^<>]*>"
_GLUE = rf"(?:[{INVISIBLE}]|&(?:shy|zwj|zwnj|#8203);|{_INLINE}|[*_`~]{{1,3}}(?=\w)|['’ʼ](?=\w)|[-‐‑]\s*(?:\n[>\s]*)?(?=\w))"
_LETTER = r"[^\W_]"
_SKIP = re.compile(r"<[^<>]{0,200}>|&(?:[a-zA-Z]{2,8}|#\d{2,6});")
_WORD = re.compile(rf"{_LETTER}(?:[̀-ͯ]|{_LETTER}|{_GLUE}(?={_LETTER}|[̀-ͯ]|[{INVISIBLE}]|[<&*_`~'’ʼ-]))*")
_INLINE_ALONE = re.compile(rf"{_INLINE}|&(?:shy|zwj|zwnj|#8203);")
_INNER = re.compile(rf"{_INLINE}|&(?:shy|zwj|zwnj|#8203);|[\W_]+")


@lru_cache(maxsize=1 << 16)
def folded(word: str) -> str:
    """Lower case, without accents, compatibility forms and anything that is no letter or digit."""
    word = _INNER.sub("", unicodedata.normalize("NFKC", word))
    plain = unicodedata.normalize("NFKD", word.casefold())
    return "".join(c for c in plain if not unicodedata.combining(c)).replace("đ", "d").replace("ı", "i")


def _blank(m: re.Match) -> str:
    """Tags and entities become blanks of the same length, so that places stay; those inside a word, which don't part it, stay as they are."""
    text, inner = m.string, _INLINE_ALONE.fullmatch(m[0])
    inside = m.start() > 0 and m.end() < len(text) and text[m.start() - 1].isalnum() and text[m.end()].isalnum()
    return m[0] if inner and inside else " " * len(m[0])


def _plain(text: str) -> str:
    return _SKIP.sub(_blank, text) if "<" in text or "&" in text else text


def raw_words(text: str) -> list[str]:
    """The words of a text as they stand there; those that fold to nothing are among them."""
    return _WORD.findall(_plain(text))


def words_with_spans(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Folded words and their places (code points, end exclusive) in the whole text."""
    out, spans = [], []
    for m in _WORD.finditer(_plain(text)):
        w = folded(m[0])
        if w:
            out.append(w)
            spans.append(m.span())
    return out, spans
