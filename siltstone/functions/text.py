"""Text expressions: tokens, normal forms, scrubbing, hashing. All stay inside the JVM unless they say otherwise.

Every function returns null for a null input unless it says otherwise. Regular
expressions carry (?U), so that words and blanks are those of Unicode.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that the evaluation tokens leave out.
STOPWORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "of", "in", "on", "at", "to", "for", "with", "as", "by", "and", "or",
    "it", "its", "this", "that", "these", "those", "from", "into", "than", "but", "not", "have", "had", "has", "do", "does", "did", "can", "will",
]

#: Named patterns, applied in this order.
SCRUB_PATTERNS = {
    "EMAIL": r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b",
    "PHONE_VN": r"(?<!\d)(?:\+84|0)(?:[ .-]?\d){9}(?!\d)",
    "PHONE_INTL": r"(?<!\d)\+(?:[0-9] ?){6,14}[0-9](?!\d)",
    "NATIONAL_ID_VN": r"\b\d{12}\b",
    "CREDIT_CARD": r"\b(?:\d{4}[ -]?){3}\d{4}\b|\b\d{15,16}\b",
    "JWT_TOKEN": r"\beyJ[A-Za-z0-9-_=]+\.[A-Za-z0-9-_=]+\.?[A-Za-z0-9-_.+/=]*\b",
    "API_KEY": r"(?i)\b(?:sk-[a-zA-Z0-9]{20,}|ghp_[a-zA-Z0-9]{20,}|api_key[ =:][a-zA-Z0-9_-]{16,})\b",
    "IPV4_ADDRESS": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}

#: Signs of injected instructions in untrusted text.
INJECTION_PATTERNS = (
    r"ignore\s+(all\s+)?previous\s+instructions",
    r"system\s*:\s*you\s+are",
    r"developer\s*:\s*override",
    r"\[SYSTEM_PROMPT\]",
    r"<\s*script\s*>",
    r"TOOL_RESULTS_JSON\s*:",
)
SANITIZED = "[SANITIZED_INSTRUCTION_REMOVED]"

#: Zero-width characters and the soft hyphen.
ZERO_WIDTH = "​‌‍﻿⁠­"


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """True for null, empty and blank texts; never null."""
    return c.isNull() | (strip(c) == "")


def words(c: Column) -> Column:
    """All lower-case words, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w+\b"), 0)


def token_set(c: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Distinct lower-case words without stopwords; an empty array for null."""
    kept = F.filter(words(c), lambda w: ~w.isin(*stopwords)) if stopwords else words(c)
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def split_tokens(c: Column) -> Column:
    """Lower-case pieces between blanks (line ends count as blanks); an empty array for null."""
    return F.coalesce(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != ""), F.array().cast("array<string>"))


def plain_tokens(c: Column) -> Column:
    """Lower-case pieces after punctuation became blanks; an empty array for null."""
    return split_tokens(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "))


def clean_markdown(c: Column) -> Column:
    """Line ends without blanks before them, at most one empty line in a row, no blanks around the text."""
    lines = F.regexp_replace(c, r"\r\n|[\r\x{0B}\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]", "\n")
    return strip(F.regexp_replace(F.regexp_replace(lines, r"(?U)[\s&&[^\n]]+(?=\n|$)", ""), r"\n{3,}", "\n\n"))


def strip_html(c: Column) -> Column:
    """Text without scripts, styles, comments and tags; the common entities resolved; blanks collapsed."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(bare, r"(?U)\s+", " "))


def casefold(c: Column) -> Column:
    """Full case folding inside the JVM: upper and then lower case, in which the dotless i stays and a final sigma becomes a plain one."""
    kept = F.translate(c, "ı", "\ue0ff")  # a private character that has no case
    return F.translate(F.lower(F.upper(kept)), "\ue0ffς", "ıσ")


def question_key(c: Column) -> Column:
    """Key that finds the same question again: blanks collapsed, case folded."""
    return casefold(strip(F.regexp_replace(c, r"(?U)\s+", " ")))


def scrub(c: Column, patterns: dict[str, str] | None = None, form: str = "[REDACTED_{name}]") -> Column:
    """Replaces each pattern in turn by its name; patterns override or extend the fixed ones by name."""
    merged = SCRUB_PATTERNS | (patterns or {})
    return reduce(lambda x, kv: F.regexp_replace(x, "(?U)" + kv[1], re.sub(r"([\\$])", r"\\\1", form.format(name=kv[0].upper()))), merged.items(), c)


def summarize(c: Column, most: int = 160) -> Column:
    """Scrubbed, stripped, on one line, cut to ``most`` characters with '...' where it was longer."""
    line = F.replace(F.replace(strip(scrub(c)), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("..."))).otherwise(line)


def hash_identifier(c: Column, salt: str, length: int = 12) -> Column:
    """First hex digits of sha256('salt:id'); '' for null and empty ids."""
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.substring(F.sha2(F.concat(F.lit(salt + ":"), c), 256), 1, length))


def content_hash(c: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)


def render(template: Column, variables: dict[str, Column]) -> Column:
    """Puts each variable in turn for {{name}} and {name}; null variables count as ''. A value may itself be filled by a later variable."""
    for name, value in variables.items():
        filled = F.coalesce(value.cast("string"), F.lit(""))
        template = F.replace(F.replace(template, F.lit("{{" + name + "}}"), filled), F.lit("{" + name + "}"), filled)
    return template


def is_suspicious(c: Column) -> Column:
    """Any sign of an injected instruction; false for null."""
    return F.coalesce(reduce(lambda a, b: a | b, [c.rlike("(?iU)" + p) for p in INJECTION_PATTERNS]), F.lit(False))


def sanitize(c: Column) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, "(?iU)" + p, SANITIZED), INJECTION_PATTERNS, c)


def entropy(c: Column) -> Column:
    """Shannon entropy in bits per character; 0 for ''."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    share = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / F.length(c))
    return F.when(c == "", F.lit(0.0)).otherwise(-F.aggregate(share, F.lit(0.0), lambda a, p: a + p * F.log2(p)))


def first_json(c: Column) -> Column:
    """The text from the first '{' to the last '}', null if there is none."""
    found = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def labelled(parts: dict[str, Column], sep: str = "\n") -> Column:
    """'Label: value' lines of the parts that aren't blank, as text for embedding."""
    return F.concat_ws(sep, *[F.when(~is_blank(v.cast("string")), F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in parts.items()])


@F.pandas_udf(StringType())
def canonical(texts: pd.Series) -> pd.Series:
    """NFKC without zero-width characters; '' for null. Arrow batches, as Spark has no Unicode normal forms."""
    gone = str.maketrans("", "", ZERO_WIDTH)
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).translate(gone) if t else "")


def scrub_json(c: Column, keep: tuple[str, ...] = ()) -> Column:
    """JSON with every string value scrubbed at any depth; values under the keys keep stay as they are; text that isn't JSON is scrubbed as text."""
    compiled = [(n, re.compile(p)) for n, p in SCRUB_PATTERNS.items()]

    def clean(v):
        if isinstance(v, str):
            for name, p in compiled:
                v = p.sub(f"[REDACTED_{name}]", v)
            return v
        if isinstance(v, dict):
            return {k: x if k in keep else clean(x) for k, x in v.items()}
        return [clean(x) for x in v] if isinstance(v, list) else v

    @F.pandas_udf("string")
    def apply(rows: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            try:
                return json.dumps(clean(json.loads(t)), ensure_ascii=False)
            except ValueError:
                return clean(t)

        return rows.map(one)

    return apply(c)


@F.pandas_udf(StringType())
def title_case(texts: pd.Series) -> pd.Series:
    """Python's title case, which starts a new word after any non-letter."""
    return texts.map(lambda t: None if t is None else t.title())
