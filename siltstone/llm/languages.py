"""Missing or wrong language labels, and texts in several languages.

Text likelihoods come from hashed character n-grams counted over a bounded sample
of labelled documents (and once more over the sentences as first classified, which
washes wrong labels out). A document's language, and more loosely that of each of
its sentences, fuses them, in Bayes' manner, with the declared label, the language
its markup declares, the suffixes of addresses in the text, and a prior of its host
(space) that is smoothed towards its source and that towards the whole corpus;
all of these are grouped aggregations over all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import drawn, stored

#: What a text is in that no language makes likely.
OTHER = "other"
#: Different labelled rows that the model is fitted on, at most; everything else covers all rows.
SAMPLE = 20_000
#: Held-out texts of the sample that calibrate it, at most.
HELD = 2_000
LANGUAGES = ("en", "vi", "fr", "de", "es", "id")

#: Codes and names of these languages (ISO 639-1, 639-2, English, own name).
NOTATIONS = {
    "en": ("en", "eng", "english"),
    "vi": ("vi", "vie", "vietnamese", "tiếng việt", "tieng viet"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "id": ("id", "ind", "in", "indonesian", "bahasa indonesia"),
}
#: Labels that name no language.
NO_LANGUAGE = ("", "und", "unk", "unknown", "undefined", "undetermined", "n/a", "na", "none", "null", "nil", "nan", "xx", "xxx", "zxx", "mis", "mul", "other", "auto", "?", "-")

ORDERS = (2, 3, 4)
BUCKETS = 1 << 17
#: Weight of one n-gram's log-likelihood: overlapping n-grams tell less than independent ones.
TEMPER = 0.25


def label_code(label: Column) -> Column:
    """The language a label names in any notation ('en-US', 'vi_VN', 'English', ...), 'other' for another language's, null if it names none."""
    s = F.lower(F.regexp_replace(F.coalesce(label, F.lit("")), r"(?U)^[\s\x{FEFF}\x{200B}]+|[\s\x{FEFF}\x{200B}]+$", ""))
    main = F.regexp_extract(s, r"(?U)^([^\W\d_]{2,3})[-_].*$", 1)
    s = F.when(main != "", main).otherwise(s)
    out = F.when(s.isin(*NO_LANGUAGE) | ~s.rlike(r"(?U)[^\W\d_]"), F.lit(None).cast("string"))
    for code, names in NOTATIONS.items():
        out = out.when(s.isin(*names), code)
    return out.otherwise("other")


_NOISE = re.compile(
    r"```.*?(?:```|\Z)|`[^`\n]*`|<[^<>\n]{1,200}>|(?:https?://|www\.)\S+|\S+@\S+|^[ \t]*(?:[{\[].*[}\]]|\|.*|\d{1,2}:\d{2}(?::\d{2})?\b.*|\d{4}-\d{2}-\d{2}[T ].*)[ \t]*$|\S*[=_]\S*|&[a-z]{2,6};",
    re.S | re.M,
)
# the alternatives for whole lines must not run over line ends
_NOISE = re.compile(_NOISE.pattern.replace(".*?(?:```", "[\\s\\S]*?(?:```"), re.M)
_MAYBE = re.compile(r"[`<{\[|@=_&]|://|www\.|\d:\d|\d-\d")  # every kind of noise has one of these
_SPEAKER = re.compile(r"^[ \t]*[^\W\d_]{1,12}:(?=\s)", re.M)
_END = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s|$)|\n")
_WORDS = re.compile(r"[^\W\d_]{2,}")
_HEADING = re.compile(r"\s*(?:#+|\*\*|={2,})\s*\S")
_ADDRESS = re.compile(r"(?:https?://|@|\bwww\.)(?:[\w-]+\.)+([a-z]{2,10})\b", re.I)


def cleaned(text: str) -> str:
    """The text with code, log lines, tables, links, tags and speakers' names as blanks."""
    clean = _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text) if _MAYBE.search(text) else text
    return _SPEAKER.sub(lambda m: " " * len(m[0]), clean)


def sentences(clean: str) -> list[tuple[int, int, bool, str]]:
    """(start, end, counts, letters) of the sentences of a cleaned text; sentences end after a full stop or at a line's end.

    A heading or a piece of fewer than four words doesn't count as a sentence; pieces
    without words are left out.
    """
    out, start = [], 0
    for end in [*(m.end() for m in _END.finditer(clean)), len(clean)]:
        piece = clean[start:end]
        words = _WORDS.findall(piece.lower())
        if words:
            full = len(words) >= 4 and not (piece.lstrip()[:1] in "#*=" and _HEADING.match(piece))
            out.append((start, end - piece.endswith("\n"), full, " " + " ".join(words) + " "))
        start = end
    return out


def letters(piece: str) -> str:
    """A text as the n-grams see it: lower case, only letters, single blanks."""
    return " " + " ".join(_WORDS.findall(piece.lower())) + " "


def ngrams_by_order(pieces: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order: bucket of every n-gram of every piece, and the piece that each belongs to, in the order of the pieces."""
    lengths = np.fromiter((len(p) for p in pieces), dtype=np.int64, count=len(pieces))
    points = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(pieces)), lengths)
    h = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(points) - n + 1] * np.uint64(1000003) + points[n - 1 :]
        if n in ORDERS and len(h):
            same = owner[: len(h)] == owner[n - 1 :]
            mixed = (h ^ (h >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            yield (mixed >> np.uint64(47)).astype(np.int64)[same], owner[: len(h)][same]


def groups(pieces: list[str], limit: int = 300_000) -> Iterator[slice]:
    """Runs of pieces of together about limit characters, so that the n-grams of a batch never stand in memory at once."""
    start = size = 0
    for i, p in enumerate(pieces):
        if size and size + len(p) > limit:
            yield slice(start, i)
            start, size = i, 0
        size += len(p)
    if start < len(pieces):
        yield slice(start, len(pieces))


@dataclass(frozen=True)
class LanguageModel:
    """Log-likelihood of each bucket under each language, and what a held-out part of the sample says of it.

    floor: the lowest mean log-likelihood of an n-gram of a text under its language, below which a text is in none of
    the languages. sharpness: factor of fused scores that makes a posterior a frequency.
    """

    log_p: np.ndarray  # BUCKETS x languages
    floor: float = -np.inf
    sharpness: float = 1.0

    @classmethod
    def of(cls, counts: np.ndarray) -> LanguageModel:
        smooth = counts.astype(np.float64) + 0.5
        return cls(np.log(smooth / smooth.sum(0, keepdims=True)).astype(np.float32))

    def scores(self, pieces: list[str]) -> np.ndarray:
        """Tempered log-likelihoods, pieces x languages."""
        out = np.zeros((len(pieces), len(LANGUAGES)))
        for part in groups(pieces):
            n = part.stop - part.start
            for ids, owner in ngrams_by_order(pieces[part]):
                starts = np.searchsorted(owner, np.arange(n))
                some = np.append(starts[1:], len(owner)) > starts
                if some.any():
                    out[part][some] += np.add.reduceat(self.log_p[ids], starts[some], axis=0, dtype=np.float64)
        return out * TEMPER


def _pieces(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Cleaned sentences of all texts, their text's number, whether each counts, and their places."""
    pieces, owner, counts, spans = [], [], [], []
    for i, text in enumerate(texts):
        for a, b, full, piece in sentences(cleaned(text)) if text else ():
            pieces.append(piece)
            owner.append(i)
            counts.append(full)
            spans.append((a, b))
    return pieces, np.array(owner, dtype=np.int64), np.array(counts, dtype=bool), spans


def _sums_by_text(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of sentence rows per text; owner is in order."""
    out = np.zeros((n, values.shape[1]))
    starts = np.searchsorted(owner, np.arange(n))
    some = np.append(starts[1:], len(owner)) > starts
    if some.any():
        out[some] = np.add.reduceat(values, starts[some], axis=0)
    return out


def fit(docs: DataFrame, text: str = "text", label: str = "lang", rounds: int = 1, sample: int | None = None, seed: int = 3) -> LanguageModel:
    """Counts n-grams of labelled texts by label; each further round counts the sentences by the language the model so far gives them, which washes wrong labels out.

    sample: fit on at most so many different rows, drawn by hash from the whole table
    (a documented bound); None counts over all rows. The driver gets at most 2 x BUCKETS x
    languages numbers a round, and at most HELD texts of a held-out tenth. Languages without a labelled row stay at the smoothing value.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"), label_code(F.col(label)).alias("code")).where(F.length("text") > 0)
    if sample is not None:
        rows = stored(drawn(rows, sample, rows.count(), seed).repartition(max(2, min(64, spark.sparkContext.defaultParallelism))), "sample")  # read once a round
    held = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(10)) == 0
    model = None
    for _ in range(rounds + 1):
        shared = None if model is None else spark.sparkContext.broadcast(model)

        def count(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            total = np.zeros(2 * len(LANGUAGES) * BUCKETS, dtype=np.int64)  # those of the held-out texts apart
            for pdf in batches:
                pieces, owner, _, _ = _pieces(pdf["text"].tolist())
                if not pieces:
                    continue
                label = pdf["code"].map({c: k for k, c in enumerate(LANGUAGES)}).fillna(-1).to_numpy(dtype=np.int64)[owner]
                if shared is not None:
                    scores = shared.value.scores(pieces)
                    top = np.partition(scores, -2, axis=1)
                    label = np.where(top[:, -1] - top[:, -2] > 3, scores.argmax(1), -1)
                label = np.where((label >= 0) & pdf["held"].to_numpy(dtype=bool)[owner], label + len(LANGUAGES), label)
                for part in groups(pieces):
                    for ids, of in ngrams_by_order(pieces[part]):
                        at = label[part][of]
                        total += np.bincount((at * BUCKETS + ids)[at >= 0], minlength=len(total))
            at = np.flatnonzero(total)
            yield pd.DataFrame({"cell": at, "n": total[at]})

        source = rows if model is not None else rows.where(F.col("code").isNotNull() & (F.col("code") != "other"))
        cells = source.withColumn("held", held).mapInPandas(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most 2 x languages x BUCKETS rows
        counts = np.zeros(2 * len(LANGUAGES) * BUCKETS, dtype=np.int64)
        counts[cells["cell"].to_numpy(dtype=np.int64)] = cells["n"].to_numpy(dtype=np.int64)
        counts = counts.reshape(2, len(LANGUAGES), BUCKETS)
        model = LanguageModel.of(counts.sum(0).T)
    aside = rows.where(held & F.col("code").isin(*LANGUAGES)).withColumn("_o", F.xxhash64("text")).orderBy("_o").limit(HELD).select("text", "code").toPandas()  # at most HELD texts
    return calibrated(model, LanguageModel.of(counts[0].T), aside["text"].tolist(), [LANGUAGES.index(c) for c in aside["code"]])


def calibrated(model: LanguageModel, other: LanguageModel, texts: list[str], labels: list[int]) -> LanguageModel:
    """The model with floor and sharpness from texts that the other model, counted over the rest, hasn't seen; without any it stays as it is.

    Labels may be wrong: their rate of disagreement is taken as noise, and the
    sharpness is the one under which the noisy labels are likeliest.
    """
    pieces, owner, _, _ = _pieces(texts)
    if not pieces:
        return model
    total = _sums_by_text(other.scores(pieces), owner, len(texts))
    size = np.bincount(owner, weights=[_n_grams(p) for p in pieces], minlength=len(texts))
    use = size > 0
    total, size, labels = total[use], size[use], np.array(labels)[use]
    best = total.argmax(1)
    noise = min(0.5, max(1e-3, float((best != labels).mean())))
    mean = total.max(1) / TEMPER / size
    losses = {}
    for t in (0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0):
        z = t * (total - total.max(1, keepdims=True))
        post = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        losses[t] = -np.log((1 - noise) * post[np.arange(len(post)), labels] + noise / len(LANGUAGES)).mean()
    least = min(losses.values())
    agree = mean[(best == labels) & (size >= 60)]
    floor = float(agree.min() - 0.5) if len(agree) >= 50 else -np.inf
    return LanguageModel(model.log_p, floor, max(t for t, x in losses.items() if x <= least + 1e-4))


def _n_grams(piece: str) -> int:
    return sum(max(0, len(piece) - n + 1) for n in ORDERS)


#: Weight of the document's evidence (host, label, markup, addresses) for a single sentence: in a mixed text a sentence follows it but loosely.
LOOSE = 0.25


def text_evidence(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: scores (log-likelihood per language of the whole text), of_sentences (the same of each sentence, one after the other), starts, ends and counts of the sentences, n_grams, suffixes (of addresses in the text), has_words; plus the columns keep."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f"_keep{i}" for i in range(len(keep))]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].fillna("").tolist()
            n = len(texts)
            pieces, owner, counts, spans = _pieces(texts)
            scores = shared.value.scores(pieces)
            cuts = np.searchsorted(owner, np.arange(1, n))
            out = pdf[["id", *kept]].copy()
            places = np.array(spans, dtype=np.int32).reshape(-1, 2)
            out["scores"] = list(_sums_by_text(scores, owner, n))
            out["of_sentences"] = [x.ravel() for x in np.split(scores.astype(np.float32), cuts)]
            out["starts"], out["ends"], out["counts"] = np.split(places[:, 0], cuts), np.split(places[:, 1], cuts), np.split(counts, cuts)
            out["n_grams"] = np.bincount(owner, weights=[_n_grams(p) for p in pieces], minlength=n).astype(np.int64)
            out["has_words"] = np.bincount(owner, minlength=n) > 0
            out["suffixes"] = [sorted({x.lower() for x in _ADDRESS.findall(t)}) if "@" in t or "://" in t or "www." in t.lower() else [] for t in texts]
            yield out

    types = dict(rows.dtypes)
    schema = f"id {types['id']}, {''.join(f'{k} {types[k]}, ' for k in kept)}scores array<double>, of_sentences array<float>, starts array<int>, ends array<int>, counts array<boolean>, n_grams bigint, has_words boolean, suffixes array<string>"
    found = rows.mapInPandas(score, schema)
    return found.select(F.col("id").alias(id_col), *[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], "scores", "of_sentences", "starts", "ends", "counts", "n_grams", "has_words", "suffixes")


def markup_language(text: Column) -> Column:
    """The language that the text's own markup declares first (lang or xml:lang of a tag), null without one."""
    declared = F.when(F.contains(F.lower(text), F.lit("lang")), F.regexp_extract(text, r"(?i)<[a-z][^<>]*?\s(?:xml:)?lang\s*=\s*[\"']?([a-z]{2,8}(?:[-_][a-z0-9]+)*)", 1))
    return F.when(F.coalesce(declared, F.lit("")) != "", label_code(declared))


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    weights = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b))


def _sums(df: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """Soft counts of languages per group."""
    return df.groupBy(*by).agg(*[F.sum(F.col("post")[k]).alias(f"{prefix}{k}") for k in range(len(LANGUAGES))])


def fused(docs: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang", host: str = "space_key", source: str = "source", weight: float = 50.0, model: LanguageModel | None = None, sample: int | None = SAMPLE) -> DataFrame:
    """The text evidence of every row with the log of what everything else says of its language: id, label, told (log prior per language) and text_evidence's columns.

    told adds the prior of the host, smoothed towards its source and that towards the
    whole corpus; the likelihood of the declared label; that of the language its
    markup declares; and that of the suffixes of its addresses. All are soft counts
    over all rows.
    """
    n = len(LANGUAGES)
    model = model or fit(docs.select(F.col(text).alias("text"), F.col(label).alias("lang")), sample=sample)
    base = docs.withColumns({"_label": label_code(F.col(label)), "_markup": markup_language(F.col(text)), "_host": F.col(host), "_source": F.col(source)})
    evidence = stored(text_evidence(base, model, id_col, text, ("_label", "_markup", "_host", "_source")), "languages")
    told = evidence.where("has_words").withColumn("post", _softmax(F.col("scores"))).select("_label", "_markup", "_host", "_source", "suffixes", "post")

    whole = _sums(told, [], "w")
    by_source, by_host, by_label = _sums(told, ["_source"], "s").withColumnRenamed("_source", "_s"), _sums(told, ["_host", "_source"], "h"), _sums(told, ["_label"], "l")
    by_markup = _sums(told.where(F.col("_markup").isNotNull()), ["_markup"], "m")
    by_suffix = _sums(told.select("post", F.explode("suffixes").alias("suffix")), ["suffix"], "x")

    def smoothed(counts: str, prior: Column, strength: float) -> Column:
        values = [F.coalesce(F.col(f"{counts}{k}"), F.lit(0.0)) for k in range(n)]
        total = sum(values[1:], values[0])
        return F.array(*[(values[k] + strength * prior[k]) / (total + strength) for k in range(n)])

    even = F.array(*[F.lit(1.0 / n)] * n)
    priors = (
        by_host.join(by_source, F.col("_source").eqNullSafe(F.col("_s")), "left")
        .crossJoin(whole)  # one row
        .withColumn("_whole", smoothed("w", even, 1.0))
        .withColumn("_of_source", smoothed("s", F.col("_whole"), weight))
        .select(F.col("_host").alias("_h"), F.col("_source").alias("_hs"), smoothed("h", F.col("_of_source"), weight).alias("prior"))
    )
    # P(label | language) up to a factor: soft counts of the label over those of the language
    likely = lambda c: F.array(*[F.log((F.col(f"{c}{k}") + 0.5) / (F.col(f"w{k}") + 5.0)) for k in range(n)])
    labels = by_label.crossJoin(whole).select(F.col("_label").alias("_l"), likely("l").alias("of_label"))
    markups = by_markup.crossJoin(whole).select(F.col("_markup").alias("_m"), likely("m").alias("of_markup"))
    suffix = by_suffix.crossJoin(whole).select("suffix", F.array(*[F.log((F.col(f"x{k}") + 1.0) / (F.col(f"w{k}") + n)) for k in range(n)]).alias("of_suffix"))
    suffixes = (
        evidence.where(F.size("suffixes") > 0).select(id_col, F.explode("suffixes").alias("suffix")).distinct().join(suffix, "suffix").groupBy(F.col(id_col).alias("_id")).agg(*[F.sum(F.col("of_suffix")[k]).alias(f"_x{k}") for k in range(n)])
    )
    # only texts with addresses move for them
    bare = evidence.where(F.size("suffixes") == 0).select("*", *[F.lit(0.0).alias(f"_x{k}") for k in range(n)])
    with_suffixes = evidence.where(F.size("suffixes") > 0).join(suffixes, F.col(id_col) == F.col("_id"), "left").drop("_id").unionByName(bare)
    joined = (
        with_suffixes.join(priors, F.col("_host").eqNullSafe(F.col("_h")) & F.col("_source").eqNullSafe(F.col("_hs")), "left")
        .join(labels, F.col("_label").eqNullSafe(F.col("_l")), "left")
        .join(markups, F.col("_markup") == F.col("_m"), "left")
    )
    zero = F.lit(0.0)
    log_prior = F.array(*[F.coalesce(F.log(F.col("prior")[k]), zero) + F.coalesce(F.col("of_label")[k], zero) + F.coalesce(F.col("of_markup")[k], zero) + F.coalesce(F.col(f"_x{k}"), zero) for k in range(n)])
    # what the model knows of itself goes with the rows, as they are read by another step
    about = [F.lit(float(model.floor)).alias("floor"), F.lit(float(model.sharpness)).alias("sharpness")]
    return joined.select(F.col(id_col).alias("id"), F.col("_label").alias("label"), log_prior.alias("told"), "scores", "of_sentences", "starts", "ends", "counts", "n_grams", "has_words", *about)


def _decided(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fused decisions of a batch of fused(): posterior per text, and per sentence its text's number, posterior, margin and whether it counts."""
    n = len(pdf)
    told = np.stack(pdf["told"].to_list()).astype(np.float64) if n else np.zeros((0, len(LANGUAGES)))
    sharp = pdf["sharpness"].to_numpy()[:, None]
    sizes = pdf["starts"].map(len).to_numpy(dtype=np.int64)
    owner = np.repeat(np.arange(n), sizes)
    z = (np.stack(pdf["scores"].to_list()) if n else told) + told
    post = np.exp(sharp * (z - z.max(1, keepdims=True))) if n else z
    post /= post.sum(1, keepdims=True)
    flat = np.concatenate([np.empty(0, np.float32), *pdf["of_sentences"]]).reshape(-1, len(LANGUAGES)).astype(np.float64)
    y = flat + LOOSE * (told - told.mean(1, keepdims=True))[owner]
    top = np.partition(y, -2, axis=1) if len(y) else y
    by = np.exp(y - y.max(1, keepdims=True)) if len(y) else y
    by = by / by.sum(1, keepdims=True)
    counts = np.concatenate([np.empty(0, bool), *pdf["counts"]]).astype(bool)
    return post, owner, by, (top[:, -1] - top[:, -2]) if len(y) else np.empty(0), counts


def languages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang", host: str = "space_key", source: str = "source", weight: float = 50.0, model: LanguageModel | None = None, sample: int | None = SAMPLE) -> DataFrame:
    """Per row: language ('other' for a text that is unlikely in all of them), confidence (calibrated posterior of the fused evidence), label (the language the label names, 'other' or null), and present (languages of two sentences or more, each decided by the fused evidence).

    Rows without words (null, blank, only code or links) have a null language and
    confidence 0. weight: how many rows of a source count as much as the host's own.
    """
    rows = fused(docs, id_col, text, label, host, source, weight, model, sample)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = np.array(LANGUAGES, dtype=object)
        for pdf in batches:
            post, owner, by, margin, counts = _decided(pdf)
            use = counts & (margin > 2)
            n = np.bincount(owner[use] * len(LANGUAGES) + by[use].argmax(1), minlength=len(pdf) * len(LANGUAGES)).reshape(-1, len(LANGUAGES))
            words = pdf["has_words"].to_numpy(dtype=bool)
            mean = np.stack(pdf["scores"].to_list()).max(1) / TEMPER / np.maximum(1, pdf["n_grams"].to_numpy()) if len(pdf) else np.empty(0)
            best = codes[post.argmax(1)]
            best[mean < pdf["floor"].to_numpy()] = OTHER
            best[~words] = None
            yield pd.DataFrame({"id": pdf["id"], "language": best, "confidence": np.where(words, post.max(1), 0.0), "label": pdf["label"], "present": [[LANGUAGES[k] for k in np.flatnonzero(x >= 2)] for x in n]})

    schema = f"id {dict(rows.dtypes)['id']}, language string, confidence double, label string, present array<string>"
    return rows.mapInPandas(decide, schema).withColumnRenamed("id", id_col)


def label_issues(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """'mixed' (one row per language), else 'missing', else 'wrong': id, issue, lang_code. Rows without words, and texts in none of the languages, are no cases."""
    mixed = F.size("present") >= 2
    issue = F.when(mixed, "mixed").when(F.col("label").isNull(), "missing").when(F.col("label") != F.col("language"), "wrong")
    return (
        found.where(F.col("language").isNotNull() & (mixed | (F.col("language") != OTHER)))
        .select(id_col, issue.alias("issue"), F.explode(F.when(mixed, F.col("present")).otherwise(F.array("language"))).alias("lang_code"))
        .where(F.col("issue").isNotNull())
        .distinct()
    )


def segments(docs: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "lang", host: str = "space_key", source: str = "source", weight: float = 50.0, model: LanguageModel | None = None, sample: int | None = SAMPLE) -> DataFrame:
    """Runs of sentences in one language by the fused evidence: id, segment, start_pos, end_pos, language, confidence (mean posterior of its sentences)."""
    rows = fused(docs, id_col, text, label, host, source, weight, model, sample).where("has_words")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            _, owner, by, _, _ = _decided(pdf)
            if not len(owner):
                continue
            f = pd.DataFrame({"owner": owner, "k": by.argmax(1), "p": by.max(1), "a": np.concatenate(pdf["starts"].to_list()), "b": np.concatenate(pdf["ends"].to_list())})
            f["run"] = ((f["owner"] != f["owner"].shift()) | (f["k"] != f["k"].shift())).cumsum()
            g = f.groupby("run").agg(owner=("owner", "first"), k=("k", "first"), p=("p", "mean"), a=("a", "min"), b=("b", "max"))
            g["segment"] = g.groupby("owner").cumcount()
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[g["owner"]], "segment": g["segment"].astype("int32"), "start_pos": g["a"].astype("int32"), "end_pos": g["b"].astype("int32"), "language": np.array(LANGUAGES)[g["k"]], "confidence": g["p"]})

    return rows.mapInPandas(cut, f"id {dict(rows.dtypes)['id']}, segment int, start_pos int, end_pos int, language string, confidence double").withColumnRenamed("id", id_col)
