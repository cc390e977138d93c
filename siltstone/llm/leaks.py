"""Evaluation texts leaking into training text.

Each shard of the training text becomes an FM-index: the Burrows-Wheeler
transform of its word sequence in a wavelet matrix, with sampled suffix
positions. All phrases of the test items are searched backwards at once;
occurrences are located by walking to sampled positions, extended along their
diagonals to whole passages, and their spans merged per document.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.words import folded, raw_words, words_with_spans

#: Words of one index: a shard of a task's rows. A longer text gets a shard of its own.
SHARD_WORDS = 400_000
#: Every so many text positions the suffix position is kept.
SAMPLE_RATE = 8
#: Test items are searched in blocks of at most so many characters, so what goes to every task is bounded.
ITEM_CHARS = 8_000_000


@dataclass(frozen=True)
class Passage:
    """words: successive item words of the shortest passage; one in ten of any passage may be altered. phrase: length of the exact phrases searched; every passage holds one, as 16 words with one altered have a run of 8, 20 with two a run of 6. seed: shortest run of words that counts once a phrase has been found, so near its diagonal (shift: words dropped or added)."""

    words: int = 16
    phrase: int = 5
    seed: int = 3
    shift: int = 2


class FMIndex:
    """Backward search over a sequence of non-negative integers below 2 ** bits."""

    def __init__(self, sequence: np.ndarray, bits: int) -> None:
        text = np.append(sequence.astype(np.int64) + 1, 0)  # 0 ends the text
        self.bits, n = bits + 1, len(text)
        suffixes = self._suffixes(text)
        bwt = text[suffixes - 1]
        counts = np.bincount(bwt, minlength=1 << self.bits)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.sampled = np.where(suffixes % SAMPLE_RATE == 0, suffixes, -1).astype(np.int32)
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(n - self.ones[-1][-1]))
            level = np.concatenate((level[bit == 0], level[bit == 1]))
        self.n = n

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling."""
        n, step = len(text), 1
        _, rank = np.unique(text, return_inverse=True)
        while True:
            following = np.zeros(n, dtype=np.int64)
            following[: n - step] = rank[step:] + 1 if step < n else 0
            key = rank * np.int64(n + 1) + following
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            fresh = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
            rank = np.empty(n, dtype=np.int64)
            rank[order] = fresh
            if fresh[-1] == n - 1:
                return order
            step *= 2

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol comes before position at in the transform."""
        start, end = np.zeros_like(at), at.copy()
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            bit = ((symbols >> b) & 1).astype(bool)
            ones = self.ones[level]
            s1, e1 = ones[start], ones[end]
            start = np.where(bit, self.zeros[level] + s1, start - s1)
            end = np.where(bit, self.zeros[level] + e1, end - e1)
        return end - start

    def back(self, rows: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one position earlier."""
        at, symbol, start = rows.copy(), np.zeros_like(rows), np.zeros_like(rows)
        for level in range(self.bits):
            ones = self.ones[level]
            bit = ones[at + 1] - ones[at]
            a1, s1 = ones[at], ones[start]
            at = np.where(bit == 1, self.zeros[level] + a1, at - a1)
            start = np.where(bit == 1, self.zeros[level] + s1, start - s1)
            symbol = symbol * 2 + bit
        return self.first[symbol] + at - start

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase number, position) of every occurrence of the phrases, one per row of the array."""
        lo, hi, alive = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64), np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, k] + 1
            lo, hi = self.first[c] + self.rank(c, lo), self.first[c] + self.rank(c, hi)
            some = hi > lo
            lo, hi, alive = lo[some], hi[some], alive[some]
        number = np.repeat(alive, hi - lo)
        rows = np.repeat(lo - np.concatenate(([0], np.cumsum(hi - lo)[:-1])), hi - lo) + np.arange(len(number)) if len(number) else np.empty(0, np.int64)
        position, walked, open_ = np.full(len(rows), -1, dtype=np.int64), 0, np.arange(len(rows))
        while len(open_):
            known = self.sampled[rows] >= 0
            position[open_[known]] = self.sampled[rows[known]] + walked
            rows, open_, walked = self.back(rows[~known]), open_[~known], walked + 1
        return number, position


@dataclass
class Items:
    """Test items as word numbers, and their phrases."""

    number: dict[str, int]
    texts: list[np.ndarray]
    ids: list
    phrases: np.ndarray
    first: np.ndarray  # where each phrase's places begin in the next two, and where the last ones end
    place_item: np.ndarray
    place_at: np.ndarray

    @classmethod
    def of(cls, rows: list, p: Passage) -> Items:
        number: dict[str, int] = {}
        texts, ids, places = [], [], defaultdict(list)
        for item_id, text in rows:
            words, _ = words_with_spans(text or "")
            if len(words) < p.words:
                continue
            texts.append(np.array([number.setdefault(w, len(number) + 1) for w in words], dtype=np.int64))
            ids.append(item_id)
            for i in range(len(words) - p.phrase + 1):
                places[tuple(texts[-1][i : i + p.phrase].tolist())].append((len(ids) - 1, i))
        keys = list(places)
        flat = np.array([x for k in keys for x in places[k]], dtype=np.int64).reshape(-1, 2)
        first = np.cumsum([0, *(len(places[k]) for k in keys)])
        return cls(number, texts, ids, np.array(keys, dtype=np.int64).reshape(-1, p.phrase), first, flat[:, 0], flat[:, 1])

    @property
    def bits(self) -> int:
        return max(1, len(self.number).bit_length())


class _Numbers(dict):
    """Numbers of words as they stand in a text, each folded once: 0 for words of no item, -1 for what folds to nothing."""

    def __init__(self, number: dict[str, int]) -> None:
        self.number = number

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        w = folded(word)
        self[word] = n = self.number.get(w, 0) if w else -1
        return n


def _clean_windows(hit: np.ndarray, p: Passage) -> np.ndarray:
    """Marks the positions of windows of at least p.words of which at most one in ten is no hit."""
    inside = np.zeros(len(hit), dtype=bool)
    total = np.concatenate(([0], np.cumsum(hit)))
    for size in (p.words, *range(20, len(hit) + 1, 10)):
        if p.words <= size <= len(hit):
            for start in np.flatnonzero(total[size:] - total[:-size] >= size - size // 10):
                inside[start : start + size] = True
    return inside


def passages(doc: np.ndarray, item: np.ndarray, diagonals: set[int], p: Passage) -> list[tuple[int, int]]:
    """Spans (word positions of doc) of passages. Sentences may have changed places, so stretches of several diagonals add up."""
    found = np.full(len(item), -1, dtype=np.int64)
    at = np.add.outer(np.array(sorted({d + k for d in diagonals for k in range(-p.shift, p.shift + 1)})), np.arange(len(item)))
    held = ((at >= 0) & (at < len(doc)) & (doc[np.clip(at, 0, len(doc) - 1)] == item)).any(0)
    if held.sum() < p.words - p.words // 10:  # too few words in common for any passage
        return []
    near = sorted({d + k for d in diagonals for k in range(-p.shift, p.shift + 1)} - diagonals)
    for least, some in ((p.phrase, sorted(diagonals)), (p.seed, sorted(diagonals)), (p.seed, near)):  # whole phrases first, then shorter runs beside them
        for d in some:
            i = np.arange(max(0, -d), min(len(item), len(doc) - d))
            same = i[doc[i + d] == item[i]]
            # a stretch has no two altered words in a row; lone matches between other words don't count
            for stretch in np.split(same, np.flatnonzero(np.diff(same) > 2) + 1):
                if len(stretch) >= least:
                    found[stretch] = np.where(found[stretch] < 0, stretch + d, found[stretch])
    hit = found >= 0
    at = np.sort(found[_clean_windows(hit, p) & hit])
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > 2) + 1
    return [(int(x[0]), int(x[-1]) + 1) for x in np.split(at, cuts)]


def search_shard(ids: list, docs: list[tuple[np.ndarray, str]], items: Items, p: Passage) -> Iterator[tuple]:
    """(doc id, item id, start, end) in code points for the documents of one shard, each given by its words' numbers and its text. Places are worked out for documents with a passage only."""
    starts, pieces, at = [], [], 0
    for numbers, _ in docs:
        starts.append(at)
        pieces += [numbers, np.zeros(1, dtype=np.int64)]
        at += len(numbers) + 1
    if not at or not len(items.phrases):
        return
    number, position = FMIndex(np.concatenate(pieces), items.bits).find(items.phrases)
    doc_of = np.searchsorted(np.array(starts), position, side="right") - 1
    diagonals: dict[tuple[int, int], set[int]] = defaultdict(set)
    many = items.first[number + 1] - items.first[number]  # items that hold the phrase found
    cuts = np.searchsorted(np.cumsum(many), np.arange(1 << 20, many.sum() + (1 << 20), 1 << 20)) if len(many) else []
    start = 0
    for stop in [*(int(c) + 1 for c in cuts), len(number)]:  # a frequent phrase of many items is gone through in parts
        k, times = number[start:stop], many[start:stop]
        if len(k):
            place = np.repeat(items.first[k] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            doc, pos = np.repeat(doc_of[start:stop], times), np.repeat(position[start:stop], times)
            rows = np.unique(np.stack((doc, items.place_item[place], pos - np.array(starts)[doc] - items.place_at[place]), axis=1), axis=0)
            for d, item, diagonal in rows.tolist():
                diagonals[d, item].add(diagonal)
        start = max(start, min(stop, len(number)))
    for (doc, item), ds in diagonals.items():
        numbers, text = docs[doc]
        found = passages(numbers, items.texts[item], ds, p)
        spans = words_with_spans(text)[1] if found else []
        for a, b in found:
            yield ids[doc], items.ids[item], spans[a][0], spans[b - 1][1]


def leaked_passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", p: Passage = Passage(), shard_words: int = SHARD_WORDS) -> DataFrame:
    """Spans of test items inside documents: doc_id, item_id, start_pos, end_pos (code points, end exclusive), distinct.

    Null and empty texts hold nothing; items shorter than a passage leak nothing.
    Repeated rows give the same spans once. No shuffle of the texts: every task
    indexes its own rows, shard by shard; the items go to all tasks in blocks of
    bounded size, and each further block is one more pass.
    """
    spark = docs.sparkSession
    sizes = items.select(F.coalesce(F.sum(F.length(item_text)), F.lit(0)).alias("n")).first()["n"]  # one number
    blocks = max(1, -(-int(sizes) // ITEM_CHARS))
    corpus = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where(F.length("text") > 0)
    id_type, item_type = (dict(x.dtypes)[c] for x, c in ((docs, id_col), (items, item_id)))
    schema = f"doc_id {id_type}, item_id {item_type}, start_pos int, end_pos int"
    out = None
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.select(item_id, item_text).distinct().collect()])  # at most about ITEM_CHARS characters

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            known = Items.of(shared.value, p)
            columns = ["doc_id", "item_id", "start_pos", "end_pos"]
            ids, shard, size = [], [], 0
            numbered = _Numbers(known.number)
            for pdf in batches:
                for i, t in zip(pdf["id"].tolist(), pdf["text"].tolist(), strict=True):
                    numbers = np.array([n for n in map(numbered.__getitem__, raw_words(t)) if n >= 0], dtype=np.int64)
                    if size and size + len(numbers) > shard_words:
                        yield pd.DataFrame(search_shard(ids, shard, known, p), columns=columns)
                        ids, shard, size = [], [], 0
                    ids.append(i)
                    shard.append((numbers, t))
                    size += len(numbers) + 1
            yield pd.DataFrame(search_shard(ids, shard, known, p), columns=columns)

        found = corpus.mapInPandas(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def removal_spans(found: DataFrame) -> DataFrame:
    """Overlapping spans of one document merged, whatever item they come from: doc_id, start_pos, end_pos, item_ids."""
    spans = F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "item_id")))
    grouped = found.groupBy("doc_id").agg(spans.alias("s"))  # passages of one document
    merge = F.aggregate(
        "s",
        F.array().cast(f"array<struct<start_pos:int,end_pos:int,item_ids:array<{dict(found.dtypes)['item_id']}>>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end_pos"] >= x["start_pos"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start_pos"].alias("start_pos"), F.greatest(F.element_at(acc, -1)["end_pos"], x["end_pos"]).alias("end_pos"), F.array_union(F.element_at(acc, -1)["item_ids"], F.array(x["item_id"])).alias("item_ids"))))).otherwise(
            F.concat(acc, F.array(F.struct(x["start_pos"].alias("start_pos"), x["end_pos"].alias("end_pos"), F.array(x["item_id"]).alias("item_ids"))))
        ),
    )
    # element_at fails on an empty array under ANSI rules, so the condition above must not be evaluated for it
    return grouped.select("doc_id", F.inline(merge))
