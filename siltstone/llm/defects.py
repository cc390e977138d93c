"""Broken prompt and response pairs.

A multi-label linear classifier over hashed n-grams and features of the pair
(overlap and order of the question's words, language, how an answer ends) flags
empty, truncated, refused and copied answers and answers in another language. It
is trained on answers of the data itself that are cut, copied, swapped or
replaced synthetically; each label's threshold is calibrated on held-out pairs.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.languages import LANGUAGES, LanguageModel, cleaned, letters
from siltstone.llm.words import folded
from siltstone.session import drawn

LABELS = ("empty", "refusal", "copy", "other_language", "truncated")
#: Size of the hashed feature space.
SPACE = 1 << 16
#: Pairs that the classifier is fitted on, at most; everything else covers all rows.
SAMPLE = 4_000
#: Hashed word and word-pair counts of the corpus.
COUNTS = 1 << 19
#: Lowest threshold tried for a label; 0.3 for the others. Clean answers can share the words of refusals.
RANGE = {"refusal": 0.5}
#: Pairs that are looked at together in a task.
BATCH = 2_000

#: What stands in the place of an answer.
PLACEHOLDERS = ("n/a", "na", "none", "null", "nil", "nan", "todo", "tbd", "tba", "empty", "answer", "response", "placeholder", "no answer", "not available", "undefined", "unknown", "xxx", "lorem ipsum", "câu trả lời", "trả lời", "réponse", "antwort", "respuesta", "jawaban", "insert answer here", "your answer here", "pending")

#: Pieces of refusals, by language; openers, cores and closers combine.
REFUSALS = {
    "en": (
        ("", "", "I'm sorry, but ", "Sorry, ", "Unfortunately, ", "I apologise, but ", "As an AI assistant, ", "Thanks for asking. ", "Thank you for your question. ", "Regrettably, ", "I'm afraid ", "To be honest, ", "For safety reasons, ", "I have to be clear: ", "At this point "),
        ("I can't help with that request", "I cannot answer this question", "I am unable to assist with this", "I am not able to provide that information", "I won't answer that", "I must decline to answer", "I'm not allowed to discuss this topic", "I'd rather not comment on this", "this is something I can't share", "my guidelines do not permit me to respond", "that is outside of what I may talk about", "we are not permitted to give an answer", "I have to decline", "no answer can be given here", "I don't have enough information to respond", "I will leave this question unanswered", "it is not possible for me to reply", "I do not have permission to answer", "I cannot provide an answer on this matter", "I won't go into this any further", "I must leave this one open", "this isn't something I may talk about", "I don't have sufficient context to answer", "the request goes beyond what I am permitted to do", "no reply can be given from my side", "I would prefer to pass on this one"),
        (".", ".", " at this time.", ", as it goes against my rules.", " because nothing was found.", ". Please contact an administrator.", ". Is there anything else I can help with?", ". I hope you understand.", ", whatever the case may be.", " and hope for your understanding.", "; please ask whoever is in charge."),
    ),
    "vi": (
        ("", "", "Xin lỗi, ", "Rất tiếc, ", "Tiếc là ", "Cảm ơn bạn đã hỏi. ", "Theo quy định, ", "Là trợ lý ảo, ", "Vì lý do an toàn, ", "Thành thật mà nói, "),
        ("tôi không thể trả lời câu hỏi này", "tôi không thể hỗ trợ yêu cầu này", "tôi không được phép nói về nội dung này", "tôi xin từ chối trả lời", "tôi buộc phải từ chối", "câu hỏi này nằm ngoài phạm vi của tôi", "tôi chưa được cấp quyền cung cấp thông tin đó", "tôi không có đủ thông tin để trả lời", "tôi đành bỏ qua câu hỏi này", "chúng tôi không thể cung cấp nội dung ấy", "tôi sẽ không bình luận về việc này", "tôi không tiện chia sẻ nội dung này", "tôi không trả lời được câu hỏi ấy", "tôi xin không đi sâu hơn", "tôi không có đủ ngữ cảnh để đưa ra câu trả lời", "nội dung này vượt quá quyền của tôi"),
        (".", ".", ", mong bạn hiểu cho.", ". Mong bạn thông cảm.", " vì không tìm thấy tài liệu nào.", ". Bạn cần gì khác không?", "; bạn vui lòng hỏi người quản trị.", " trong mọi trường hợp."),
    ),
    "fr": (
        ("", "Désolé, ", "Je suis désolé, mais ", "Malheureusement, ", "Pour des raisons de sécurité, ", "Merci pour votre question. "),
        ("je ne peux pas répondre à cette demande", "je ne suis pas autorisé à en parler", "il ne m'est pas permis de répondre", "je dois refuser", "aucune réponse n'est possible de ma part", "je préfère ne pas commenter ce sujet", "je n'ai pas le droit de donner cette information", "je ne suis pas en mesure de vous aider", "je dois laisser cette question sans réponse", "aucune réponse ne peut être donnée ici"),
        (".", ", merci de votre compréhension.", ". Veuillez contacter l'administrateur."),
    ),
    "de": (
        ("", "Es tut mir leid, aber ", "Leider ", "Aus Sicherheitsgründen: ", "Offen gesagt: ", "Danke für die Frage. "),
        ("kann ich diese Frage nicht beantworten", "ich kann dabei nicht helfen", "ich darf dazu nichts sagen", "ich muss diese Anfrage ablehnen", "dazu ist mir keine Antwort möglich", "ich möchte mich dazu nicht äußern", "ich bin nicht befugt, darüber zu sprechen", "ich muss die Frage offen lassen", "darüber darf ich keine Auskunft geben"),
        (".", ", bitte um Verständnis.", ". Bitte wenden Sie sich an die Verwaltung."),
    ),
    "es": (
        ("", "Lo siento, pero ", "Lamentablemente, ", "Por motivos de seguridad, ", "Gracias por su pregunta. "),
        ("no puedo responder a esta solicitud", "no puedo ayudar con eso", "no me está permitido hablar de ello", "debo rechazar la pregunta", "prefiero no comentar este tema", "no estoy autorizado a dar esa información", "no es posible dar una respuesta", "tengo que dejar la pregunta sin contestar", "no puedo facilitar esa información"),
        (".", ", espero que lo entienda.", ". Consulte al administrador."),
    ),
    "id": (
        ("", "Maaf, ", "Mohon maaf, ", "Sayangnya, ", "Demi keamanan, ", "Terima kasih atas pertanyaannya. "),
        ("saya tidak bisa menjawab pertanyaan ini", "saya tidak dapat membantu permintaan itu", "saya tidak diizinkan membahas hal ini", "saya harus menolak", "saya tidak berwenang memberikan informasi itu", "tidak ada jawaban yang bisa saya berikan", "saya memilih tidak berkomentar", "informasi seperti itu tidak bisa saya sampaikan", "pertanyaan ini di luar kewenangan saya"),
        (".", ", mohon dimaklumi.", ". Silakan hubungi pengelola."),
    ),
}
#: Words by which a speaker names themselves.
SPEAKER = frozenset("i my me i'm i'd we our us tôi toi mình chúng em je j moi nous mon ma ich mir mich wir uns mein yo me mi nosotros nos saya kami aku kita m".split())
#: Names of the languages in each of them, as a question may ask for one.
ASKED = {
    "en": r"english|tiếng anh|tieng anh|anglais|englisch|inglés|ingles|inggris",
    "vi": r"vietnamese|tiếng việt|tieng viet|vietnamien|vietnamesisch|vietnamita|vietnam(?=[\s.?!]*$)",
    "fr": r"french|tiếng pháp|tieng phap|français|francais|französisch|francés|frances|prancis",
    "de": r"german|tiếng đức|tieng duc|allemand|deutsch|alemán|aleman|jerman",
    "es": r"spanish|tiếng tây ban nha|tieng tay ban nha|espagnol|spanisch|español|espanol|castellano|spanyol",
    "id": r"indonesian|tiếng indonesia|indonésien|indonesisch|indonesio|bahasa indonesia",
}
_PLACEHOLDERS = frozenset(re.sub(r"[\W_]+", " ", x) for x in PLACEHOLDERS)
_ASKED = {k: re.compile(rf"(?<!\w)(?:{v})(?!\w)") for k, v in ASKED.items()}

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_MARKED = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?…]+(?!\S)|\n")
_DIGITS = re.compile(r"\d+")
_CLOSERS = "\"'”’»)]*_`"
_FINISH = ".!?…。"
_LIST_LINE = re.compile(r"\s*(?:[-*•+]|\d+[.)])\s+\S")
_LOG_LINE = re.compile(r"\s*(?:\d{1,2}:\d{2}(?::\d{2})?|\d{4}-\d{2}-\d{2}[T ])\S*\s")
_MARKER = re.compile(r"\s*(?:[-*•+]|\d+[.)])\s*")
_LEAD_IN = re.compile(r"\W*(?:\w+\W+){0,3}?\w+\s*[:：]\s+")
_WRAPPED = re.compile(r"[\[<({].*[\]>)}]")
_LABEL = re.compile(r"\w+\s*:")
_WANTS = re.compile(r"reply|answer|respond|write|trả lời|tra loi|viết|viet|répond|réponse|écri|antwort|beantwort|schreib|respond|contest|responda|escrib|jawab|tulis|balas|\bin\b|\bauf\b|\ben\b|\bbằng\b|\bbang\b|dalam")
#: Words and questions that a task keeps the properties of, at most; then it starts anew.
KEPT = 1 << 18


def tokens(text: str) -> list[str]:
    return _WORD.findall(_DIGITS.sub("0", text.lower()))


def is_finished(text: str) -> bool:
    """Ends with a full stop or the like, whatever brackets and quotes close after it."""
    return text.rstrip().rstrip(_CLOSERS).endswith(tuple(_FINISH))


def _hash(word: str) -> int:
    return zlib.crc32(word.encode())


def _joint(*hashes):
    """Cell of a word, pair or triple from the hashes of its words; numbers or arrays."""
    h = hashes[0]
    for x in hashes[1:]:
        h = (h * 1000003 + x) & 0xFFFFFFFFFFFF
    return (h ^ (h >> 17)) % COUNTS


class _Numbered(dict):
    """Numbers its keys as they come."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class Words:
    """Words by number, with what is known of each: hash, hash of the folded form, and whether it is a mark that ends (1) or breaks (2) a sentence."""

    def __init__(self) -> None:
        self.number = _Numbered()
        self.hash = self.plain = np.empty(0, dtype=np.int64)
        self.mark = np.empty(0, dtype=np.int8)
        self.speaks = self.long = np.empty(0, dtype=bool)

    def full(self) -> bool:
        return len(self.number) > KEPT

    def of(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words one after the other, and the list that each belongs to."""
        lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        flat = np.fromiter(map(self.number.__getitem__, chain.from_iterable(lists)), dtype=np.int64, count=int(lengths.sum()))
        if len(self.number) > len(self.hash):
            new = list(islice(self.number, len(self.hash), None))
            more = lambda old, values, kind: np.append(old, np.array(values, dtype=kind))
            self.hash = more(self.hash, [_hash(w) for w in new], np.int64)
            self.plain = more(self.plain, [_hash(folded(w)) for w in new], np.int64)
            self.mark = more(self.mark, [2 if w == "\n" else int(w[0] in ".!?…") for w in new], np.int8)
            self.speaks = more(self.speaks, [w in SPEAKER for w in new], bool)
            self.long = more(self.long, [len(w) > 2 for w in new], bool)
        return flat, np.repeat(np.arange(len(lists)), lengths)


#: Each label sees the cells below this: other defects than refusals don't depend on wording, and language only on language.
_SEES = {"refusal": SPACE, "other_language": SPACE // 4}


@lru_cache(maxsize=1 << 17)
def _zoned(name: str) -> int:
    """The features of language and length fill the lowest quarter of the space; the n-grams of the answer fill the upper half."""
    return zlib.crc32(name.encode()) % (SPACE // 4) + (0 if name.startswith(("lang:", "n:", "bias")) else SPACE // 4)


@lru_cache(maxsize=64)
def _cells(group: str, n: int) -> np.ndarray:
    """Cells of a feature with n values."""
    return np.array([_zoned(f"{group}:{i}") for i in range(n)], dtype=np.int64)


@dataclass
class Corpus:
    """Hashed counts over all finished sentences: words, pairs, and words, pairs and triples that end a sentence."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(COUNTS, dtype=np.int64))
    ends: np.ndarray = field(default_factory=lambda: np.zeros(COUNTS, dtype=np.int64))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(COUNTS, dtype=np.int64))
    pair_ends: np.ndarray = field(default_factory=lambda: np.zeros(COUNTS, dtype=np.int64))
    asked: np.ndarray = field(default_factory=lambda: np.zeros(COUNTS, dtype=np.int64))
    whole: np.ndarray = field(default_factory=lambda: np.zeros(COUNTS, dtype=np.int64))

    def add(self, questions: list[str], answers: list[str], known: Words | None = None) -> None:
        known = known or Words()
        flat, owner = known.of([tokens(q) for q in questions])
        if len(flat):
            once = np.unique((owner << 32) | known.plain[flat]) & 0xFFFFFFFF
            np.add.at(self.asked, _joint(once), 1)
        short = [bare(a) for a in answers if len(a) < 80]
        np.add.at(self.whole, _joint(np.array([_hash(x) for x in short if x], dtype=np.int64)), 1)
        flat, _ = known.of([_MARKED.findall(_DIGITS.sub("0", "\n".join(map(prose, answers)).lower()) + "\n")])
        mark = known.mark[flat]
        closed = mark[mark > 0] == 1  # per sentence, whether it is finished
        sentence, is_word = np.cumsum(mark > 0), mark == 0
        use = np.flatnonzero(is_word)[closed[sentence[is_word]]]
        if not len(use):
            return
        h, owner = known.hash[flat[use]], sentence[use]
        same = owner[1:] == owner[:-1]
        last = np.append(~same, True)
        np.add.at(self.words, _joint(h), 1)
        np.add.at(self.ends, _joint(h[last]), 1)
        pair = _joint(h[:-1], h[1:])
        np.add.at(self.pairs, pair[same], 1)
        np.add.at(self.pair_ends, pair[same & last[1:]], 1)
        triple = same[1:] & same[:-1] & last[2:]
        np.add.at(self.pair_ends, _joint(h[:-2], h[1:-1], h[2:])[triple], 1)

    def rare(self, word: str) -> bool:
        return self.words[_joint(_hash(word))] < 3


def bare(text: str) -> str:
    """Words and blanks of a text in lower case, as placeholders compare."""
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def prose(text: str) -> str:
    """The answer without code fences, tables, lists and log lines."""
    if "\n" not in text and "`" not in text and (text[:1].isalpha() or not (_LIST_LINE.match(text) or _LOG_LINE.match(text) or text.startswith("|"))):
        return text
    text = re.sub(r"```[\s\S]*?(?:```|\Z)", "\n", text)
    return "\n".join(x for x in text.split("\n") if not (_LIST_LINE.match(x) or _LOG_LINE.match(x) or x.lstrip().startswith("|")))


def fit_corpus(pairs: DataFrame) -> Corpus:
    """Counts over all pairs; the driver gets at most six tables of COUNTS numbers."""
    names = list(Corpus.__dataclass_fields__)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, known = Corpus(), Words()
        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                part = pdf.iloc[at : at + BATCH]
                c.add(part["question"].fillna("").tolist(), part["answer"].fillna("").tolist(), known)
                if known.full():
                    known = Words()
        for k, name in enumerate(names):
            table = getattr(c, name)
            at = np.flatnonzero(table)
            yield pd.DataFrame({"cell": at + k * COUNTS, "n": table[at]})

    cells = pairs.select("question", "answer").mapInPandas(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(len(names) * COUNTS, dtype=np.int64)
    flat[cells["cell"].to_numpy(dtype=np.int64)] = cells["n"].to_numpy(dtype=np.int64)
    return Corpus(*np.minimum(flat, np.iinfo(np.int32).max).astype(np.int32).reshape(len(names), COUNTS))  # goes to every task


def expected_language(question: str, own: str) -> str:
    """The language an answer should be in: one that the question asks for, else the question's own."""
    low = question.lower()
    if _WANTS.search(low):
        for code, pattern in _ASKED.items():
            if pattern.search(low):
                return code
    return own


def _longest_common(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits: a zero at place i of row says that the length grows at word i of a."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole = row = (1 << len(a)) - 1
    for y in b:
        if at := row & places.get(y, 0):
            row = (row + at | row - at) & whole
    return len(a) - row.bit_count()


@dataclass
class Sparse:
    """Features as (row, cell, value) triples in the order of the rows; those from ``wording`` on are the answers' n-grams."""

    rows: np.ndarray
    cells: np.ndarray
    values: np.ndarray
    wording: int


class Features:
    """Sparse features of pairs."""

    def __init__(self, corpus: Corpus, model: LanguageModel) -> None:
        self.corpus, self.model = corpus, model
        self.words, self.questions = Words(), {}

    def languages(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best language and its margin per text; margin 0 without enough words."""
        pieces = [letters(cleaned(t)) for t in texts]
        scores = self.model.scores(pieces)
        top = np.partition(scores, -2, axis=1) if len(scores) else scores
        margin = np.where([p.count(" ") > 4 for p in pieces], top[:, -1] - top[:, -2], 0.0)
        return scores.argmax(1), margin

    def _asked(self, questions: list[str]) -> list[tuple]:
        """Per question: tokens, best language, its margin, expected language. A question is looked at once."""
        if len(self.questions) > KEPT // 8:
            self.questions = {}
        new = [q for q in dict.fromkeys(questions) if q not in self.questions]
        if new:
            best, margin = self.languages(new)
            for q, k, m in zip(new, best.tolist(), margin.tolist(), strict=True):
                self.questions[q] = (tokens(q), k, m, LANGUAGES.index(expected_language(q, LANGUAGES[k])))
        return [self.questions[q] for q in questions]

    def of(self, questions: list[str], answers: list[str]) -> Sparse:
        if self.words.full():
            self.words = Words()
        n_rows, rows = len(questions), np.arange(len(questions))
        known = self._asked(questions)
        q_lang, q_margin, expected = (np.array([k[i] for k in known]) for i in (1, 2, 3))
        a_lang, a_margin = self.languages([prose(a) for a in answers])
        mismatch = (a_margin > 0) & (q_margin > 1) & (a_lang != expected) & (a_lang != q_lang)
        texts = [a.replace("​", "").replace("﻿", "").strip() for a in answers]
        asked, own = [k[0] for k in known], [tokens(t) for t in texts]
        q_flat, q_owner = self.words.of(asked)
        flat, owner = self.words.of(own)
        n = np.bincount(owner, minlength=n_rows)

        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def put(group: str, value: np.ndarray, size: int, where: np.ndarray | None = None) -> None:
            at = rows if where is None else np.flatnonzero(where)
            cell = _cells(group, size)[value[at].astype(np.int64)]
            parts.append((at, cell, np.ones(len(at), dtype=np.float32)))

        put("bias", np.zeros(n_rows), 1)
        put("n", np.minimum(n, 3) * 2 + (n > 6), 8)
        put("lang", mismatch * 4 + np.digitize(a_margin, (1, 3, 8)), 8)
        # the question's words in the answer, and the answer's words that questions and finished answers know
        w, c = self.words, self.corpus
        content = np.unique((q_owner << 32 | w.plain[q_flat])[w.long[q_flat]])
        said = np.unique(owner << 32 | w.plain[flat])
        n_content, n_said = (np.bincount(x >> 32, minlength=n_rows) for x in (content, said))
        common = np.bincount(np.intersect1d(content, said, assume_unique=True) >> 32, minlength=n_rows)
        overlap = common / np.maximum(1, np.minimum(n_content, n_said))
        off = overlap < 0.34
        in_domain = (c.words[_joint(w.hash)] >= 3) & (c.asked[_joint(w.plain)] > 1)
        domain = np.bincount(owner, weights=in_domain[flat], minlength=n_rows) / np.maximum(1, n)
        put("overlap", overlap * 5, 6)
        put("speaker", (np.bincount(owner, weights=w.speaks[flat], minlength=n_rows) > 0) * 2 + off, 4)
        put("domain", (domain * 5).astype(np.int64) * 2 + off, 12)

        named_rows, named, named_values = [], [], []
        for i, (text, words, ask) in enumerate(zip(texts, own, asked, strict=True)):
            for name, value in self._pair(text, words, ask):
                named_rows.append(i)
                named.append(_zoned(name))
                named_values.append(value)
        parts.append((np.array(named_rows, dtype=np.int64), np.array(named, dtype=np.int64), np.array(named_values, dtype=np.float32)))
        wording = sum(len(p[0]) for p in parts)
        # the n-grams of the answers' words, weighted by their number
        scale = (1 / np.sqrt(np.maximum(4, n))).astype(np.float32)
        first = h = w.hash[flat]
        for size in (1, 2, 3):
            if size > 1:
                h = (h[:-1] * 1000003 + first[size - 1 :]) & 0xFFFFFFFFFFFF if len(h) else h
            at = owner[: len(h)]
            same = at == owner[size - 1 :] if len(h) else np.empty(0, dtype=bool)
            at = at[same]
            parts.append((at, SPACE // 2 + ((h ^ (h >> 19)) % (SPACE // 2))[same], scale[at]))
        return Sparse(*map(np.concatenate, zip(*parts, strict=True)), wording)

    def _pair(self, text: str, words: list[str], asked: list[str]) -> Iterator[tuple[str, float]]:
        """Named features of one pair's form: empty, copied, cut."""
        n, c = len(words), self.corpus
        # empty
        if n <= 6:
            plain = bare(text)
            if not plain:
                yield "nothing", 1.0
            else:
                if plain in _PLACEHOLDERS:
                    yield "placeholder", 1.0
                # the same few words for many different questions
                yield f"often:{min(6, int(np.log2(1 + c.whole[_joint(_hash(plain))])))}:{n > 3}", 1.0
                if n <= 3 and text[0] in "[<({" and _WRAPPED.fullmatch(text):
                    yield "wrapped", 1.0
                if text[-1] == ":" and _LABEL.fullmatch(text):
                    yield "label_only", 1.0

        # copy
        body = words
        if n > 4 and (":" in text or "：" in text) and words[:2] != asked[:2] and (m := _LEAD_IN.match(text)):
            body = tokens(text[m.end() :])
        if n and asked and len(body) <= 2 * len(asked) + 4:
            common = _longest_common(asked, body)
            cover_q, cover_a = common / len(asked), common / max(1, len(body))
            head = body[:5]
            lead = sum(w in head for w in asked[:3]) / min(3, len(asked))
            yield f"cq:{int(cover_q * 10)}", 1.0
            yield f"ca:{int(cover_a * 10)}", 1.0
            if cover_q > 0.8 and cover_a > 0.85 and lead > 0.6:
                yield "whole", 1.0
                if body[-1] == asked[-1]:
                    yield "whole_tail", 1.0
            if cover_a > 0.8 and lead < 0.6:
                yield "clause", 1.0
            yield "lead", lead
            yield f"lead_ca:{int(lead * 3)}:{int(cover_a * 5)}", 1.0
        else:
            yield "longer", 1.0

        # truncated
        last_line = text if "\n" not in text else text.rsplit("\n", 1)[-1]
        fences = text.count("```") if "`" in text else 0
        begin = last_line.lstrip()[:1]
        if fences:
            kind = "open_code" if fences % 2 else "code" if text.endswith("```") else ""
        else:
            kind = ""
        if not kind:
            if begin.isalpha() or not begin:
                kind = "prose"
            elif begin == "|":
                kind = "table"
            elif _LOG_LINE.match(last_line + " "):
                kind = "log"
            elif last_line is not text and _MARKER.fullmatch(last_line):
                kind = "marker"
            else:
                kind = "list" if _LIST_LINE.match(last_line) else "prose"
        stop = is_finished(text)
        yield f"kind:{kind}:{stop}", 1.0
        if kind == "list":
            item = tokens(last_line)
            yield f"item_end:{c.rare(item[-1]) if item else ''}", 1.0
            yield f"item_pair:{len(item) > 1 and c.pairs[_joint(_hash(item[-2]), _hash(item[-1]))] > 0}", 1.0
            yield f"item_end1:{item[-1] if item and not c.rare(item[-1]) else ''}", 1.0
        if kind == "prose" and not stop and n > 6:
            final = "," if text[-1] in ",;:–—-" else "(" if text.rfind("(") > text.rfind(")") or text.count("“") > text.count("”") else ""
            yield f"close:{final}", 1.0
            w2, w1, w0 = words[-3:]
            h2, h1, h0 = map(_hash, (w2, w1, w0))
            m0, m1 = ("~" if c.rare(w0) else w0), ("~" if c.rare(w1) else w1)
            yield f"rare_end:{m0 == '~'}:{w0[:1].isdigit()}", 1.0
            raw = text.rsplit(None, 1)[-1]
            yield f"capital_end:{raw[:1].isupper()}:{m0 == '~'}", 1.0
            both = _joint(h1, h0)
            p, pe = c.pairs[both], c.pair_ends[both]
            u, ue = c.words[_joint(h0)], c.ends[_joint(h0)]
            t3 = c.pair_ends[_joint(h2, h1, h0)]
            yield f"triple_end:{int(min(3, math.log2(1 + t3)))}:{p > 0}", 1.0
            yield f"pair_end:{'new' if p == 0 else _log_odds(pe, p)}", 1.0
            yield f"word_end:{'new' if u == 0 else _log_odds(ue, u)}", 1.0
            yield f"end1:{m0}", 1.0
            yield f"end2:{m1} {m0}", 1.0
            yield f"before_rare:{m1 if m0 == '~' else ''}", 1.0
            yield "end3:" + text[-3:].lower(), 0.5


def _log_odds(part: int, whole: int) -> int:
    return int(max(-4.0, min(4.0, math.log((part + 0.5) / (max(whole - part, 0) + 0.5)))))


def refusal(rng: random.Random, code: str) -> str:
    opener, core, closer = (rng.choice(x) for x in REFUSALS[code])
    text = opener + core + closer
    if rng.random() < 0.15:
        text += " " + rng.choice(REFUSALS[code][1]).capitalize() + "."
    return text[:1].upper() + text[1:]


def cut(rng: random.Random, answer: str, corpus: Corpus) -> str:
    """An answer that breaks off: inside a word, after a word, after a comma, or in a bracket that stays open; never where finished sentences are known to end."""
    stops = [m.end() for m in re.finditer(r"[.!?]", answer)]
    for _ in range(20):
        at = rng.randrange(max(12, len(answer) // 4), len(answer) - 2)
        piece = answer[:at].rstrip()
        if all(abs(len(piece) - s) > 3 for s in stops) and len(piece.split()) > 8:
            way = rng.random()
            if way > 0.55:
                piece = piece.rsplit(None, 1)[0].rstrip(",.;:")
                if way > 0.9:
                    piece += " (" + " ".join(answer.split()[:3])
                elif way > 0.82:
                    piece += ","
            if is_finished(piece) or (way <= 0.82 and corpus.pair_ends[_joint(*map(_hash, tokens(piece)[-3:]))]):
                continue
            return piece
    return ""


def synthetic(pairs: list[tuple[str, str]], languages: list[str], corpus: Corpus, seed: int) -> tuple[list[tuple[str, str]], np.ndarray]:
    """Labelled pairs made from clean ones: one column per label, plus clean variants (full stop dropped, question repeated before the answer). NaN: left open."""
    rng = random.Random(seed)
    by_lang: dict[str, list[str]] = {}
    for (_, a), code in zip(pairs, languages, strict=True):
        if len(tokens(prose(a))) > 7:
            by_lang.setdefault(code, []).append(a)
    out, labels = [], []

    def add(q: str, a: str, label: str | None, unsure: str | None = None) -> None:
        if a or label == "empty":
            out.append((q, a))
            labels.append([np.nan if unsure == x else label == x for x in LABELS])

    for (q, a), code in zip(pairs, languages, strict=True):
        whole = is_finished(a) and "\n" not in a and len(a) > 40
        if whole:
            add(q, cut(rng, a, corpus), "truncated")
            bare = re.sub(r"[.!?…]+\s*$", "", a)
            add(q, bare, None)
            if rng.random() < 0.5:
                more = rng.choice(pairs)[1].split()[1:-3]
                follow = [w for w in more if w.islower() and w.isalpha() and len(w) < 8]
                if follow:
                    add(q, bare + " " + " ".join(follow[: rng.randrange(1, 3)]), "truncated")
        lines = a.split("\n")
        if len(lines) > 2 and _LIST_LINE.match(lines[-1]) and rng.random() < 0.9:
            marker, item = re.match(r"(\s*\S+\s+)(.*)", lines[-1]).groups()
            inside = [k for k in range(1, len(item)) if item[k - 1].isalnum() and item[k].isalnum()]  # a cut between words might be an item
            end = item[: rng.choice(inside)] if inside and rng.random() < 0.5 else ""
            if end != item:
                add(q, "\n".join([*lines[:-1], (marker + end).rstrip()]), "truncated")
        way = rng.random()
        if way < 0.5:
            add(q, refusal(rng, code if rng.random() < 0.9 else rng.choice(LANGUAGES)), "refusal", "other_language")
        if way < 0.4:
            copied = rng.choice((q, q.upper(), f'"{q}"', f"“{q}”", q.rstrip("?. "), f"{rng.choice(('Question', 'You asked', 'Q', 'Câu hỏi', 'Frage', 'Pregunta', 'Pertanyaan'))}: {q[:1].lower()}{q[1:]}", "  ".join(q.split())))
            if rng.random() < 0.3 and len(q.split()) > 6:
                ws = copied.split()
                del ws[rng.randrange(1, len(ws))]
                copied = " ".join(ws)
            add(q, copied, "copy")
            add(q, f"{q} {a}", None)
        others = [c for c in by_lang if c != code and by_lang[c]]
        if way > 0.6 and others:
            add(q, rng.choice(by_lang[rng.choice(others)]), "other_language")
        if way > 0.85:
            word = rng.choice(PLACEHOLDERS)
            add(q, rng.choice(("", " ", "\n\n", "-", "--", "...", "…", "​", "```\n```", "?", word, word.upper(), word.capitalize(), f"[{word}]", f"<{word}>", f"({word})", f"{word.capitalize()}:")), "empty")
    return out, np.array(labels, dtype=np.float32)


@dataclass
class Classifier:
    """weights: SPACE x labels. thresholds: of the probabilities."""

    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, found: Sparse, n: int) -> np.ndarray:
        z = np.empty((n, len(LABELS)))
        for k, label in enumerate(LABELS):
            end = len(found.rows) if label == "refusal" else found.wording
            z[:, k] = np.bincount(found.rows[:end], weights=self.weights[found.cells[:end], k] * found.values[:end], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Design:
    """The triples that one label sees, once in the order of the rows and once in that of the cells, for sums over either."""

    def __init__(self, found: Sparse, n: int, label: str) -> None:
        seen = found.cells < _SEES.get(label, SPACE // 2)
        rows, cells, values = found.rows[seen], found.cells[seen], found.values[seen].astype(np.float64)
        self.used, at = np.unique(cells, return_inverse=True)
        order = np.argsort(rows, kind="stable")
        self.row_at, self.row_values = at[order], values[order]
        self.row_start = np.searchsorted(rows[order], np.arange(n))  # every row has a bias, so none is empty
        order = np.argsort(at, kind="stable")
        self.cell_rows, self.cell_values = rows[order], values[order]
        self.cell_start = np.searchsorted(at[order], np.arange(len(self.used)))

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.row_at] * self.row_values, self.row_start)

    def gradient(self, error: np.ndarray) -> np.ndarray:
        return np.add.reduceat(error[self.cell_rows] * self.cell_values, self.cell_start)


def _train(designs: list[_Design], y: np.ndarray, mask: np.ndarray, start: np.ndarray | None = None, rounds: int = 110, l2: float = 2e-5) -> np.ndarray:
    """Logistic regression per label by Adam over the whole (bounded) sample; mask leaves examples out per label. start: weights to go on from.

    Each label sees its zones of the feature space only.
    """
    out = np.zeros((SPACE, y.shape[1]), dtype=np.float32)
    for k, design in enumerate(designs):
        w = np.zeros(len(design.used)) if start is None else start[design.used, k].astype(np.float64)
        m = v = np.zeros(len(design.used))
        weight = mask[:, k] / max(1.0, mask[:, k].sum())
        positive = (weight * y[:, k]).sum()
        weight = weight * np.where(y[:, k] > 0, 0.35 / max(positive, 1e-9), 0.65 / max(weight.sum() - positive, 1e-9))
        for t in range(1, rounds + 1):
            p = 1 / (1 + np.exp(-np.clip(design.scores(w), -30, 30)))
            g = design.gradient(weight * (p - y[:, k])) + l2 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        out[design.used, k] = w
    return out


def fit(pairs: DataFrame, corpus: Corpus, model: LanguageModel, sample: int = SAMPLE, seed: int = 5) -> Classifier:
    """Fits on at most ``sample`` pairs: theirs count as clean, except that a second round drops those that the first one flags."""
    n = pairs.count()
    rows = [(r["question"] or "", r["answer"] or "") for r in drawn(pairs.select("question", "answer"), sample, n, seed).collect()]  # at most sample rows
    if not rows:
        return Classifier(np.zeros((SPACE, len(LABELS)), dtype=np.float32), np.full(len(LABELS), 0.5))
    features = Features(corpus, model)
    languages = [LANGUAGES[k] for k in features.languages([q for q, _ in rows])[0]]
    made, y_made = synthetic(rows, languages, corpus, seed)
    questions, answers = zip(*(rows + made), strict=True)
    triples = features.of(list(questions), list(answers))
    y = np.vstack((np.zeros((len(rows), len(LABELS)), dtype=np.float32), y_made.reshape(-1, len(LABELS))))
    mask = (~np.isnan(y)).astype(np.float32)
    y = np.nan_to_num(y)
    held = np.random.default_rng(seed).random(len(y)) < 0.2
    real = np.arange(len(y)) < len(rows)
    designs = [_Design(triples, len(y), label) for label in LABELS]
    weights = _train(designs, y, np.where(held[:, None], 0, mask))
    for _ in range(2):
        p = Classifier(weights, np.full(len(LABELS), 0.5)).probabilities(triples, len(y))
        k = LABELS.index("refusal")  # its wording differs from pair to pair; the others' features leave little doubt
        mask[real & (p[:, k] > 0.3), k] = 0  # probably refusals themselves
        sure = real & (p[:, k] > 0.8)
        y[sure, k] = mask[sure, k] = 1  # real wording joins the synthetic one
        weights = _train(designs, y, np.where(held[:, None], 0, mask), weights, 50)
    classifier = Classifier(weights, np.full(len(LABELS), 0.5))
    p = classifier.probabilities(triples, len(y))
    for k, label in enumerate(LABELS):
        use = held & (mask[:, k] > 0)
        scale, scores = np.arange(RANGE.get(label, 0.3), 0.9, 0.02), []
        for t in scale:
            said, true = p[use, k] > t, y[use, k] > 0
            # a clean pair weighs twice, as in the data clean pairs are far more frequent than here
            scores.append(2 * (said & true).sum() / max(1, 2 * (said & true).sum() + (~said & true).sum() + 2 * (said & ~true).sum()))
        # of thresholds about as good: the middle where features leave little doubt, else the lowest, as real defects score below synthetic ones
        good = scale[np.flatnonzero(np.array(scores) >= max(scores) - 0.01)]
        classifier.thresholds[k] = (good[0] + good[-1]) / 2 if label in ("empty", "copy") else good[0]
    return classifier


def defective_pairs(pairs: DataFrame, model: LanguageModel, sample: int = SAMPLE) -> DataFrame:
    """Defective pairs: src_table, record_id, defect, score, distinct.

    pairs has src_table, record_id, question and answer; other columns are ignored.
    A null answer is an empty one; a null question matches nothing and asks for no
    language. Each pair gets at most one defect, the first of LABELS whose
    probability exceeds its threshold. An empty table gives no rows.
    """
    rows = pairs.select("src_table", "record_id", "question", "answer")
    corpus = fit_corpus(rows)
    classifier = fit(rows, corpus, model, sample)
    shared = pairs.sparkSession.sparkContext.broadcast((corpus, model, classifier))  # tables of fixed size

    def flag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        corpus, model, classifier = shared.value
        features = Features(corpus, model)
        for whole in batches:
            for at in range(0, len(whole), BATCH):
                pdf = whole.iloc[at : at + BATCH]
                p = classifier.probabilities(features.of(pdf["question"].fillna("").tolist(), pdf["answer"].fillna("").tolist()), len(pdf))
                over = p > classifier.thresholds
                some = over.any(1)
                first = over.argmax(1)
                yield pd.DataFrame({"src_table": pdf["src_table"], "record_id": pdf["record_id"], "defect": np.array(LABELS, dtype=object)[first], "score": p[np.arange(len(p)), first]})[some]

    return rows.mapInPandas(flag, f"src_table string, record_id {dict(rows.dtypes)['record_id']}, defect string, score double").distinct()
