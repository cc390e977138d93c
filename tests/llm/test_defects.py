import random

import pytest

from siltstone.llm import defects as D
from siltstone.llm import languages as L

SUBJECTS = {"en": ["the worker", "the loader", "the monitor", "the cache", "the router"], "de": ["der Lader", "der Zähler", "der Speicher", "der Prüfer", "der Verteiler"]}
ACTS = {"en": ["reads the settings at the start", "drops rows without a title", "keeps the older copy of a page", "reports the slowest step first"], "de": ["liest die Einstellungen beim Start", "verwirft Zeilen ohne Titel", "behält die ältere Kopie einer Seite", "meldet zuerst den langsamsten Schritt"]}
TAILS = {"en": ["until the index has been rebuilt", "because the export arrives late", "in every region but one"], "de": ["bis der Index neu gebaut ist", "weil der Export spät eintrifft", "in jeder Region außer einer"]}


def pair(rng, code):
    s, a = rng.choice(SUBJECTS[code]), rng.choice(ACTS[code])
    q = f"How can I confirm that {s} {a}?" if code == "en" else f"Woran sieht man, dass {s} so arbeitet: {a}?"
    more = f"{rng.choice(SUBJECTS[code])} {rng.choice(ACTS[code])} {rng.choice(TAILS[code])}."
    return q, f"{s[0].upper()}{s[1:]} {a} {rng.choice(TAILS[code])}. {more[0].upper()}{more[1:]}"


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(2)
    clean = [pair(rng, rng.choice(("en", "en", "de"))) for _ in range(700)]
    clean += [(q, rng.choice(("Yes", "12 ms", "Twice a day", "Steps:\n- the loader\n- the cache"))) for q, _ in clean[:80]]
    texts = [(t, "en") for code, ts in (("en", clean),) for _, t in ts if t.startswith("The")] + [(t, "de") for _, t in clean if t.startswith("Der")]
    model = L.fit(spark.createDataFrame(texts, "text string, lang string"))
    return clean, model


def run(spark, rows, model):
    df = spark.createDataFrame([("t", str(i), q, a, "clash", 1.0) for i, (q, a) in enumerate(rows)], "src_table string, record_id string, question string, answer string, defect string, score double")
    return {int(r["record_id"]): r["defect"] for r in D.defective_pairs(df, model).collect()}


def test_held_out_defects(spark, fitted):
    clean, model = fitted
    rng = random.Random(9)
    q, a = pair(rng, "en")
    _, german = pair(rng, "de")
    special = [
        (q, None), (q, " "), (q, "N/A"), (q, "[answer]"), (q, a[: len(a) - 9]), (q, "I'm sorry, but I cannot answer this question."), (q, q), (q, f"You asked: {q}"), (q, q.upper()), (q, german),
        (q, a), (q, a[:-1]), (q, "Yes"), (q, "3 ms"), (q, q + " " + a), (q, "Steps:\n- the loader\n- the router"), (q + " Please answer in German.", german), (None, a), (None, None), (q, a + "\n```\n{}\n```"),
    ]
    got = run(spark, clean + special, model)
    n = len(clean)
    want = ["empty", "empty", "empty", "empty", "truncated", "refusal", "copy", "copy", "copy", "other_language"] + [None] * 8 + ["empty", None]
    have = [got.get(n + i) for i in range(len(special))]
    assert sum(x == y for x, y in zip(have, want, strict=True)) >= len(want) - 1, list(zip(special, have, want, strict=True))
    assert sum(k < n for k in got) <= 0.03 * n


def test_empty_table(spark, fitted):
    df = spark.createDataFrame([], "src_table string, record_id string, question string, answer string")
    assert D.defective_pairs(df, fitted[1]).count() == 0


def test_expected_language():
    assert D.expected_language("Why? Please reply in Vietnamese.", "en") == "vi"
    assert D.expected_language("Warum? Bitte auf Englisch antworten.", "de") == "en"
    assert D.expected_language("Why is the English list long?", "en") == "en"



def test_longest_common():
    assert D._longest_common("a b c d".split(), "x b d".split()) == 2
    assert D._longest_common([], ["a"]) == D._longest_common(["a"], []) == 0
    rng = random.Random(1)
    for _ in range(200):
        a, b = (rng.choices("abcde", k=rng.randrange(90)) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        assert D._longest_common(a, b) == row[-1]


def test_the_order_of_the_words_counts():
    q, features = "Is the cache older than the index?", D.Features(D.Corpus(), None)
    copied, answered = (dict(features._pair(a, D.tokens(a), D.tokens(q))) for a in (q, "The index is older than the cache."))
    assert copied["whole"] == 1 and "whole" not in answered and "cq:5" in answered and "ca:5" in answered


def test_later_rounds_train_every_label(spark, fitted, monkeypatch):
    seen, train = [], D._train

    def spy(triples, y, mask, start=None, *more):
        out = train(triples, y, mask, start, *more)
        if start is not None:
            seen.append((out != start).any(0).all())
        return out

    monkeypatch.setattr(D, "_train", spy)
    pairs = spark.createDataFrame(fitted[0][:200], "question string, answer string")
    D.fit(pairs, D.fit_corpus(pairs), fitted[1])
    assert seen == [True, True]
