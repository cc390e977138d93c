import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import leaks as L
from siltstone.llm.words import words_with_spans

ITEM = "While auditing leaden drawer of Zonjor the amber answer key listed Tavgal as entry and Kelghe was moved to the foreign chapter. After zigzag volunteers re-typed the Galhul ledger a clerk filed Deluld under silver number as the tilted errata sheet of Yalvex confirms."


@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_index_finds_every_occurrence(sequence, length):
    text = np.array(sequence, dtype=np.int64)
    phrases = np.array([[(i >> (2 * k)) & 3 for k in range(length)] for i in range(min(4**length, 64))], dtype=np.int64)
    number, position = L.FMIndex(text, 2).find(phrases)
    want = {(p, i) for p, ph in enumerate(phrases) for i in range(len(text) - length + 1) if (text[i : i + length] == ph).all()}
    assert {(int(a), int(b)) for a, b in zip(number, position, strict=True)} == want and len(number) == len(want)


def find(spark, texts, item=ITEM):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, item, "clash")], "item_id long, item_text string, doc_id string")
    return L.leaked_passages(docs, items)


def ids(spark, texts, item=ITEM):
    return {r["doc_id"] for r in find(spark, texts, item).select("doc_id").distinct().collect()}


def test_disguises(spark):
    w = ITEM.split()
    part = " ".join(w[2:20])
    altered = w[2:24]
    altered[5], altered[14] = "thing", "other"
    noisy = "".join(c + ("​" if c == "e" else "") for c in part)
    texts = [
        f"before {part} after", part.upper(), part.replace(" ", "&nbsp; "), " ".join(f"<b>{x}</b>" if i % 3 == 0 else x for i, x in enumerate(part.split())),
        noisy, part.replace("auditing", "audi-\nting").replace("drawer", "draw-\n> er"), "> " + part.replace(" the ", "\n> the "), " ".join(altered), "é".join(("", "")) + part.replace("amber", "ámber"),
        ". ".join(reversed(ITEM.rstrip(".").split(". "))),
        " ".join(w[2:14]), " ".join(w[2:8] + ["x", "y", "z"] + w[8:14]), "nothing of that", "", None, " ".join(w[i] if i % 4 else "zz" for i in range(30)),
    ]
    assert ids(spark, texts) == set(range(10))


def test_spans_and_removal(spark):
    text = "Intro words. " + ITEM + " End."
    r = L.removal_spans(find(spark, [text])).collect()
    assert len(r) == 1 and text[r[0]["start_pos"] : r[0]["end_pos"]].startswith("While auditing") and text[: r[0]["end_pos"]].endswith("confirms") and r[0]["item_ids"] == [7]


def test_small_shards_repeated_and_long_texts(spark):
    rng = random.Random(1)
    filler = " ".join(rng.choice("the of a clerk silver number zz yy".split()) for _ in range(3000))
    docs = spark.createDataFrame([(i, f"{filler} {ITEM} {filler}" if i % 5 == 0 else filler) for i in range(20)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, "short item"), (3, None)], "item_id long, item_text string")
    for shard in (100, 400_000):
        assert {(r["doc_id"], r["item_id"]) for r in L.leaked_passages(docs, items, shard_words=shard).select("doc_id", "item_id").distinct().collect()} == {(i, 1) for i in range(0, 20, 5)}
    assert L.leaked_passages(docs.limit(0), items).count() == 0 and L.leaked_passages(docs, items.limit(0)).count() == 0


def test_words():
    text = "Re-typed <b>wor</b>d&nbsp;x ÉTÉ đồng l'été co­op"
    words, spans = words_with_spans(text)
    assert words == ["retyped", "word", "x", "ete", "dong", "lete", "coop"] and text[slice(*spans[0])] == "Re-typed"


def test_short_runs_beside_a_phrase_count(spark):
    w = ITEM.split()
    altered = w[2:22]
    altered[4], altered[5] = "thing", "other"  # two in a row: a run of four before them
    dropped = w[2:12] + w[13:24]
    swapped = w[2:10] + w[12:20]
    assert ids(spark, [" ".join(altered), " ".join(dropped), " ".join(swapped[:8]) + " and more of that kind " + " ".join(swapped[8:12])]) == {0, 1}


def test_items_of_any_key_and_phrases_of_many_items(spark):
    docs = spark.createDataFrame([(f"d{i}", f"x {ITEM} y") for i in range(30)], "doc_id string, text string")
    items = spark.createDataFrame([(f"i{k:03d}", ITEM) for k in range(120)], "item_id string, item_text string")
    found = L.leaked_passages(docs, items)
    assert found.select("doc_id", "item_id").distinct().count() == 30 * 120
    spans = L.removal_spans(found).collect()
    assert len(spans) == 30 and all(len(r["item_ids"]) == 120 for r in spans)
