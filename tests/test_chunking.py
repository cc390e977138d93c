import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.operators import chunking as C


def cut(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr.alias("x")).first()["x"]


def test_fixed_windows_cover_the_text(spark):
    for n in (1, 9, 10, 11, 25, 26):
        text = "".join(chr(97 + i % 26) for i in range(n))
        got = cut(spark, text, C.fixed(F.col("t"), 10, 3))
        want, i = [], 0
        while True:
            want.append(text[i : i + 10])
            if i + 10 >= n:
                break
            i += 7
        assert got == want
    assert cut(spark, "😀" * 12, C.fixed(F.col("t"), 10, 3)) == ["😀" * 10, "😀" * 5]


def test_sentences(spark):
    assert cut(spark, "A b. C d! E?\nF", C.by_sentences(F.col("t"), 3)) == ["A b. C d! E?", "F"]
    assert cut(spark, "", C.by_sentences(F.col("t"), 3)) == []


def test_windows(spark):
    assert cut(spark, "ab  cd", C.windows(F.col("t"), 2, 0)) == ["ab", None, "cd"]
    assert cut(spark, "", C.windows(F.col("t"), 2, 0)) == []


@given(st.text(alphabet="ab .\n", max_size=80), st.integers(3, 20))
@settings(max_examples=200, deadline=None)
def test_pieces_are_short_and_lose_only_blanks_and_separators(text, size):
    got = C.pieces(text, size)
    assert all(len(p) <= size for p in got)
    assert "".join("".join(got).split()).replace(".", "") == "".join(text.split()).replace(".", "")


def test_documents(spark):
    docs = spark.createDataFrame([(1, " ab ", "x"), (2, " ", "y"), (3, None, "z")], "id long, content string, chunk_index string")
    rows = C.chunk_documents(docs, C.recursive(F.col("_text"), 10)).collect()
    assert [(r["id"], r["content"], r["chunk_index"], r["n_chunks"]) for r in rows] == [("1_chunk_0", "ab", 0, 1)]
    assert C.chunk_documents(docs.limit(0), C.fixed(F.col("_text"))).count() == 0


def test_compare(spark):
    rows = {r["strategy"]: r for r in C.compare_strategies(spark.createDataFrame([(1, "")], "id int, t string"), "id", "t").collect()}
    assert rows["by_sentences"]["n_chunks"] == 0 and rows["by_sentences"]["avg_length"] == 0.0


def test_blank_windows_keep_their_numbers(spark):
    docs = spark.createDataFrame([("d", "ab  cd"), ("e", None), ("f", "  ")], "id string, content string")
    rows = C.chunk_documents(docs, C.windows(F.col("_text"), 2, 0)).select("id", "chunk_index", "n_chunks").collect()
    assert [tuple(r) for r in rows] == [("d_chunk_0", 0, 2), ("d_chunk_2", 2, 2)]


def packed(text, size, separators):
    """The same by adding up costs part by part."""
    if len(text) <= size:
        return [text]
    while separators and separators[0] and separators[0] not in text:
        separators = separators[1:]
    if not separators or not separators[0]:
        return [text[k : k + size] for k in range(0, len(text), size)]
    sep, out, run = separators[0], [], []
    for part in [*text.split(sep), None]:
        over = part is None or sum(len(x) + len(sep) for x in [*run, part]) > size
        if over and run:
            out.append(sep.join(run))
            run = []
        if part is not None:
            if len(part) > size:
                out.extend(packed(part, size, separators[1:]))
            else:
                run.append(part)
    return [x.strip() for x in out if x.strip()]


def test_pieces_against_adding_up():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "bc", " ", " ", ". ", "\n", "\n\n", "ddddd"]) for _ in range(rng.randrange(0, 40)))
        size = rng.randrange(1, 25)
        assert C.pieces(text, size) == (packed(text, size, C.SEPARATORS) if text else [])
