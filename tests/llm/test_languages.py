import pytest
from pyspark.sql import functions as F

from siltstone.llm import languages as L

TEXT = {
    "en": "The operator reads the log before the report leaves the house. We keep two copies of every file in the store. Nobody has asked for the old list since June.",
    "vi": "Người trực đọc nhật ký trước khi báo cáo rời khỏi nhà. Chúng tôi giữ hai bản sao của mỗi tệp trong kho. Không ai hỏi danh sách cũ từ tháng sáu.",
    "fr": "L'opérateur lit le journal avant que le rapport quitte la maison. Nous gardons deux copies de chaque fichier dans la réserve. Personne n'a demandé la vieille liste depuis juin.",
    "de": "Der Bediener liest das Protokoll, bevor der Bericht das Haus verlässt. Wir halten zwei Kopien jeder Datei im Speicher. Niemand hat seit Juni nach der alten Liste gefragt.",
    "es": "El operador lee el registro antes de que el informe salga de la casa. Guardamos dos copias de cada archivo en el almacén. Nadie ha pedido la lista vieja desde junio.",
    "id": "Petugas membaca catatan sebelum laporan meninggalkan rumah. Kami menyimpan dua salinan dari setiap berkas di gudang. Tidak ada yang meminta daftar lama sejak bulan Juni.",
}
PLAIN_VI = "Nguoi truc doc nhat ky truoc khi bao cao roi khoi nha. Chung toi giu hai ban sao cua moi tep trong kho."


@pytest.fixture(scope="module")
def model(spark):
    rows = [(t, c) for c, t in TEXT.items()] * 3 + [(PLAIN_VI, "vi_VN")] * 2 + [(TEXT["en"], "de")]
    return L.fit(spark.createDataFrame(rows, "text string, lang string"))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", "k", "clash", 1.0) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string, space_key string, language string, confidence double")


def test_labels(spark):
    cases = {"en": "en", " English ": "en", "en-US": "en", "vi_VN": "vi", "VIE": "vi", "Deutsch": "de", "fra": "fr", "??": None, "": None, None: None, "und": None, "xx": None, "pt": "other", "pt-BR": "other", "ind": "id"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "l string, want string")
    assert all(r["got"] == r["want"] for r in df.select(L.label_code(F.col("l")).alias("got"), "want").collect())


def test_issues(spark, model):
    first = lambda c, n=2: ". ".join(TEXT[c].split(". ")[:n]) + "."
    rows = [
        (TEXT["en"], "English"), (TEXT["en"], "vi"), (TEXT["fr"], None), (PLAIN_VI, "en"), (first("en") + " " + first("de"), "en"), (first("en", 3) + " " + first("de", 1), "eng"),
        (None, None), ("", "en"), (" \n", None), ("```\nTEXT CODE\n```", None), (TEXT["en"] + "\n```\nDer Bediener liest das Protokoll. Wir halten zwei Kopien.\n```", "en"), ("https://x.example/Der/Bediener", None),
    ]
    got = {(r["doc_id"], r["issue"], r["lang_code"]) for r in L.label_issues(L.languages(docs(spark, rows), model=model)).collect()}
    assert got == {(1, "wrong", "en"), (2, "missing", "fr"), (3, "wrong", "vi"), (4, "mixed", "en"), (4, "mixed", "de")}


def test_held_out_sentences(spark, model):
    texts = ["She bought three apples and went home before it rained.", "Ella compró tres manzanas y volvió a casa antes de que lloviera.", "Sie kaufte drei Äpfel und ging nach Hause, bevor es regnete.", "Elle a acheté trois pommes et est rentrée avant la pluie.", "Cô ấy mua ba quả táo và về nhà trước khi trời mưa.", "Dia membeli tiga apel dan pulang sebelum hujan turun."]
    best = model.scores([L.letters(t) for t in texts]).argmax(1)
    assert sum(L.LANGUAGES[k] == c for k, c in zip(best, ("en", "es", "de", "fr", "vi", "id"), strict=True)) >= 5


def test_segments_and_empty(spark, model):
    text = TEXT["en"] + "\n" + TEXT["vi"]
    rows = L.segments(docs(spark, [(text, None), (None, None)]), model=model).orderBy("segment").collect()
    assert [r["language"] for r in rows] == ["en", "vi"] and text[rows[1]["start_pos"] : rows[1]["end_pos"]].startswith("Người")
    assert L.languages(docs(spark, [(text, "en")]).limit(0), model=model).count() == 0


def test_long_text_in_groups(model):
    pieces = ["a" * 400_000, "b c d " * 10]
    assert list(L.groups(pieces)) == [slice(0, 1), slice(1, 2)] and model.scores(pieces).shape == (2, 6)


def test_markup_tells_where_the_text_does_not(spark, model):
    marked = '<p lang="{}">xkcd 77</p>'
    rows = [(f'<html xml:lang="{c}"><p>{t}</p>', None) for c, t in TEXT.items() for _ in range(40)] + [(marked.format("de-AT"), None), (marked.format("fr"), None), ("<p>xkcd 77</p>", None)]
    got = {r["doc_id"]: r for r in L.languages(docs(spark, rows), model=model).collect()}
    n = 40 * len(TEXT)
    assert got[n]["language"] == "de" and got[n + 1]["language"] == "fr" and got[n]["confidence"] > got[n + 2]["confidence"]
    codes = spark.createDataFrame([(t,) for t in (marked.format("en_US"), "lang=de", "<a hreflang='fr'>x</a>", None, "<div class=x XML:LANG='pt'>")], "t string").select(L.markup_language(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in codes] == ["en", None, None, None, "other"]


def test_a_text_in_none_of_the_languages_is_other(spark):
    import random

    words = {c: t.replace(".", "").replace(",", "").split() for c, t in TEXT.items()}
    rng = random.Random(1)
    rows = [(" ".join(rng.choice(words[c]) for _ in range(12)) + ".", c) for c in TEXT for _ in range(120)]
    model = L.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.floor > float("-inf") and 0 < model.sharpness <= 1
    other = "Ügyfeleink többsége gyorsabban válaszol, ha rövid kérdést teszünk föl nekik. Holnap újra próbáljuk."
    got = [r["language"] for r in L.languages(docs(spark, [(other, None), (" ".join(words["es"]) + ".", None)]), model=model).orderBy("doc_id").collect()]
    assert got == ["other", "es"]
    assert L.label_issues(L.languages(docs(spark, [(other, None)]), model=model)).count() == 0


def test_sentences_of_a_mixed_text_follow_the_host_loosely(spark, model):
    text = TEXT["en"] + "\n" + TEXT["vi"]
    rows = [(TEXT["en"], "en")] * 40 + [(text, "en")]
    got = [r for r in L.languages(docs(spark, rows), model=model).collect() if r["doc_id"] == 40][0]
    assert set(got["present"]) == {"en", "vi"}
