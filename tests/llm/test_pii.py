import pytest

from siltstone.llm import pii as P

LEARN = [f"My name is {a} {b} and I wrote this. Reporter: {b} about it. Ms {b} will come." for a, b in [("Ada", "Marwick"), ("Bela", "Orlovsky"), ("Cora", "Lindqvist")] * 4]
LEARN += ["Tôi tên là Trần Văn Nam, hiện ở đây.", "Chị Nam đã gọi. Anh Trần Văn Nam để lại số"] * 4


@pytest.fixture(scope="module")
def model():
    m = P.NameModel()
    for t in LEARN:
        m.add(t)
    return m


def found(text, model):
    return [(k, text[a:b]) for k, a, b in P.find(text, model)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Write to a.b+c@mail.example.org.", [("email", "a.b+c@mail.example.org")]),
        ("at x (at) mail (dot) org, or y at host dot org", [("email", "x (at) mail (dot) org"), ("email", "y at host dot org")]),
        ("call (+84) 61-803-2284 or 07700 900 941.", [("phone", "(+84) 61-803-2284"), ("phone", "07700 900 941")]),
        ("number +1-212-555-0188; 0410.355.114", [("phone", "+1-212-555-0188"), ("phone", "0410.355.114")]),
        ("Build 287243392119 used retriever@2.5.1, total 1 234 567 890 units, epoch 1724950966", []),
        ("Passport X1234567 and social security no. 666-12-1234", [("id_number", "X1234567"), ("id_number", "666-12-1234")]),
        ("CCCD 0987.6820.5430 bị dán", [("id_number", "0987.6820.5430")]),
        ("Ship to 554A Fennel Street, Flat 12, Quessin, not there", [("address", "554A Fennel Street, Flat 12, Quessin")]),
        ("ở 84/7 ngõ 59 phố Ngô Thụ, quận Tây Lĩnh, TP. Tân Lộc.", [("address", "84/7 ngõ 59 phố Ngô Thụ, quận Tây Lĩnh, TP. Tân Lộc")]),
        ("passer au 44 bis rue de la Paix, 75002 Paris.", [("address", "44 bis rue de la Paix, 75002 Paris")]),
        ("geht an Birkenauer Straße 60, 91313 Erlangen.", [("address", "Birkenauer Straße 60, 91313 Erlangen")]),
        ("We met Dr. Marwick and Ms Orlovsky.", [("name", "Marwick"), ("name", "Orlovsky")]),
        ("Later Cora Lindqvist and LINDQVIST, Cora left", [("name", "Cora Lindqvist"), ("name", "LINDQVIST, Cora")]),
        ("hello, this is ada marwick again", [("name", "ada marwick")]),
        ('{"customer": "Bela Orlovsky", "n": 1}', [("name", "Bela Orlovsky")]),
        ("em là tran van nam ở đây; Chị Nam đã", [("name", "tran van nam"), ("name", "Nam")]),
        ("+８４６６７４４０７０３", [("phone", "+８４６６７４４０７０３")]),
        ("The Quarterly Report and Project Vesper closed.", []),
        ("", []),
    ],
)
def test_find(text, want, model):
    assert found(text, model) == want


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "src_table string, record_id string, text string, pii_type string")


def test_table_masks_and_surrogates(spark, model):
    rows = [("t", "1", "Ms Marwick, tel +84 416 626 533."), ("t", "1", "Ms Marwick, tel +84 416 626 533."), ("t", "2", None), ("t", "3", ""), ("t", "4", "Ada Marwick or MARWICK, Ada; mail me@x.org")]
    df = table(spark, rows)
    hits = P.personal_information(df, model)
    assert hits.count() == 2 + 3
    texts = df.drop("pii_type").distinct()
    masked = {r["record_id"]: r["text"] for r in P.replaced(texts, hits).collect()}
    assert masked == {"1": "Ms [NAME], tel [PHONE].", "2": None, "3": "", "4": "[NAME] or [NAME]; mail [EMAIL]"}
    made = P.surrogates(hits, "k")
    again = {(r["piece"], r["surrogate"]) for r in P.surrogates(hits, "k").collect()}
    by = {r["piece"]: r for r in made.collect()}
    assert again == {(p, r["surrogate"]) for p, r in by.items()} and all(r["surrogate"] != p for p, r in by.items())
    assert by["+84 416 626 533"]["surrogate"].startswith("+84 ") and len(by["+84 416 626 533"]["surrogate"]) == len("+84 416 626 533")
    first, last = by["Ada Marwick"]["surrogate"].split()
    assert by["MARWICK, Ada"]["surrogate"] == f"{last.upper()}, {first}" and by["Marwick"]["surrogate"] == last
    assert by["Ada Marwick"]["entity"] == by["MARWICK, Ada"]["entity"]
    assert first.endswith("a")
    assert P.personal_information(df.limit(0)).count() == 0


def test_surrogates_stay_distinct(spark):
    rows = [("t", str(i), "phone", 0, 1, f"0{i:03d}") for i in range(400)]  # three digits: many draws collide
    hits = spark.createDataFrame(rows, "src_table string, record_id string, pii_type string, start_pos int, end_pos int, piece string")
    got = P.surrogates(hits, "k").collect()
    assert len({r["surrogate"] for r in got}) == len(got) == 400


def test_keys_differ():
    assert P.surrogate("Ada Marwick", "name", "k1") != P.surrogate("Ada Marwick", "name", "k2")
    assert P.surrogate("QQ 12 34 56 C", "id_number", "k").count(" ") == 4


def test_script_gender_and_format():
    for piece in ("Иван Петров", "René Müller", "王伟", "Ελένη Παπά", "Trần Văn Nam", "O'Brien"):
        made = P.surrogate(piece, "name", "k")
        assert made != piece and len(made.split()) == len(piece.split())
        assert [P.script(w) for w in made.split()] == [P.script(w) for w in piece.split()]
        assert [w[0].isupper() for w in made.split()] == [w[0].isupper() for w in piece.split()]
    assert P.is_vietnamese(P.surrogate("Trần Thị Hoa", "name", "k")) and P.surrogate("Trần Thị Hoa", "name", "k").split()[1] == "Thị"
    assert not P.surrogate("René", "name", "k").isascii() and not P.is_vietnamese(P.surrogate("René Müller", "name", "k"))
    assert P.surrogate_word("robin", "k", sex="f").endswith("a") and not P.surrogate_word("robin", "k", sex="m").endswith("a")
    assert P.gender("Frau Müller kam", 5) == "f" and P.gender("Mr. Brook", 4) == "m" and P.gender("Dr. Brook", 4) is None
    shape = lambda t: "".join("0" if c.isdigit() else "a" if c.isalpha() else c for c in t)
    for piece, kind in (("+84 912 345 678", "phone"), ("(030) 123-4567", "phone"), ("QQ 12 34 56 C", "id_number"), ("666-12-1234", "id_number")):
        made = P.surrogate(piece, kind, "k")
        assert made != piece and shape(made) == shape(piece)
    mail = P.surrogate("a.b7 (at) mail (dot) org", "email", "k")
    assert mail.count("(at)") == 1 and mail.endswith("(dot) example") and P._EMAIL.fullmatch(mail)
    home = P.surrogate("554A Fennel Street, Flat 12, Quessin", "address", "k")
    assert "Street, Flat" in home and "Fennel" not in home and "Quessin" not in home and shape(home)[:4] == "000a"


def test_mentions_of_one_entity_agree():
    for a, b in (("+84 912 345 678", "0912 345 678"), ("+84 912 345 678", "0084-912-345-678"), ("(+49) 30 1234567", "030 1234567")):
        assert P.entity(a, "phone") == P.entity(b, "phone")
        one, two = (P.surrogate(x, "phone", "k") for x in (a, b))
        assert P.entity(one, "phone") == P.entity(two, "phone") and one[:3] == a[:3] and two[:1] == b[:1]
    assert P.entity("a@x.org", "email") == P.entity("A (at) x (dot) org", "email")
    assert P.surrogate("nguyen", "name", "k") == P.folded(P.surrogate("nguyen", "name", "k"))


def test_one_word_in_two_spellings(spark):
    rows = [("t", "1", "name", 0, 1, "Nguyễn Văn An", None), ("t", "2", "name", 0, 1, "Nguyen", None), ("t", "3", "name", 0, 1, "NGUYỄN", "f")]
    hits = spark.createDataFrame(rows, "src_table string, record_id string, pii_type string, start_pos int, end_pos int, piece string, gender string")
    by = {r["piece"]: r["surrogate"] for r in P.surrogates(hits, "k").collect()}
    family = by["Nguyễn Văn An"].split()[0]
    assert by["NGUYỄN"] == family.upper() and by["Nguyen"].lower() == P.folded(family) and by["Nguyễn Văn An"].split()[1] == "Văn"


def test_names_in_other_scripts(model):
    assert found("We met Dr. Петров and Mr 王伟 there.", model) == [("name", "Петров"), ("name", "王伟")]


def test_two_texts_under_one_id(spark, model):
    rows = spark.createDataFrame([("t", "1", "Mail a@b.org now"), ("t", "1", "Call +84 416 626 533, mail c@d.org")], "src_table string, record_id string, text string")
    got = {r["text"] for r in P.replaced(rows, P.personal_information(rows, model)).collect()}
    assert got == {"Mail [EMAIL] now", "Call [PHONE], mail [EMAIL]"}


def test_digits_are_shuffled_one_to_one():
    for n in (1, 2, 3, 5):
        made = {P.shuffled_digits(str(i).zfill(n), "k", "x") for i in range(10**min(n, 4))}
        assert len(made) == 10 ** min(n, 4)


def test_triggers_never_hide_a_match():
    texts = LEARN + ["Ship to 1 Elm St, Quessin", "sozialversicherungsnummer 12 345678 A 901", "Best regards,\nAda Marwick", "Ada Marwick asked for it", "x [at] host [dot] org"]
    every = P._triggers()
    for text in texts:
        kinds = every(text.lower())
        for kind, pattern in (("email", P._EMAIL), ("id", P._ID_START), ("intro", P._INTRO), ("closing", P._CLOSING), ("before", P._BEFORE), *((f"address{k}", p) for k, p in enumerate(P._ADDRESSES))):
            assert kind in kinds or not pattern.search(text)
    for words, pattern in ((P.ID_WORDS, P._ID_START),):
        for w in ("CCCD", "ID card", "id-card", "id_number", "ID number", "idnumber", "identity no", "insurance reference", "steuer-id", "carte d’identité", "NIK"):
            assert "id" in every(w.lower()) and pattern.search(w)
