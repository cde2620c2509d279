import pytest

from helica.llm import encoding as E

TEXT = "La méthode régulière de Müller, « naïve », reste à vérifier: Straße, año, ação — “quoted”."


def misread(text, codec, right="utf-8"):
    chars = E.high_half(codec)
    return "".join(chr(b) if b < 128 else chars[b - 128] for b in text.encode(right, "ignore"))


@pytest.mark.parametrize("codec", [c for c in E.CODECS if c not in ("cp850", "cp1254")] + ["latin-1"])
def test_utf8_read_wrongly_comes_back(codec):
    garbled = misread(TEXT, codec)
    assert garbled != TEXT
    fixed, kinds, n, complete = E.repair(garbled)
    assert complete and fixed == TEXT and kinds == ["multibyte"] and n > 8


def test_garbled_twice_comes_back():
    garbled = TEXT
    for _ in range(6):
        garbled = misread(garbled, "cp1252")
        assert E.repair(garbled)[0] == TEXT and E.repair(garbled)[3]


def test_different_damages_of_one_text():
    lines = ["La densité régulière", "une mesure précise", "la méthode naïve", "Fräulein Grüßer"]
    garbled = "\n".join([misread(lines[0], "cp1252"), lines[1].encode("cp1252").decode("cp1251"), misread(misread(lines[2], "mac_roman"), "cp1252"), misread(lines[3], "cp1252", "mac_roman")])
    fixed, kinds, _, complete = E.repair(garbled)
    assert fixed == "\n".join(lines) and kinds == ["multibyte", "cyrillic", "mac"] and complete


def test_what_stays_garbled_is_not_complete():
    both = misread("méthode", "cp1252") + " et " + misread("Fräulein", "cp1252", "mac_roman")
    fixed, kinds, _, complete = E.repair(both)
    assert fixed.startswith("méthode et ") and kinds == ["multibyte"] and not complete


@pytest.mark.parametrize("text", ["題名は日本語です", "Привет, 世界 мир", "שלום עולם", "😀😃 ok"])
@pytest.mark.parametrize("codec", ["cp1252", "mac_roman"])
def test_other_scripts_come_back_or_are_left_alone(text, codec):
    fixed, kinds, _, complete = E.repair(misread(text, codec))
    assert fixed == text or not complete or not kinds
    assert E.repair(text)[1] == []


def test_garbled_in_one_place():
    text = "Résumé juste, puis une ligne\navec un " + misread("café", "cp1252") + " mal lu."
    assert E.repair(text)[0] == "Résumé juste, puis une ligne\navec un café mal lu."


def test_western_read_as_cyrillic():
    text = "La densité a été mesurée à Ölßen"
    garbled = text.encode("cp1252").decode("cp1251")
    assert E.repair(garbled)[:2] == (text, ["cyrillic"])


def test_mac_read_as_western():
    text = "La densité a été mesurée par Fräulein Grüßer"
    garbled = misread(text, "cp1252", "mac_roman")
    assert E.repair(garbled)[:2] == (text, ["mac"])


def test_lost_characters_are_reported():
    fixed, kinds, n, complete = E.repair("d�pend")
    assert not complete and kinds == ["lost"] and n == 0 and fixed == "d�pend"


@pytest.mark.parametrize(
    "text",
    [
        TEXT, "", "plain", "APLICAÇÃO À REGIÃO, MÉTODOS E PADRÕES", "Лаборатория Ветрова and Ευρύνω.", "├── data\n│   └── readme", "for the operator Ã(x) and 5 °C; © group, √32 ± 1.43 µm", "Sch\\\"on, r\\^ole, \\c{c}a",
        "Её зовут «Ёлка»", "ﾃﾞｰﾀ", "Él dijo “sí”…", "Smith† and Jones‡ wrote § 3", "l’été à l’École", "“É” ‘Ü’", "• item\n• item", "Šovtáös Žukov œuvre",
    ],
)
def test_right_texts_are_left_alone(text):
    assert E.repair(text)[1] == []


def test_table(spark):
    rows = [(1, misread(TEXT, "cp1252"), "x"), (2, TEXT, "x"), (None, misread(TEXT, "mac_roman"), None), (4, None, None), (5, "", None), (2**60 + 1, "x" * 1_000_000 + misread("é", "cp1252") + "t", None), (1, misread(TEXT, "cp1252"), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kinds string")
    got = E.find_garbled(df, "doc_id", "text").collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted([1, 1, None, 2**60 + 1], key=str)
    assert all(r.complete for r in got) and {r.restored for r in got if r.doc_id == 1} == {TEXT}
    assert E.find_garbled(df.limit(0), "doc_id", "text").count() == 0


def test_the_pattern_of_the_scan_misses_nothing(spark):
    texts = [misread(TEXT, c) for c in E.CODECS] + [TEXT.replace("“", "").replace("”", "").replace("—", "").encode("cp1252").decode("cp1251"), misread(TEXT, "cp1252", "mac_roman"), "�"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert {r.doc_id for r in E.find_garbled(df, "doc_id", "text").collect()} == {i for i, t in enumerate(texts) if E.repair(t)[1]}


def test_lines_of_ascii_change_nothing():
    garbled = [misread("Müller était là", "cp1252"), misread("Größe", "mac_roman"), "Fräulein".encode("mac_roman").decode("cp1252"), "juste été", "été".encode("cp1252").decode("cp1251")]
    alone = E.repair("\n".join(garbled))
    lines = [x for g in garbled for x in ("plain text", g, "", "more plain text")]
    fixed, kinds, n, complete = E.repair("\n".join(lines))
    assert [x for x in fixed.split("\n") if not x.isascii()] == [x for x in alone[0].split("\n") if not x.isascii()] and (kinds, n, complete) == alone[1:]
    assert E.repair("only plain\ntext") == ("only plain\ntext", [], 0, False)
