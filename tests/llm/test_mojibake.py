"""Problem 8: damage made here by encoding and decoding again, and texts that only look damaged."""

import pytest

from glyphmill.llm import mojibake
from glyphmill.llm.mojibake import find_damage, restore

GERMAN = "Die Prüfung verkürzt die Lücke, und der Schlüssel schließt das Gehäuse."
FRENCH = "La dépêche répète le contrôle où les colonnes se rejoignent."
RUSSIAN = "Цветная картинка напоминает общий список под настольной лампой."
CHINESE = "扫描页面覆盖了山区的地图。识别结果对应旧的编号。"
ENGLISH = "“so it was read” – the café’s façade costs £12… at 40°"


def damage(text, written, read):
    out = []
    for b in text.encode(written):
        try:
            out.append(bytes([b]).decode(read))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "cp1250", "mac_roman", "cp437", "cp850"])
@pytest.mark.parametrize("text", [GERMAN, FRENCH, ENGLISH])
def test_utf8_read_in_a_western_set_is_restored(text, read):
    assert restore(damage(text, "utf-8", read))[:2] == (True, text)


@pytest.mark.parametrize("text,written,read", [
    (RUSSIAN, "utf-8", "cp1252"), (RUSSIAN, "utf-8", "latin-1"), (RUSSIAN, "utf-8", "cp1251"), (RUSSIAN, "utf-8", "mac_roman"),
    (RUSSIAN, "cp1251", "cp1252"), (RUSSIAN, "cp866", "latin-1"), (RUSSIAN, "utf-8", "cp866"),
    (CHINESE, "utf-8", "cp1252"), (CHINESE, "utf-8", "latin-1"), (CHINESE, "gb18030", "latin-1"),
])
def test_other_scripts_are_restored(text, written, read):
    affected, restored, _ = restore(damage(text, written, read))
    assert affected and restored == text


@pytest.mark.parametrize("written,read", [("koi8-r", "cp1251"), ("cp1251", "koi8-r")])
def test_swapped_cyrillic_sets_are_found(written, read):
    affected, restored, _ = restore(damage(RUSSIAN, written, read))
    assert affected and "картинка" in restored


def test_double_damage_and_parts():
    twice = damage(damage(FRENCH, "utf-8", "cp1252"), "utf-8", "cp1252")
    assert restore(twice)[:2] == (True, FRENCH)
    assert restore("Fine naïve text. " + damage("Änderung", "utf-8", "cp1252") + " ½ fine.")[1] == "Fine naïve text. Änderung ½ fine."


def test_more_kinds_of_damage_than_three():
    lines = [(FRENCH, "cp1252", "cp1252"), (GERMAN, "mac_roman"), (GERMAN, "cp437"), (FRENCH, "cp1250")]
    bad = []
    for text, *reads in lines:
        for read in reads:
            text = damage(text, "utf-8", read)
        bad.append(text)
    bad.append(damage("la contraseña según el catálogo", "cp1252", "cp1251"))  # found only when no other kind is left
    affected, restored, steps = restore("\n".join(bad))
    assert affected and restored == "\n".join([*(line[0] for line in lines), "la contraseña según el catálogo"]) and len(steps) > 3


def test_western_in_cyrillic_and_lost_bytes():
    assert restore(damage("la contraseña según el catálogo", "cp1252", "cp1251"))[:2] == (True, "la contraseña según el catálogo")
    assert restore("costs 64Ђ – note")[1] == "costs 64€ – note"
    affected, _, steps = restore("\ufffd la fiche \ufffd185, le th\ufffd\ufffdtre")
    assert affected and steps == ["bytes lost"]
    assert restore(CHINESE.encode("utf-8").decode("gb18030", "replace"))[0]


@pytest.mark.parametrize("text", [
    GERMAN, FRENCH, RUSSIAN, CHINESE, ENGLISH, "« Â »", "« Â »", "Ð and þ are rare labels", "ÇAĞRI ŞEKLİ", "SÃO MARTIM DO LAGO", "Łódka Źdźbło",
    "Ñandú Ï", "µm ± 3 §4", "├── part\n└── end", "╔═══╗", "▓▒░", "│ a │ b │", "26ö 29° Ærø Ødby", "smörgås naïve crème", "Дунмар’s note – Остлом",
    "DECLARAÇÃO DE VOCÊ", "59½ ×3 10¥", "« В » и «С»…", "ГЛАВА ПЕРВАЯ", "читательaaaaaa", "👩\u200d🏫 📄🔍", "café””", "Maŋrdun Dťunbri", "ÎLE D'HIVER", "Человек час удар раб так",
])
def test_genuine_texts_are_no_cases(text):
    assert restore(text) == (False, text, [])


def test_operator_defined_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "  ", "x"), (4, damage(GERMAN, "utf-8", "cp1252"), "x"), (5, "é" * 50_000, "x")], "doc_id int, text string, affected string")
    rows = {r.doc_id: r for r in find_damage(df).collect()}
    assert [rows[i].affected for i in range(1, 6)] == [False, False, False, True, False]
    assert rows[4].restored == GERMAN and rows[1].restored is None and rows[2].restored == ""
    assert find_damage(df.limit(0)).count() == 0


def test_short_spans_are_judged_by_how_likely_they_are():
    shown = "\u4f60\u597d".encode("utf-8").decode("gbk")  # two ideographs shown as three
    assert mojibake.restore(f"12 {shown} 34")[1] == "12 \u4f60\u597d 34"
    # common ideographs stay, whatever their bytes
    assert mojibake.restore("\u76ee\u5f55 \u7684\u4e00\u662f\u4e0d\u4e86")[0] is False
    one = "\u0437\u0430\u043f\u0438\u0441\u0438".encode("koi8-r").decode("cp1251")  # one word of six letters
    assert mojibake.restore(f"98. {one} 248")[0]
