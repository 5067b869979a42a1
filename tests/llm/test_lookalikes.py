"""Problem 2: hand-made spellings, and noise put on clean words and taken off again."""

import random
import unicodedata

import pytest

from glyphmill.llm import lookalikes, queries
from glyphmill.llm.lookalikes import Consistent, changed_chars, changed_words, char_pieces
from tests.conftest import SF_SMALL

LEXICON = [(w, "en") for w in "the folder ordinary word-box a of page margin complete letter".split()]
LEXICON += [(w, "ru") for w in "список общий с в строка нижнюю ухо а хор".split()] + [(w, "de") for w in "Änderung Größe erläutert Prüfung".split()] + [("的", "zh")]
C = Consistent(LEXICON)

CASES = [
    ("ｆolԁe\u200er.", "en", "folder."), ("ԝord-box", "en", "word-box"), ("а", "en", "a"), ("рage", "en", "page"), ("Зансав", "en", "Зансав"),
    ("Zаnbrі", "en", "Zanbri"), ("Maŋrdun", "en", "Maŋrdun"), ("cтрoкa", "ru", "строка"), ("C", "ru", "С"), ("A87/6", "ru", "A87/6"), ("А87/6", "ru", "A87/6"),
    ("Beксав", "ru", "Вексав"), ("Änderung", "de", "Änderung"), ("Ändеrung", "de", "Änderung"), ("\u3000lamp ", "en", " lamp "), ("2 098", "en", "2 098"),
    ("Ω158", "en", "Ω158"), ("Ω158", "en", "Ω158"), ("Ⅻ-3", "zh", "XII-3"), ("\u2faf", "zh", "面"), ("。、", "zh", "。、"), ("，", "en", ","), ("two‐column", "en", "two‐column".replace("‐", "-")),
    ("\u2126158", "en", "\u03a9158"), ("\u212a5", "en", "K5"), ("draw—", "en", "draw—"), ("draw¬", "en", "draw¬"), ("ß301", "ru", "ß301"), ("numbet", "en", "numbet"), ("0коло", "ru", "0коло"), ("", "en", ""), ("\u200b", "en", ""),
    ("ﬃce", "en", "ffice"), ("l4", "ru", "l4"), ("xvii", "ru", "xvii"), ("Größe", None, "Größe"),
]


@pytest.mark.parametrize("word,lang,form", CASES)
def test_forms(word, lang, form):
    assert C.form(word, lang) == form
    assert C.form(form, lang) == form


def test_noise_is_taken_off():
    rng = random.Random(4)
    twins = {a: b for _, latin, other in lookalikes._PAIRS[:1] for a, b in zip(latin, other)}
    for word, lang in LEXICON:
        if lang not in ("en", "de"):
            continue
        for _ in range(20):
            noisy = unicodedata.normalize("NFD", word) if rng.random() < 0.5 else word
            noisy = "".join(twins.get(c, c) if rng.random() < 0.5 else chr(ord(c) + 0xFEE0) if "!" <= c <= "~" and rng.random() < 0.3 else c for c in noisy)
            noisy = "".join(c + (rng.choice("\u200b\u00ad\u2060\ufe0f") if rng.random() < 0.2 else "") for c in noisy)
            assert C.form(noisy, lang) == word


def test_char_pieces():
    assert char_pieces("e\u0301\ufb01\u034f") == [(0, 2), (2, 3), (3, 4)] and char_pieces("l\ufe00") == [(0, 1), (1, 2)] and char_pieces("") == []


def test_operator_cases(spark):
    books = spark.createDataFrame([(1, "en"), (2, "ru"), (3, None)], "book_id int, lang string")
    lexicon = spark.createDataFrame(LEXICON, "word string, lang string")
    rows = [("p", 1, 0, 0, "pаge"), ("p", 1, 0, 0, "pаge"), ("p", 1, 0, 1, None), ("p", 1, 0, 2, ""), ("p", 1, 0, 3, "plain"), ("q", 2, 0, 0, "cписок"), ("r", 9, 0, 0, "a"), ("r", 3, 0, 1, "x" * 30_000 + "\u200b")]
    words = spark.createDataFrame([(*r, "extra") for r in rows], "page_id string, book_id int, line_id int, word_id int, word_str string, lang string")
    changed = changed_words(words, books, lexicon)
    assert sorted((r.page_id, r.word_id, r.form[:6]) for r in changed.collect()) == [("p", 0, "page"), ("q", 0, "список"), ("r", 1, "xxxxxx")]
    spelled = [("p", 0, 0, i, c) for i, c in enumerate("pаge")] + [("p", 0, 0, 1, "а"), ("q", 0, 0, 0, None), ("q", 0, 0, 1, "п"), ("q", 0, 0, 99, "z")]
    chars = spark.createDataFrame(spelled, "page_id string, line_id int, word_id int, char_id int, char_str string")
    assert sorted(map(tuple, changed_chars(changed, chars).collect())) == [("p", 0, 0, 1), ("q", 0, 0, 99)]
    assert changed_words(words.limit(0), books, lexicon).count() == 0
    with pytest.raises(ValueError):
        old, lookalikes.MAX_LEXICON_WORDS = lookalikes.MAX_LEXICON_WORDS, 3
        try:
            lookalikes.read_lexicon(lexicon)
        finally:
            lookalikes.MAX_LEXICON_WORDS = old


def test_p2_query_on_whole_small_tables(spark):
    rows = queries.p2_found(spark, SF_SMALL).collect()
    assert len(rows) == len(set(map(tuple, rows))) > 0
    words = spark.read.parquet(f"{SF_SMALL}/words.parquet").toPandas()
    chars = spark.read.parquet(f"{SF_SMALL}/chars.parquet").dropDuplicates(["page_id", "line_id", "word_id", "char_id"]).toPandas()
    books = {r.book_id: r.lang for r in spark.read.parquet(f"{SF_SMALL}/books.parquet").collect()}
    consistent = Consistent(lookalikes.read_lexicon(spark.read.parquet(f"{SF_SMALL}/lexicon.parquet")))
    want = set()
    spelled = {k: g.sort_values("char_id") for k, g in chars.groupby(["page_id", "line_id", "word_id"])}
    for r in words.itertuples():
        points = consistent.points(r.word_str, books.get(r.book_id))
        if "".join(points) != r.word_str:
            key = (r.page_id, r.line_id, r.word_id)
            want.add((*key, -1))
            pieces = char_pieces(r.word_str)
            for c in spelled[key].itertuples():
                if isinstance(c.char_str, str) and c.char_str != "".join(points[slice(*pieces[c.char_id])]):
                    want.add((*key, c.char_id))
    assert set(map(tuple, rows)) == want


def test_fit_on_held_out_words(spark):
    lexicon = lookalikes.read_lexicon(spark.read.parquet(f"{SF_SMALL}/lexicon.parquet"))
    fitted = Consistent(lexicon[::2])
    rows = fitted.examples(lexicon[1::2], random.Random(5))
    right = sum(fitted.form(seen, lang) == word for seen, lang, word in rows)
    assert len(rows) > 500 and right / len(rows) > 0.9
    assert fitted.page_script("ru") == "Cyrillic" and fitted.page_script(None) == "Latin"


def test_lattice_holds_every_reading_and_the_script_comes_from_the_lexicon():
    assert lookalikes.readings("ӏ")["Latin"] == ["l", "I"] and lookalikes.readings("o")["Greek"] == ["ο"]
    greek = Consistent([(w, "el") for w in "ο νόμος και η τιμή".split()] + LEXICON)
    assert greek.page_script("el") == "Greek" and greek.form("νόμoς", "el") == "νόμος"
    assert C.form("Ulmgоr", "en") == "Ulmgor" and C.form("Uӏmgоr", "en") == "Ulmgor"
