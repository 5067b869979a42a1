"""Problem 1: a made-up book with known furniture, broken and misread words, split in many ways."""

import pickle
import random

import numpy as np
import pytest

from glyphmill.llm import scanned_pages
from glyphmill.llm.lookalikes import read_lexicon
from glyphmill.llm.scanned_pages import Pairs, ends, find_noise, masked, stands_off
from tests.conftest import SF_SMALL

LEXICON = [(w, "en") for w in "the folder ordinary margin calibration confirms border every picture of in within with letter left-hand across inspection reading".split()]
BODY = [
    "The ordinary folder confirms the mar-", "gin of every picture. Marbex and calib", "ration letter with", "in the folder. The borcler of the left-", "hand picture",
    "", "Panost confirms the ordinary", "", "inspec-", "tion across the folder. 1944", "1944", "The upper- and letter", "every vvith folder B19/18 reacling",
]
FOUND = {(0, "broken"), (1, "broken"), (3, "broken"), (3, "misread"), (8, "broken"), (12, "misread")}


def book(volumes=3, pages=8):
    lines, scans, want = [], [], set()
    for v in range(volumes):
        at = 0
        for p in range(pages):
            page = f"v{v}p{p}"
            scans.append((page, 1, v, p))
            rows = [("A Handbook of Margins", 40)] if p else []
            body = BODY[at : at + 5]
            first = len(rows)
            rows += [(t, 165 + 40 * i) for i, t in enumerate(body)]
            rows.append((f"{p + 1}", 2228))
            for i, (text, top) in enumerate(rows):
                lines.append((page, 1, i, 80, top, 20 + 10 * len(text), 29, 1654, 2338, text or (None if i % 2 else "")))
                if i < first or i == len(rows) - 1:
                    want.add((page, i, "furniture"))
            for k in range(len(body)):
                want |= {(page, first + k, kind) for n, kind in FOUND if n == at + k}
            at = (at + 5) if at + 5 < len(BODY) else 0
    return lines, scans, want


@pytest.fixture(scope="module")
def tables(spark):
    lines, scans, want = book()
    books = spark.createDataFrame([(1, "en", "T")], "book_id int, lang string, title string")
    lexicon = spark.createDataFrame(LEXICON, "word string, lang string")
    schema = "page_id string, book_id int, line_id int, box_left int, box_top int, wid int, hei int, img_w int, img_h int, line_str string"
    return spark.createDataFrame(lines + lines[5:9], schema), spark.createDataFrame(scans, "page_id string, book_id int, volume_no long, page_seq int"), books, lexicon, want


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_found_kinds_do_not_depend_on_partitions(spark, tables, partitions):
    text_lines, scans, books, lexicon, want = tables
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = find_noise(text_lines, scans, books, lexicon).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    got = {tuple(r) for r in rows}
    assert len(got) == len(rows)
    # where a volume's pages end amid the text, the next page starts the text again
    assert got == want


def test_empty_tables_and_unknown_pages(spark, tables):
    text_lines, scans, books, lexicon, want = tables
    assert find_noise(text_lines.limit(0), scans, books, lexicon).count() == 0
    alone = find_noise(text_lines, scans.limit(0), books, lexicon).filter("kind = 'furniture'").count()
    assert alone == sum(k == "furniture" for _, _, k in want)
    assert find_noise(text_lines, scans, books.limit(0), lexicon.limit(0)).filter("kind <> 'furniture'").count() == 0


def test_pieces():
    assert ends("a tra -") == ("tra", True, "a") and ends("") == ("", False, "") and ends("left-hand") == ("left-hand", False, "left-hand") and ends("-") == ("", True, "-")
    assert masked("Page 12 / 34") == masked("page xii") == "page"
    pairs = Pairs(LEXICON)
    assert pairs.broken("mar", True, "gin.", "en") and pairs.broken("calib", False, "ration", "en") and pairs.broken("left", True, "hand", "en")
    assert pairs.in_lexicon("left", "hand", "en") and not pairs.in_lexicon("Mar", "bex", "en")
    assert pairs.broken("Calimar", True, "bration", "en") and not pairs.broken("Calimar", False, "bration", "en")
    assert stands_off("a tra -") and not stands_off("tra-") and not stands_off("-")
    assert pickle.loads(pickle.dumps(pairs)).broken("mar", True, "gin.", "en")
    assert not pairs.broken("with", False, "in", "en") and not pairs.in_lexicon("upper", "and", "en") and not pairs.broken("mar.", True, "gin", "en")
    assert not Pairs([*LEXICON, ("upper", "en"), ("and", "en")]).broken("upper", True, "and", "en")


def test_whole_small_tables(spark):
    names = ("text_lines", "scan_pages", "books", "lexicon")
    rows = find_noise(*[spark.read.parquet(f"{SF_SMALL}/{n}.parquet") for n in names]).collect()
    assert len({tuple(r) for r in rows}) == len(rows) and {r.kind for r in rows} == {"furniture", "broken", "misread"}
    assert scanned_pages.REMEMBERED > 0


@pytest.mark.parametrize("partitions", ["1", "9"])
def test_paragraphs_are_whole(spark, tables, partitions):
    text_lines, scans, books, lexicon, _ = tables
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = scanned_pages.paragraphs(text_lines, scans, books, lexicon).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted({r.volume_no for r in rows}) == [0, 1, 2] and len(rows) == 3  # no line is set in: a paragraph for each volume
    for r in rows:
        assert r.text.startswith("The ordinary folder confirms the margin of every picture. Marbex and calibration letter with in the folder. The border of the left-hand picture Panost")
        assert "every with folder B19/18 reading" in r.text and "Handbook" not in r.text and "inspection across the folder. 1944 1944" in r.text


def test_paragraph_starts_and_joins(spark, tables):
    _, scans, books, lexicon, _ = tables
    schema = "page_id string, book_id int, line_id int, box_left int, box_top int, wid int, hei int, img_w int, img_h int, line_str string"
    rows = [("v0p0", 1, i, 80 + (40 if i in (0, 2) else 0), 165 + 40 * i, 300, 29, 1654, 2338, t) for i, t in enumerate(["One", "two", "Three", "four"])]
    got = scanned_pages.paragraphs(spark.createDataFrame(rows, schema), scans, books, lexicon).orderBy("line_id").collect()
    assert [(r.line_id, r.text) for r in got] == [(0, "One two"), (2, "Three four")]
    assert scanned_pages.joined_lines([("Tbe mar-", True, {"tbe": "the"}), ("gin - x", False, {})], {"margin"}) == "The margin - x"
    assert scanned_pages.joined_lines([], set()) == ""


@pytest.mark.parametrize("partitions", ["1", "9"])
def test_long_text_is_cut_at_beginnings_only(spark, tables, partitions):
    _, scans, books, lexicon, _ = tables
    schema = "page_id string, book_id int, line_id int, box_left int, box_top int, wid int, hei int, img_w int, img_h int, line_str string"
    rows = []
    for p in range(75):  # 2250 lines; set in at every 500th, and a word is broken where a count of 2000 would cut
        for i in range(30):
            n = 30 * p + i
            text = "confirms the mar-" if n == 1998 else "gin of the folder" if n == 1999 else "the ordinary folder"
            rows.append((f"long{p:03d}", 1, i, 80 + (40 if n % 500 == 100 else 0), 165 + 40 * i, 300, 29, 1654, 2338, text))
    scans = spark.createDataFrame([(f"long{p:03d}", 1, 0, p) for p in range(75)], "page_id string, book_id int, volume_no long, page_seq int")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = scanned_pages.paragraphs(spark.createDataFrame(rows, schema), scans, books, lexicon).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(30 * int(r.page_id[4:]) + r.line_id for r in got) == [0, 100, 600, 1100, 1600, 2100]
    assert sum("confirms the margin of the folder" in r.text for r in got) == 1 and sorted(r.n_lines for r in got) == [100, 150, 500, 500, 500, 500]


def test_pairs_judge_words_that_their_lexicon_does_not_hold(spark):
    lexicon = read_lexicon(spark.read.parquet(f"{SF_SMALL}/lexicon.parquet"))
    model, other = Pairs(lexicon[::2]), Pairs(lexicon[1::2])
    rng = random.Random(77)
    for lang in ("en", "de", "fr", "ru"):
        lines = other.made_lines(lang, rng, 1200)
        vectors, truth, signed = [], [], []
        for i in range(1, len(lines) - 1):
            last, sign, _ = ends(lines[i][0])
            room = max(n[2] for n in lines[i - 1 : i + 2]) - lines[i][2]
            vectors.append(model.features(last, sign, ends(lines[i + 1][0])[2], lang, stands_off(lines[i][0]), room))
            truth.append(lines[i][1])
            signed.append(sign)
        yes, truth, signed = np.array(model.judge(vectors)), np.array(truth), np.array(signed)
        assert (yes & truth & signed).sum() / (truth & signed).sum() > 0.95
        assert (yes & truth).sum() / truth.sum() > 0.85 and (yes & ~truth).sum() / (~truth).sum() < 0.1


def test_pass_with_many_partitions_is_the_same_on_whole_tables(spark):
    tables = [spark.read.parquet(f"{SF_SMALL}/{n}.parquet") for n in ("text_lines", "scan_pages", "books", "lexicon")]
    got = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            got.append(({tuple(r) for r in find_noise(*tables).collect()}, {(r.page_id, r.line_id, r.text) for r in scanned_pages.paragraphs(*tables).collect()}))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got[0] == got[1]


def test_repaired_words(spark, tables):
    text_lines, scans, books, lexicon, _ = tables
    rows = [("v0p0", 1, 4, 0, "The"), ("v0p0", 1, 4, 1, "borcler"), ("v0p0", 1, 4, 1, "borcler"), ("v0p0", 1, 4, 5, None), ("v0p0", 1, 4, 6, ""), ("nowhere", 1, 0, 0, "vvith")]
    words = spark.createDataFrame(rows, "page_id string, book_id int, line_id int, word_id int, word_str string")
    got = scanned_pages.repaired_words(words, text_lines, scans, books, lexicon).collect()
    assert [(r.page_id, r.word_id, r.repaired) for r in got] == [("v0p0", 1, "border")] or {r.repaired for r in got} <= {"border"}
    assert scanned_pages.repaired_words(words.limit(0), text_lines, scans, books, lexicon).count() == 0
