"""Pixel measures against plain loops, step-by-step grouping, and remaining decoding helpers."""

import os
import math

import numpy as np
import pytest

from glyphmill.functions import frames, geometry
from glyphmill.operators import decode, generate, images, joins, repair, result_json, segment
from glyphmill.sources import result_files
from pyspark.sql import functions as F


def plain_components(mask):
    seen, out = np.zeros_like(mask), []
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        todo, cells = [(y, x)], []
        seen[y, x] = True
        while todo:
            a, b = todo.pop()
            cells.append((a, b))
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    p, q = a + i, b + j
                    if 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and mask[p, q] and not seen[p, q]:
                        seen[p, q] = True
                        todo.append((p, q))
        ys, xs = zip(*cells)
        out.append((min(xs), min(ys), max(xs), max(ys), len(cells)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(12))
def test_components_equal_flood_fill(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((rng.integers(1, 14), rng.integers(1, 14))) < rng.choice([0.2, 0.4, 0.6])
    assert [tuple(map(int, c)) for c in images.components(mask)] == [tuple(map(int, c)) for c in plain_components(mask)]


def test_pixel_measures():
    rng = np.random.default_rng(1)
    grey = rng.integers(0, 256, (20, 30)).astype(np.uint8)
    got = images.niblack(grey, 5, 0.43)
    for y, x in ((0, 0), (10, 15), (19, 29)):
        part = grey[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].astype(float)
        assert got[y, x] == (grey[y, x] < part.mean() - 0.43 * part.std())
    two = np.full((6, 12), 200, np.uint8)
    two[:, :5] = two[:, 7:] = 10
    assert images.otsu(two) in range(10, 200) and images.two_colours(two) == (10.0, 200.0) and images.cut_column(two < 100) in (5, 6)
    assert images.projection(two < 100).tolist() == [6] * 5 + [0, 0] + [6] * 5
    assert images.stroke_width(np.zeros((3, 3), bool)) == 0.0 and images.stroke_width(np.ones((1, 5), bool)) == 2.0
    assert images.components(np.zeros((2, 2), bool)) == []


def test_measure_keeps_rows(spark):
    df = spark.createDataFrame([(1, 2, 2, bytearray([0, 0, 255, 255])), (2, 2, 2, bytearray([1])), (3, None, 2, None), (4, 1, 1, bytearray([7]))], "i int, height int, width int, pixels binary")
    got = {r.i: r for r in images.measure(df).collect()}
    assert got[1].n_components == 1 and got[1].projection == [1, 1] and got[2].n_components is None and got[3].dark is None and got[4].n_components == 0
    assert images.measure(df.limit(0)).count() == 0


def box(left, top, wid, hei, no=0):
    return {"page_id": "p", "line_id": 0, "word_id": no, "box_left": left, "box_top": top, "wid": wid, "hei": hei}


def test_adaptive_groups():
    even = [box(20 * i, 0, 18, 20, i) for i in range(5)]
    assert segment.adaptive_groups(even) == [(0, 4)]
    far = [*even, box(300, 0, 60, 20, 5), box(362, 0, 60, 20, 6)]
    assert segment.adaptive_groups(far) == [(0, 4), (4, 6)]
    assert segment.adaptive_groups([]) == [] and segment.adaptive_groups(even[:1]) == [(0, 0)]
    assert segment.adaptive_groups([box(500 * i, 100 * i, 100, 10, i) for i in range(4)]) == [(i, i) for i in range(4)]


def test_component_rows():
    two_rows = [box(30 * i, 5 * (i % 2), 20, 20) for i in range(5)] + [box(30 * i, 60, 20, 20) for i in range(5)] + [box(200, 100, 2, 2)]
    rows = segment.component_rows(two_rows)
    assert [(r[1], r[3]) for r in rows] == [(0, 25), (60, 80)]
    assert segment.component_rows([]) == []


def test_picture_regions_avoid_text():
    shapes = [[0, 0, 10, 10], [20, 0, 30, 10], [0, 50, 10, 60], [0, 0, 1, 1]]
    assert segment.picture_regions(shapes, [[0, 20, 100, 30]]) == [[0, 0, 30, 10], [0, 50, 10, 60]]
    assert segment.picture_regions(shapes, [[0, 0, 100, 100]]) == []


def test_decoding_helpers():
    assert decode.words_of_frames([0, 9, 0, 4, 4, 1, 1, 9, 2], 9, 4) == [(0, 2, [0, 0]), (5, 8, [1, 2])]
    assert decode.spread("ab", "_aab_") == [(1.0, 2.0), (3.0, 4.0)]
    assert decode.spread("axb", "a_b")[0][0] == 0.0 and decode.spread("", "a") == []
    m = [[0.9, 0.1], [0.2, 0.8]]
    assert decode.attention_score(m, [0, 1], [0, 1]) == pytest.approx(math.log(0.9) + math.log(0.8))
    assert decode.attention_score(m, [0, 1], [0]) == pytest.approx(math.log(0.9))
    assert decode.attention_score(m, [0, 1], [1, 0]) == pytest.approx(math.log(0.1) + math.log(0.2) + math.log(0.1))


def test_frame_functions(spark):
    row = spark.range(1).select(
        frames.span_from_peak(F.array(*[F.lit(x) for x in (0.0, 0.9, 0.5, 0.0, 0.7)]), 0.1).alias("s"),
        frames.first_of_beams(F.array(*[F.lit(i) for i in range(6)]), 3).alias("b"),
        frames.likeliest_case(*[F.array(F.lit(x), F.lit(0.5)) for x in (0.1, 0.9, 0.9)]).alias("k"),
        geometry.small_area(F.lit(2), F.lit(50), F.lit(100), F.lit(100)).alias("a"),
    ).first()
    assert (row.s.first, row.s.last) == (1, 2) and row.b == [0, 3] and row.k == 1 and row.a


def test_nearest_points_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-50, 150, (80, 2)))]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 100, (60, 2)))]
    got = joins.nearest_points(spark.createDataFrame(rows, "id int, x double, y double"), spark.createDataFrame(points, "point_id int, px double, py double"), 40.0).collect()
    for r in got:
        d, p = min((math.hypot(r.x - a, r.y - b), i) for i, a, b in points)
        assert (r.point_id, round(r.distance, 9)) == (p, round(d, 9)) if d <= 40 else r.point_id is None
    assert len(got) == 80


def test_answers_and_config():
    assert result_json.answer_for("Locate", "x") == "boxes" and result_json.answer_for("", "st_ocrapi_all") == "characters" and result_json.answer_for("Recognize", "", True) == "pdf"
    with pytest.raises(ValueError):
        result_json.answer_for("Other", "")
    registry = {"A": ("int", 0, 5, 1), "B": ("double", 0, 1, 0.5), "C": ("int", 0, 5, 2), "D": ("int", 0, 5, 3)}
    assert result_files.typed_config({"A": "4", "B": "7", "C": "x"}, registry) == {"A": 4, "B": 0.5, "C": 2, "D": 3}


def test_background_bands_and_plan(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.99,), (1.0,)], "t double")
    assert [r[0] for r in df.select(generate.background(F.col("t"), [("a", 0.25), ("b", 0.25), ("c", 0.5)])).collect()] == ["a", "b", "c", "c"]
    plans = generate.augmentation_plan(spark.range(200), "id", ["x", "y", "z"], 1).collect()
    assert {tuple(sorted(r.steps)) for r in plans} == {("x", "y", "z")} and len({tuple(r.steps) for r in plans}) == 6


def test_crossing_lines():
    ls = [dict(box(0, 0, 100, 20), is_black_wd=1), dict(box(95, 2, 100, 20), is_black_wd=1), dict(box(0, 100, 50, 20), is_black_wd=1), dict(box(90, 0, 50, 20), is_black_wd=0)]
    assert repair.crossing_lines(ls) == [[0, 1], [2], [3]] and repair.crossing_lines([]) == []


def test_merging_and_splitting():
    w = lambda t, x, n=8: dict(box(x, 0, n, 10), word_str=t)
    texts = lambda ws: [x["word_str"] for x in ws]
    assert texts(repair.merge_special([w("it", 0), w("s", 10), w("a", 20), w("s", 30)], 4)) == ["it's", "a", "s"]
    assert texts(repair.merge_special([w("w", 0), w("w", 10), w("w", 20), w("abc", 30), w("far", 90)], 4)) == ["wwwabc", "far"]
    assert texts(repair.merge_known([w("fol", 0), w("der", 10), w("the", 20), w("n", 60)], {"folder", "the", "then"}, 5)) == ["folder", "the", "n"]
    assert [t for t, _ in repair.split_european("Größe-x 16мб,12абвг")] == ["Größe-x", " ", "16мб", ",", "12", "абвг"]


def test_second_readings_and_char_boxes():
    m = [0.0, 0.0, 0.6, 0.3, 0.1, 0.0, 0.35, 0.5, 0.15, 0.0]
    got = repair.second_readings([0, 0], m, 5, -1.0)
    assert [p for p, _ in got] == [[1, 0], [0]] and got[0][1] == pytest.approx(-1.0 + math.log(0.5)) and got[1][1] == pytest.approx(-1.0 + math.log(0.7))
    assert repair.second_readings([0], [0.0, 0.0, 0.9, 0.1], 4, 0.0) == []
    assert repair.second_readings([0], [0.0, 0.4, 0.6, 0.0], 4, 0.0) == [([], pytest.approx(math.log(0.4) - math.log(0.6)))]
    boxes = repair.char_boxes_by_frames({"box_left": 0, "wid": 100, "frames": 10, "spans": [0, 3, 6]})
    assert [(b["box_left"], b["wid"]) for b in boxes] == [(0, 30), (30, 30), (60, 30)] and repair.char_boxes_by_frames({"box_left": 0, "wid": 1, "frames": 1, "spans": []}) == []


def test_row_noise_and_sub_words():
    row = [box(0, 0, 10, 20), box(2, -6, 3, 3), box(30, 0, 10, 20), box(60, 5, 2, 2)]
    assert [(r["box_left"], r["box_top"], r["hei"]) for r in repair.row_noise_removed(row)] == [(0, -6, 26), (30, 0, 20)]
    assert repair.row_noise_removed([]) == []
    assert repair.split_at_punctuation([1, 9, 2, 3], [(0, 1), (2, 2), (3, 4), (5, 6)], {9}) == [([1], 0, 1), ([9], 2, 2), ([2, 3], 3, 6)]
    assert repair.split_at_punctuation([9, 9], [(0, 0), (1, 1)], {9}) == [([9, 9], 0, 1)] and repair.split_at_punctuation([1, 8], [(0, 0), (1, 1)], {9}, {8}) == []


def test_label_streams_and_alternates():
    assert repair.read_label_stream([2, 3, 1, 7, -1, 5, -1]) == [[0, 1], [3]] and repair.read_label_stream([]) == [[]]
    assert repair.legacy_check_scores("dont.", [("dont", 0)]) == [("dont.", 1.0)]
    assert repair.legacy_check_scores("do'nt", [("dont", 1)]) == [("do'nt", pytest.approx(1 - 1 / 9))]
    words = [{"word_str": "a bc", "char_probs": [0.9, 0.3, 0.9]}]
    alternates = [{"word_str": "abc", "log_prob": -1.0}, {"word_str": "ac", "log_prob": -2.0}, {"word_str": "ab", "log_prob": -2.0}, {"word_str": "abc", "log_prob": -9.0}]
    assert repair.alternative_readings(words, alternates)[0]["alternates"] == [("abc", -1.0), ("ac", -2.0)]


def test_whole_rows(spark):
    df = spark.createDataFrame([box(500 * i, 100 * i, 100, 10, i) for i in range(3)])
    assert [(r.first_word, r.last_word) for r in segment.word_groups(df, whole=True).collect()] == [(0, 2)]
    assert segment.word_groups(df).count() == 3


def test_generator_settings_lists_and_windows(spark, tmp_path):
    import json

    from glyphmill.sources import result_files

    good = {"backgrand": {"no_backgrand": {"probility": 0.5}, "fusion": {"probility": 0.2, "list": "f.txt", "a": 1, "b": 2, "c": 3}}, "rotation": 5, "shift": 2, "resize_rate": 0.9}
    os.makedirs(tmp_path / "s")
    for name, text in {"a.json": json.dumps(good), "b.json": "{", "c.json": "{}", "d.json": '{"backgrand": []}'}.items():
        (tmp_path / "s" / name).write_text(text)
    rows = {r.file[-6:]: r for r in result_files.generator_settings(spark, str(tmp_path / "s")).collect()}
    assert rows["a.json"].fault is None and rows["a.json"].settings.backgrand.fusion.c == 3.0 and rows["a.json"].settings.shift == 2 and rows["a.json"].settings.pepper_noise is None
    assert [rows[n].fault for n in ("b.json", "c.json", "d.json")] == ["no JSON", "no background settings", "background settings are no object"] and rows["b.json"].settings is None
    (tmp_path / "fonts.txt").write_text("one.ttf\n\n two.ttf \n")
    assert [r.value for r in result_files.line_list(spark, str(tmp_path / "fonts.txt")).collect()] == ["one.ttf", "two.ttf"]
    boxes = spark.createDataFrame([(0, 9, 2, 3, 4), (0, 1, 2, 3, 4)], "line_id int, box_left int, box_top int, wid int, hei int")
    result_files.write_windows(boxes.coalesce(1), str(tmp_path / "w"))
    assert [r.value for r in spark.read.text(str(tmp_path / "w")).collect()] == ["0\t1\t2\t3\t4\t", "0\t9\t2\t3\t4\t"]
    result_files.write_windows(boxes.limit(0), str(tmp_path / "w"))
    assert spark.read.text(str(tmp_path / "w")).count() == 0
