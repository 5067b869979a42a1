"""Hand-made cases of the order-dependent operators, decoding, files, and sample planning."""

import math
import random
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import extract, frames, geometry
from glyphmill.operators import decode, generate, greedy, joins, lines
from glyphmill.operators.grouped import map_groups
from glyphmill.sources import result_files


def word(left, wid, log_prob=-0.5, text="w", kind=2, no=0, **more):
    return {"page_id": "p", "line_id": 0, "word_id": no, "word_str": text, "box_left": left, "wid": wid, "log_prob": log_prob, "lc_type": kind} | more


def kept(words, **kw):
    return [w["word_id"] for w in greedy.suppress(words, **kw)]


def test_suppression_chain_and_skip():
    chain = [word(0, 10, -0.5, no=0), word(4, 10, -0.4, no=1), word(8, 10, -0.3, no=2)]
    assert kept(chain) == [2]
    skip = [word(0, 10, -0.3, no=0), word(4, 10, -0.4, no=1), word(8, 10, -0.5, no=2)]
    assert kept(skip) == [0, 2]
    assert kept([word(0, 10, None, no=0), word(0, 10, 1.0, no=1), word(0, 10, -9.0, no=2)]) == [2]
    marks = [word(0, 10, -0.1, ",", 3, 0), word(8, 10, -0.2, ".", 3, 1)]
    assert kept(marks) == [0] and kept(marks, punctuation_needs_same_text=True) == [0, 1]
    assert kept([]) == [] and kept([word(0, 5)]) == [0]


def test_set_based_relative_keeps_only_undominated(spark):
    rows = [word(0, 10, -0.3, no=0), word(4, 10, -0.4, no=1), word(8, 10, -0.5, no=2)]
    df = spark.createDataFrame(rows)
    assert [r.word_id for r in greedy.dominated_removed(df).collect()] == [0]
    assert sorted(r.word_id for r in greedy.suppress_overlaps(df).collect()) == [0, 2]
    assert greedy.suppress_overlaps(df.limit(0)).count() == 0


def test_duplicates_are_averaged():
    out = greedy.merge_duplicates([word(0, 10, -0.2, "a", 2, 0), word(4, 12, -0.4, "a", 2, 1), word(5, 10, -0.4, "b", 2, 2), word(100, 10, -0.4, "a", 2, 3)])
    assert [(w["word_id"], w["copies"]) for w in out] == [(0, 2), (2, 1), (3, 1)]
    assert (out[0]["box_left"], out[0]["wid"]) == (2, 11) and out[0]["log_prob"] == pytest.approx(-0.2 / 2 / 2)
    assert len(greedy.merge_duplicates([word(0, 10, text="中", kind=0, no=0), word(5, 10, text="中", kind=0, no=1)])) == 2


def test_lines_of_words_and_merged_lines():
    ws = [word(0, 5, no=0, box_top=0, hei=10), word(10, 5, no=1, box_top=2, hei=10), word(5, 5, no=2, box_top=50, hei=10)]
    assert {r["word_id"]: r["found_line"] for r in greedy.group_into_lines(ws)} == {0: 0, 1: 0, 2: 1}
    two = [dict(word(0, 10, -0.1, no=0), box_top=0, hei=10), dict(word(1, 10, -0.9, no=1), line_id=1, box_top=1, hei=10), dict(word(40, 10, -0.9, no=2), line_id=1, box_top=1, hei=10)]
    assert [w["word_id"] for w in greedy.merge_lines(two)] == [0, 2]


def page_box(left, top, wid, hei, no=0, direction=0):
    return {"page_id": "p", "line_id": no, "box_left": left, "box_top": top, "wid": wid, "hei": hei, "n_words": 1, "direction": direction}


def test_reading_order():
    boxes = [page_box(300, 0, 100, 20, 0), page_box(0, 2, 100, 20, 1), page_box(0, 50, 400, 20, 2), page_box(100, 100, 50, 20, 3), page_box(20, 100, 50, 20, 4)]
    assert [r["line_id"] for r in greedy.order_page(boxes)] == [1, 0, 2, 4, 3]
    turned = [page_box(500 - b["box_top"] - b["hei"], b["box_left"], b["hei"], b["wid"], b["line_id"], 3) for b in boxes]
    assert [r["line_id"] for r in greedy.order_page(turned)] == [1, 0, 2, 4, 3]
    assert greedy.order_page([]) == []


@given(st.lists(st.integers(0, 30), max_size=40))
def test_pivot_sort_sorts_total_orders(xs):
    assert greedy.pivot_sort(xs, lambda a, b: a < b) == sorted(xs)


def test_pivot_sort_is_not_limited_by_recursion():
    assert greedy.pivot_sort(list(range(3000)), lambda a, b: a < b) == list(range(3000))


def test_push_down_never_moves_less_than_before():
    rows = [dict(page_box(0, 20 * i, 100, 20, i), real_height=25 + i) for i in range(6)]
    out = greedy.push_down(rows)
    moved = [o["box_top"] - r["box_top"] for o, r in zip(out, rows)]
    assert moved == sorted(moved) and moved[0] == 0 and moved[-1] > 0
    assert greedy.push_down(rows[:1]) == [{"page_id": "p", "line_id": 0, "box_left": 0, "box_top": 0}]


def test_stitching_covers_each_word_once():
    tiles = [(0, 0, 900), (1, 700, 900), (2, 1400, 600)]
    ws = []
    for x in range(0, 1950, 50):
        for t, left, wid in tiles:
            if left <= x and x + 40 <= left + wid:
                ws.append({"page_id": "p", "line_id": 0, "tile": t, "tile_left": left, "tile_wid": wid, "word_id": x, "word_str": str(x), "box_left": x, "wid": 40})
    assert [w["word_id"] for w in greedy.stitch(ws)] == list(range(0, 1950, 50))


def test_refined_positions_use_updated_neighbours():
    ws = [dict(word(0, 20, kind=0, no=0), hei=40, t_start=0, t_end=1), dict(word(30, 20, kind=2, no=1), hei=40, t_start=2, t_end=3), dict(word(100, 90, no=2), hei=40, t_start=4, t_end=9)]
    out = greedy.refine_positions(ws, 0, 200)
    assert out[0]["box_left"] == 0 and out[0]["wid"] == 28  # centre 14, limits 0 and 27
    assert out[1]["box_left"] == max(39 - 14, out[0]["box_left"] + out[0]["wid"] + 3) and out[2]["box_left"] == 100


# --- decoding ---------------------------------------------------------------------------------


def brute_ctc(p, labels, path):
    blank, total = labels - 1, 0.0
    for way in product(range(labels), repeat=len(p) // labels):
        out = [k for i, k in enumerate(way) if k != blank and (i == 0 or way[i - 1] != k)]
        if out == path:
            total += math.prod(p[t * labels + k] for t, k in enumerate(way))
    return math.log(total) if total > 0 else -87.0


def test_ctc_hand_cases_and_enumeration():
    assert decode.ctc_log_prob([0.6, 0.4], 2, [0]) == pytest.approx(math.log(0.6))
    assert decode.ctc_log_prob([0.6, 0.4] * 2, 2, [0]) == pytest.approx(math.log(0.84))
    assert decode.ctc_log_prob([0.6, 0.4] * 2, 2, [0, 0]) == -87.0
    assert decode.ctc_log_prob([], 2, [0]) == -87.0 and decode.ctc_log_prob([0.6, 0.4], 2, [5]) == -87.0
    rng = random.Random(1)
    for _ in range(30):
        labels, n = rng.choice([2, 3]), rng.randint(1, 5)
        p = []
        for _ in range(n):
            row = [rng.random() + 0.01 for _ in range(labels)]
            p += [x / sum(row) for x in row]
        path = [rng.randrange(labels - 1) for _ in range(rng.randint(0, 3))]
        assert decode.ctc_log_prob(p, labels, path) == pytest.approx(brute_ctc(p, labels, path), abs=1e-9)
    assert decode.case_variant([0.6, 0.3, 0.1], 3, [[0], [1], [1]])[1] == 0


def test_collapse_and_frames(spark):
    df = spark.createDataFrame([([1, 1, 9, 9, 1],), ([9, 1, 1, 2, 2, 9, 2],), ([9, 9, 9],), ([],)], "p array<int>")
    assert [r[0] for r in df.select(frames.collapse(F.col("p"), 9)).collect()] == [[1, 1], [1, 2, 2], [], []]
    m = spark.createDataFrame([([0.1, 0.9, 0.5, 0.5],), ([],), (None,)], "m array<double>")
    assert [r[0] for r in m.select(frames.best_labels(F.col("m"), 2)).collect()] == [[1, 0], [], None]
    row = m.limit(1).select(frames.top_k(F.col("m"), 3), frames.log_add(F.lit(-87.0), F.lit(-1.0)), frames.log_add(F.lit(0.0), F.lit(0.0))).first()
    assert row[0] == [1, 3, 2] and row[1] == -1.0 and row[2] == pytest.approx(math.log(2))
    assert decode.frame_runs([9, 1, 1, 9, 1, 2], 9) == [(1, 1, 2), (1, 4, 4), (2, 5, 5)]
    assert decode.shrink("__aa_ab__") == ("aab", [2, 5, 6], [4, 5, 7]) and decode.shrink("") == ("", [], [])


def test_alignment_and_edit_distance():
    assert decode.align("abc", "abc") == (3.0, [0, 1, 2])
    score, place = decode.align("abd", "abcd")
    assert score == 2.0 and place == [0, 1, 3]
    assert decode.align("", "ab") == (-2.0, [])
    assert decode.edit_distance("kitten", "sitting") == 3 and decode.edit_distance("é".encode(), b"e") == 2 and decode.edit_distance("ab", "ba", substitute=1.5) == 2


def test_word_pieces():
    pieces = lambda w: [p for p, _ in decode.split_word(w)]
    assert pieces("16mb.") == ["16mb", "."] and pieces("a-b") == ["a-b"] and pieces("it's") == ["it's"] and pieces("3.14-2") == ["3.14-2"]
    assert pieces("12abcd") == ["12", "abcd"] and pieces("ab12") == ["ab", "12"] and pieces("(x)") == ["(", "x", ")"] and pieces("") == []
    boxes = decode.split_boxes(word(0, 60, text="ab12"))
    assert [(b["word_str"], b["box_left"], b["wid"]) for b in boxes] == [("ab", 0, 24), ("12", 36, 24)]
    joined = decode.merge_close([word(0, 10, text="well"), word(12, 2, text="-"), word(15, 10, text="lit"), word(40, 5, text="x")], 4)
    assert [(w["word_str"], w["wid"]) for w in joined] == [("well-lit", 25), ("x", 5)]


def exhaustive(words, lm, weights, width):
    left, right = min(w["box_left"] for w in words), max(w["box_left"] + w["wid"] for w in words)
    best = None
    def walk(path, ws):
        nonlocal best
        if ws and right - (words[ws[-1][0]]["box_left"] + words[ws[-1][0]]["wid"]) < 0.5 * width:
            lm_sum = lm0 = check = rec = edit = 0.0
            prev, end = None, left
            for i, k in ws:
                text, lp, ch, ed = words[i]["candidates"][k]
                e = words[i]["box_left"] + words[i]["wid"]
                lm_sum += lm(prev, text); lm0 += lm(None, text) * abs(e - end) / (right - left); check += ch; rec += lp; edit += ed
                prev, end = text, e
            s = weights.lm * lm_sum + weights.lm0 * lm0 + weights.check * check + weights.recognition * rec + weights.edit * edit
            if best is None or s > best:
                best = s
        last = ws[-1][0] if ws else -1
        for i in range(last + 1, len(words)):
            ok = decode.reachable(words, last, i, width) if ws else words[i]["box_left"] - left < 0.5 * width
            if ok:
                for k in range(len(words[i]["candidates"])):
                    walk(None, ws + [(i, k)])
    walk(None, [])
    return best


def path_score(words, path, lm, w, width):
    only = [dict(words[i], candidates=[words[i]["candidates"][k]]) for i, k in path]
    return exhaustive(only, lm, w, width) if path else None


def test_beam_search_equals_exhaustive_search():
    rng = random.Random(2)
    model = {}
    lm = lambda p, t: model.setdefault((p, t), -rng.random() * 2)
    for _ in range(40):
        words, x = [], 0
        for _ in range(rng.randint(1, 4)):
            wid = rng.randint(10, 40)
            words.append({"box_left": x, "wid": wid, "candidates": [(rng.choice("abcd") * 2, -rng.random(), rng.random() * -0.3, -rng.random()) for _ in range(rng.randint(1, 3))]})
            x += wid + rng.randint(0, 6)
        path = decode.beam_search(words, lm, 10.0, beam=500)
        left, right = words[0]["box_left"], words[-1]["box_left"] + words[-1]["wid"]
        assert words[path[0][0]]["box_left"] == left and words[path[-1][0]]["box_left"] + words[path[-1][0]]["wid"] == right
        assert path_score([words[i] for i in range(len(words))], path, lm, decode.PLAIN, 10.0) == pytest.approx(exhaustive(words, lm, decode.PLAIN, 10.0))
    assert decode.beam_search([], lm, 10.0) == []


# --- geometry, joins, extraction --------------------------------------------------------------


def test_geometry_hand_cases(spark):
    one = spark.range(1)
    row = one.select(
        geometry.overlap_score(*[F.lit(v) for v in (0, 0, 10, 10, 0, 0, 10, 10)]).alias("a"),
        geometry.tiles(F.lit(2000), 900, 200).alias("t"), geometry.tiles(F.lit(1000), 900, 200).alias("u"), geometry.tiles(F.lit(0), 900, 200).alias("z"),
        geometry.polygon_height(F.array(*[F.lit(v) for v in (0, 0, 9, 0, 9, 5, 3, 4)])).alias("h"), geometry.polygon_height(F.array(F.lit(1))).alias("n"),
    ).first()
    assert row.a == 0.5 and [(t.left, t.wid) for t in row.t] == [(0, 900), (700, 900), (1400, 600)] and [(t.left, t.wid) for t in row.u] == [(0, 1000)]
    assert [(t.left, t.wid) for t in row.z] == [(0, 0)] and row.h == 5 and row.n is None


def test_band_join_gives_each_pair_once(spark):
    rng = random.Random(3)
    spans = [(i % 2, i, a, a + rng.randint(0, 300)) for i in range(150) for a in [rng.randint(-200, 900)]]
    df = spark.createDataFrame(spans, "k int, i int, a int, b int")
    right = joins.renamed(df)
    meet = (F.col("a") <= F.col("r_b")) & (F.col("r_a") <= F.col("b")) & (F.col("i") < F.col("r_i"))
    got = sorted((r.i, r.r_i) for r in joins.band_join(df, right, ["k"], "a", "b", 64, meet).collect())
    assert got == sorted((p[1], q[1]) for p in spans for q in spans if p[0] == q[0] and p[1] < q[1] and p[2] <= q[3] and q[2] <= p[3])


def test_merged_spans_and_upper_median(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 10, 12), (1, 11, 11), (2, 3, 3)], "k int, a int, b int")
    assert sorted((r.k, r.start, r.end, r.n) for r in lines.merged_spans(df, ["k"], "a", "b").collect()) == [(1, 0, 9, 2), (1, 10, 12, 2), (2, 3, 3, 1)]
    ws = spark.createDataFrame([("p", 0, i, w, 10) for i, w in enumerate([4, 3, 5, 6])], "page_id string, line_id int, word_id int, wid int, hei int")
    heights = spark.createDataFrame([("p", 0, 20)], "page_id string, line_id int, line_hei int")
    assert lines.upper_medians(ws, heights).first().median_wid == 5


def test_accounts(spark):
    texts = ["see http://a-b.com/x?y=1 or a_b@c.org", "a_b@c.org 13812345678", "call 13812345678", "12345", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("a", extract.account(F.col("t")))
    got = {r.i: r.a and (r.a.kind, r.a.value) for r in df.collect()}
    assert got == {0: ("url", "http://a-b.com/x?y=1 or a_b"), 1: ("email", "a_b@c.org"), 2: ("telephone", "13812345678"), 3: None, 4: None, 5: None}


def test_map_groups_keeps_groups_whole(spark):
    df = spark.range(5000).select((F.col("id") % 37).alias("k"), "id")
    out = map_groups(df, ["k"], ["id"], lambda g: [{"k": g[0]["k"], "n": len(g), "s": sum(r["id"] for r in g)}], "k long, n long, s long")
    want = df.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


# --- files and sample planning ----------------------------------------------------------------


def test_files_are_read_back(spark, tmp_path):
    (tmp_path / "d.txt").write_text("10\t19\t5\t9\t0\t2\n-1\t3\t4\t5\t0\t1\nbad row\n0\t0\t0\t0\t1\t1\n")
    got = sorted((r.box_left, r.box_top, r.wid, r.hei) for r in result_files.detected_lines(spark, str(tmp_path / "d.txt")).collect())
    assert got == [(0, 0, 1, 1), (10, 5, 10, 5)]
    (tmp_path / "r.txt").write_text("1\t2\t3\t4\t5\t6\t7\t8\t\n1 2 3\n")
    assert [(r.word_id, r.box_left, r.hei) for r in result_files.word_rects(spark, str(tmp_path / "r.txt")).collect()] == [(0, 1, 4), (1, 5, 8)]
    (tmp_path / "w.txt").write_text("0 1 2 3 4 word\n0 x 2 3 4 no\n1 1 1\n")
    assert [(r.line_id, r.word_str) for r in result_files.word_results(spark, str(tmp_path / "w.txt"), True).collect()] == [(0, "word")]
    (tmp_path / "l.txt").write_text("65281 0\n97 1\n")
    assert sorted((r.code, r.idx) for r in result_files.label_table(spark, str(tmp_path / "l.txt")).collect()) == [(33, 0), (97, 1)]
    (tmp_path / "t.txt").write_text("10 48 a.jpg 1,2,96\n10 48 b.jpg 97\n-1 2 c.jpg 1\nx\n")
    rows = result_files.training_list(spark, str(tmp_path / "t.txt"))
    assert sorted(r.path for r in rows.collect()) == ["a.jpg", "b.jpg"] and [r.path for r in result_files.invalid_training_rows(rows).collect()] == ["b.jpg"]
    (tmp_path / "c.ini").write_text("[GLOBAL]\nA = 1\n[OTHER]\nA=2\n")
    assert result_files.read_config(str(tmp_path / "c.ini"), "GLOB") == {"A": "1"}
    (tmp_path / "i").mkdir()
    for n in ("ab.jpg", ".x.png", "a.gif", "long.png"):
        (tmp_path / "i" / n).write_bytes(b"x")
    assert sorted(r.name for r in result_files.image_files(spark, str(tmp_path / "i")).collect()) == ["ab.jpg", "long.png"]


def test_result_text_round_trip(spark, tmp_path):
    ls = spark.createDataFrame([("p", 0, 1, 2, 30, 4, 100, 200, "a b"), ("p", 1, 1, 9, 30, 4, 100, 200, "")], "page_id string, line_id int, box_left int, box_top int, wid int, hei int, img_w int, img_h int, line_str string")
    ws = spark.createDataFrame([("p", 0, 0, 1, 2, 10, 4, "a", 0.5), ("p", 0, 1, 15, 2, 10, 4, "b", None)], "page_id string, line_id int, word_id int, box_left int, box_top int, wid int, hei int, word_str string, prob double")
    rows = result_files.result_text(ls, ws)
    values = [r.value for r in rows.orderBy("row_no").collect()]
    assert values == ["p\t100\t200\t", "1\t2\t30\t4\ta b\t1\t2\t10\t4\ta\t15\t2\t10\t4\tb\t"]
    result_files.write_results(rows, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(values)
    probs = [r.value for r in result_files.result_text(ls, ws, True).orderBy("row_no").collect()]
    assert probs[2:] == ["1\t2\t10\t4\ta\t0.5000\t", "15\t2\t10\t4\tb\t0.0000\t"]
    truth = result_files.truth_rows(spark.createDataFrame([("1 2 3 4 0 a b",), ("1 2 3 4 0 a",)], "value string")).collect()
    assert truth[0].row.split("\t")[10] == "" and truth[1].row.split("\t")[10] == "a" and truth[1].row.startswith("1\t2\t4\t2\t4\t6\t1\t6\t#\t1\t")


def test_font_choice_evens_out():
    picks = generate.choose_fonts(list(range(8)), 4000, seed=1)
    counts = [picks.count(f) for f in range(8)]
    assert min(counts) > 0.7 * max(counts) and generate.choose_fonts([1, 2], 5, 7) == generate.choose_fonts([1, 2], 5, 7)


@given(st.floats(0, 359), st.integers(0, 50), st.integers(0, 50))
@settings(max_examples=5, deadline=None)
def test_rotation_keeps_area(spark, degrees, left, top):
    df = spark.createDataFrame([(left, top, 200, 100)], "box_left int, box_top int, wid int, hei int")
    r = generate.rotated_boxes(df, degrees, 10.0, 20.0).first()
    xs, ys = [r.x1, r.x2, r.x3, r.x4], [r.y1, r.y2, r.y3, r.y4]
    area = abs(sum(xs[i] * ys[(i + 1) % 4] - xs[(i + 1) % 4] * ys[i] for i in range(4))) / 2
    assert area == pytest.approx(20_000, rel=0.03)


def test_candidates_that_differ_at_both_ends(spark):
    from glyphmill.operators import decode

    seen = ["eomplete", "ndert", "head", "Xbcdefgh", "aab", "it"]
    lexicon = ["completes", "under", "near", "abcdefgi", "ba", "b", "head", "bcdefghij"]
    words = spark.createDataFrame([("p", 0, i, w, -1.0) for i, w in enumerate(seen)], "page_id string, line_id int, word_id int, word_str string, log_prob double")
    rows = decode.expand_candidates(words, spark.createDataFrame([(w,) for w in lexicon], "word string")).filter("cand_id > 0").collect()

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = next_row(row, i, x, b)
        return row[-1]

    def next_row(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    want = set()
    for i, w in enumerate(seen):
        if len(w) >= 3:
            near = sorted((distance(w.lower(), x), x) for x in lexicon if distance(w.lower(), x) <= 2)[:5]
            want |= {(i, x) for d, x in near if d}
    assert {(r.word_id, r.text) for r in rows} == want and {(0, "completes"), (1, "under"), (2, "near")} <= want


def test_queries_without_sql_keep_their_invariants(spark):
    from glyphmill.plans import further_queries, operator_queries
    from tests.conftest import SF_SMALL

    q = further_queries.QUERIES
    lines = operator_queries.lines(spark, SF_SMALL).count()
    turned = q["o3_turned_pages"](spark, SF_SMALL).groupBy("direction").count().collect()
    assert {(r["direction"], r["count"]) for r in turned} == {(d, lines) for d in (1, 2, 3)}
    all_words = {(r.page_id, r.line_id, r.word_id) for r in operator_queries.words(spark, SF_SMALL).collect()}
    kept = [tuple(r) for r in q["j6_suppressed_equal_text"](spark, SF_SMALL).collect()]
    assert len(set(kept)) == len(kept) and set(kept) < all_words
    boxes = q["f23_row_boxes"](spark, SF_SMALL).collect()
    assert boxes and len({(r.sample_id, r.letter_no) for r in boxes}) == len(boxes) and all(r.wid > 0 and r.hei > 0 for r in boxes)
