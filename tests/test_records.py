"""Problems 4 and 5 against plain Python over whole small tables and hand-made cases."""

import base64
import csv
import io
import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.operators import json_grammar, nested
from glyphmill.operators.parse_rows import WORD_GRAMMAR, parse_responses, parse_word_dump, parse_word_rows, read_dumps
from glyphmill.operators.row_grammar import Fault
from glyphmill.plans import records
from tests.conftest import SF_SMALL

WORD_CASES = [
    ('pg1,0,1,2,3,4,5,"a ""b"", c",0.5', None),
    ("pg1,0,1,-2,3,4,5,word,", None),
    ('"pg1","0",1,2,3,4,5,"line\nfeed",1e-3', None),
    ('pg1,0,1,2,3,4,5,a"b,0.5', "quoting"),
    ('pg1,0,1,2,3,4,5,"a"b,0.5', "quoting"),
    ('pg1,0,1,2,3,4,5,"a,0.5', "quoting"),
    ("pg1,0,1,2,3,4,5,a\nb,0.5", "quoting"),
    ('pg1,0,x,2,3,4,5,"a" ,0.5,9', "quoting"),
    ("pg1,0,1,2,3,4,5,a,0.5,", "columns"),
    ("", "columns"),
    (None, "columns"),
    ("pg1,0,1,2,3,0,5,a,0.5", "value"),
    ("pg1,-1,1,2,3,4,5,a,0.5", "value"),
    ("pg1,0,1,2,3,4,5,,0.5", "value"),
    ("pg1,0,1,99999999999,3,4,5,a,0.5", "value"),
    ("pg1,0,1,2147483647,-2147483648,4,5,a,1.0", None),
    ("pg1,0,1,٣,3,4,5,a,0.5", "value"),
    ("pg1,0,1,2,3,4,5,a,1.02", "value"),
    ("pg1,0,1,2,3,4,5,a,NaN", "value"),
]


def test_word_rows_cases(spark):
    df = spark.createDataFrame([(i, raw, "kept") for i, (raw, _) in enumerate(WORD_CASES)], "row_id long, raw string, reason string")
    got = {r.row_id: r for r in parse_word_rows(df).collect()}
    assert [got[i].reason for i in range(len(WORD_CASES))] == [want for _, want in WORD_CASES]
    assert got[0].word.text == 'a "b", c' and got[1].word.prob is None and got[2].word.line_id == 0
    assert parse_word_rows(df.limit(0)).count() == 0


def test_word_row_fault_is_located():
    record = WORD_GRAMMAR.one('pg1,0,1,2,3,4,5,a"b,0.5')
    assert record.fault.offset == 17


def test_dump_resumes_at_validated_anchor(spark):
    dump = "\n".join(
        [
            'pg1,0,0,1,1,1,1,"ok",0.5',
            'pg1,0,1,1,1,1,1,"broken,0.5',
            "not,a,record start",
            'pg1,0,2,1,1,1,1,"fine",0.5',
            "short,1",
            "pg1,0,3,1,1,1,1,last,0.5",
        ]
    )
    rows = parse_word_dump(spark.createDataFrame([(1, dump), (2, None), (3, "")], "id int, text string")).orderBy("record_no").collect()
    assert [(r.reason, r.word and r.word.text) for r in rows] == [(None, "ok"), ("quoting", None), (None, "fine"), ("columns", None), (None, "last")]
    assert dump[rows[2].start :].startswith("pg1,0,2")


@given(st.lists(st.text(alphabet='a",\n ü', max_size=6), min_size=9, max_size=9))
@settings(max_examples=200, deadline=None)
def test_written_rows_are_read_back(fields):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(fields)
    assert WORD_GRAMMAR.one(out.getvalue()).fields == fields


JSON_BAD = ["", " ", "{", "[1,]", '{"a":1,}', "{'a':1}", '{"a" 1}', "01", "1.", "+1", "NaN", "1 2", '"\x01"', '"\\x"', "[1}", "{1:2}", "\ufeff1", "tru", "]", ",", '{"a":}', "[,1]"]
JSON_GOOD = ["0", "-0", "1e5", "[]", "{}", ' {"a": [1, {"b": null}], "c": "\\u00e9\\n"} ', '"\\ud800"', "[[[]]]", "true"]


def test_json_grammar_cases():
    for text in JSON_BAD:
        with pytest.raises(Fault):
            json_grammar.parse(text)
    for text in JSON_GOOD:
        assert json.loads(json_grammar.dump(json_grammar.parse(text))) == json.loads(text)
    json_grammar.parse("[" * 100_000 + "]" * 100_000)


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=20))
@settings(max_examples=200, deadline=None)
def test_json_round_trip(value):
    assert json.loads(json_grammar.dump(json_grammar.parse(json.dumps(value)))) == value


@given(st.text(alphabet='{}[]:,"a1e.- \\utrf', max_size=12))
@settings(max_examples=500, deadline=None)
def test_json_accepts_what_json_accepts(text):
    try:
        json.loads(text, parse_constant=lambda x: 1 / 0)
        good = True
    except (ValueError, ZeroDivisionError):
        good = False
    try:
        json_grammar.parse(text)
        assert good
    except Fault:
        assert not good


def plain_reason(result, kind):
    """Problem 4's rules for a result, on Python's own parser."""
    if result is None:
        return None, None
    try:
        text = base64.b64decode(result, validate=True).decode() if kind == "json_base64" else result
        tree = json.loads(text, parse_constant=lambda x: 1 / 0)
        assert isinstance(tree, dict)
    except Exception:
        return "syntax", None
    listed = lambda x: x if isinstance(x, list) else [] if x is None else [x]
    found = set()
    for item in listed(tree.get("ret")):
        for holder in [item, *listed((item or {}).get("charset"))] if isinstance(item, dict) else []:
            rect = holder.get("rect") if isinstance(holder, dict) else None
            if rect is None:
                continue
            members = rect.split(" ") if isinstance(rect, str) else [rect.get(k, KeyError) for k in ("left", "top", "width", "height")]
            if len(members) != 4 or KeyError in members:
                found.add("columns")
                continue
            for k, x in enumerate(members):
                if isinstance(x, bool) or not isinstance(x, (int, str)) or not re.fullmatch("-?[0-9]+", str(x)) or (k > 1 and int(x) < 1):
                    found.add("value")
    return ("columns" if "columns" in found else "value" if found else None), tree


def plain_elements(tree):
    listed = lambda x: x if isinstance(x, list) else [] if x is None else [x]
    for i, item in enumerate(listed(tree.get("ret"))):
        if item is None:
            continue
        yield i, -1, -1
        for j, char in enumerate(listed(item.get("charset")) if isinstance(item, dict) else []):
            if char is None:
                continue
            yield i, j, -1
            for k, cand in enumerate(listed(char.get("candidate")) if isinstance(char, dict) else []):
                if cand is not None:
                    yield i, j, k


RESPONSES = [
    '{"ret": {"rect": "1 2 3 4", "word": "a", "charset": {"rect": "1 2 3 4", "candidate": "x"}}}',
    '{"ret": [null, {"rect": {"left": 1, "top": "2", "width": 3, "height": 4}, "charset": [null, {"candidate": [null, "a", {"word": "b"}]}]}]}',
    '{"ret": [{"rect": "1 2 3"}]}',
    '{"ret": [{"rect": "1 2  3 4"}]}',
    '{"ret": [{"rect": {"left": 1, "top": 2, "width": 0, "height": 4}}, {"rect": {"left": 1}}]}',
    '{"ret": [{"rect": {"left": 1.0, "top": 2, "width": 1, "height": 4}}]}',
    '{"ret": [{"rect": {"left": null, "top": 2, "width": 1, "height": 4}}]}',
    '{"ret": null}',
    "{}",
    "[]",
    "",
    None,
    '{"ret": [{"charset": [{"rect": "1 2 -3 4"}]}]}',
]


def test_responses_cases_and_elements(spark):
    df = spark.createDataFrame([(i, r, "json", "x") for i, r in enumerate(RESPONSES)], "response_id long, result string, result_type string, value string")
    got = {r.response_id: r for r in parse_responses(df, text="json").collect()}
    assert [got[i].reason for i in range(len(RESPONSES))] == [plain_reason(r, "json")[0] for r in RESPONSES]
    valid = parse_responses(df, text="json").filter("json IS NOT NULL").drop("value")
    rows = nested.explode_levels(nested.to_variant(valid, "json"), "value", [(n,) for n in records.RESULT_PATH], records.RESULT_ORDINALS)
    got = sorted((r.response_id, r.ret_no, r.char_no, r.cand_no) for r in rows.collect())
    want = sorted((i, *e) for i, r in enumerate(RESPONSES) if plain_reason(r, "json") != (None, None) and plain_reason(r, "json")[0] is None for e in plain_elements(plain_reason(r, "json")[1]))
    assert got == want


def test_repeated_members_and_escapes_reach_the_tables(spark):
    texts = ['{"ret": 1, "ret": [{"word": "a", "word": "b\\u00e9\\ud800"}, {"word": "\\"x\\\\"}]}', '{"ret": [{"word": "é\\/"}]}']
    df = spark.createDataFrame(list(enumerate(texts)), "response_id long, result string").withColumn("result_type", F.lit(None).cast("string"))
    parsed = parse_responses(df, text="json").filter("json IS NOT NULL")
    schema = nested.infer(parsed, "json")
    rows = nested.child_table(nested.to_variant(parsed.select("response_id", "json"), "json"), "response_id", "value", ("ret",), schema)
    got = sorted((r.row_id, r.word) for r in rows.collect())
    assert [g[0] for g in got] == ["0/0", "0/1", "1/0"] and got[0][1].startswith("bé") and got[1][1] == '"x\\' and got[2][1] == "é/"


def test_found_queries_match_plain_python(spark):
    answers = spark.read.parquet(f"{SF_SMALL}/responses.parquet").toPandas().drop_duplicates("response_id")
    want4, want5 = set(), set()
    for r in answers.itertuples():
        reason, tree = plain_reason(r.result, r.result_type)
        if reason:
            want4.add((r.response_id, reason))
        elif tree is not None:
            want5 |= {(r.response_id, *e) for e in plain_elements(tree)}
    got4 = records.p4_found(spark, SF_SMALL).filter("src = 'responses'").collect()
    assert {(r.rec_id, r.reason) for r in got4} == want4 and len(got4) == len(want4)
    got5 = records.p5_found(spark, SF_SMALL).collect()
    assert {tuple(r) for r in got5} == want5 and len(got5) == len(want5)


def test_child_tables_link_to_parents(spark):
    q = records.queries()
    parents = {r.row_id for r in q["p5_records"](spark, SF_SMALL).collect()}
    lines = q["p5_lines"](spark, SF_SMALL).collect()
    chars = q["p5_chars"](spark, SF_SMALL).collect()
    cands = q["p5_candidates"](spark, SF_SMALL).collect()
    assert {r.parent_id for r in lines} <= parents
    assert {r.parent_id for r in chars} <= {r.row_id for r in lines}
    assert {r.parent_id for r in cands} <= {r.row_id for r in chars}
    found = records.p5_found(spark, SF_SMALL).collect()
    assert len(found) == len(lines) + len(chars) + len(cands)


def test_infer_merges_kinds_and_survives_bad_text(spark):
    df = spark.createDataFrame([('{"a": [{"b": 1}]}',), ('{"a": {"b": "x", "c": null}}',), ("no json",), (None,)], "t string")
    schema = nested.infer(df, "t")
    assert schema.arrays() == [("a",)] and schema.members["a"].members["b"].kinds == {"number", "string"}
    assert nested.infer(df.limit(0), "t").members == {}


def test_exploding_keeps_other_columns_and_replaces_clashing_ones(spark):
    df = spark.createDataFrame([(1, '{"ret": ["a", null, "b"]}', "kept", 7), (1, None, "kept", 7), (2, "{}", "kept", 7)], "response_id long, json string, node string, ret_no int").withColumn("more", F.col("node"))
    rows = nested.explode_levels(nested.to_variant(df, "json"), "value", [("ret",)], ["ret_no"])
    assert [(r.response_id, r.ret_no, r.more) for r in rows.select("response_id", "ret_no", "more").collect()] == [(1, 0, "kept"), (1, 2, "kept")]


def test_levels_come_from_the_merged_schema(spark):
    texts = ['{"ret": [{"x": {"y": [1, [2]]}}], "q": 1}', '{"ret": {"charset": {"candidate": "a"}}}', "no"]
    df = spark.createDataFrame([(t, "json") for t in texts], "result string, result_type string")
    schema = nested.merged(parse_responses(df, pairs="pairs").filter("pairs IS NOT NULL"), "pairs")
    assert nested.levels_to(schema, ("ret", "x", "y")) == [("ret",), ("x", "y")]
    assert nested.levels_to(schema, records.RESULT_PATH) == [("ret",)]
    assert nested.levels_to(schema, records.RESULT_PATH, records.RESULT_PATH) == [("ret",), ("charset",), ("candidate",)]
    assert nested.levels_to(schema, ("q", "z")) == [] and nested.levels_to(nested.Node(), ("a",)) == []
    assert schema.members == nested.infer(df, "result").members


def test_results_beyond_the_limits_of_sparks_parser_keep_their_elements(spark):
    deep = '{"ret": [{"word": "a", "x": ' + "[" * 1100 + "]" * 1100 + '}, {"word": "b"}]}'
    digits = '{"ret": [{"word": ' + "7" * 1200 + '}, {"word": "b"}]}'
    df = spark.createDataFrame([(1, deep), (2, digits), (3, '{"ret": [{"word": "a"}, null, {}]}'), (4, None)], "response_id long, json string")
    rows = nested.explode_levels(nested.to_variant(df, "json"), "value", [("ret",)], ["ret_no"])
    got = sorted((r.response_id, r.ret_no, r.word) for r in rows.selectExpr("response_id", "ret_no", "try_variant_get(node, '$.word', 'string') AS word").collect())
    assert got == [(1, 0, "a"), (1, 1, "b"), (2, 0, "7" * 1200), (2, 1, "b"), (3, 0, "a"), (3, 2, None)]
    long = df.limit(1).selectExpr("response_id", """concat('{"ret": [{"word": "', repeat('x', 25000000), '"}, 1]}') AS json""")
    assert nested.explode_levels(nested.to_variant(long, "json", values=False), "value", [("ret",)], ["ret_no"]).count() == 2


def test_every_array_level_has_a_table(spark):
    q = records.queries()
    tables = {n: q[n](spark, SF_SMALL).collect() for n in ("p5_lines", "p5_records", "p5_points", "p5_languages", "p5_object_types")}
    levels = records.result_schema(spark, SF_SMALL).arrays()
    covered = {("ret",), ("ret", "charset"), ("ret", "charset", "candidate"), ("ret", "poly_location", "points"), ("image_info", "lang_prob_map"), ("image_info", "detected_obj_type_list")}
    assert set(levels) <= covered
    assert tables["p5_points"] and {r.parent_id for r in tables["p5_points"]} <= {r.row_id for r in tables["p5_lines"]} and {"x", "y"} <= set(tables["p5_points"][0].asDict())
    for name in ("p5_languages", "p5_object_types"):
        assert tables[name] and {r.parent_id for r in tables[name]} <= {r.row_id for r in tables["p5_records"]}


def test_single_elements_and_deep_objects_are_in_the_tables(spark, tmp_path):
    result = '{"a": {"b": {"c": {"d": "deep"}}}, "ret": {"word": "w", "rect": "1 2 3 4", "p": {"q": {"r": 5}}}}'
    spark.createDataFrame([(1, result, "json")], "response_id long, result string, result_type string").write.parquet(f"{tmp_path}/responses.parquet")
    q = records.queries()
    lines = q["p5_lines"](spark, str(tmp_path)).collect()
    assert [(r.parent_id, r.row_id, r.ordinal, r.word, r.p_q_r) for r in lines] == [("1", "1/0", 0, "w", "5")] and records.p5_found(spark, str(tmp_path)).count() == 1
    top = q["p5_records"](spark, str(tmp_path)).collect()
    assert [r.a_b_c_d for r in top] == ["deep"] and not any(c.startswith("ret") for c in top[0].asDict())


def test_no_record_of_a_dump_reaches_beyond_an_anchor():
    good = ['pg1,0,{},1,1,1,1,"w{}",0.5'.format(i, i) for i in range(4)]
    # a record with an open quote and too many fields, which a stray quote closes two records later
    dump = "\n".join(['pg1,0,9,1,1,1,1,x,0.5,"open', good[0], good[1], 'stray"', good[2]])
    got = list(WORD_GRAMMAR.dump(dump))
    assert [r.fields[7] for r in got if r.fields] == ["w0", "w1", "w2"] and got[0].fault.kind == "quoting"
    # two stray quotes in records of nine fields: one "record" with the rows between as its text
    dump = "\n".join(['pg1,0,9,1,1,1,1,"open', good[0].replace('"', ""), 'end",0.5', good[2]])
    assert [r.fields[7] for r in WORD_GRAMMAR.dump(dump) if r.fields] == ["w0", "w2"]
    # lines inside a text that are no whole records stay text
    assert [r.fields[7] for r in WORD_GRAMMAR.dump('pg1,0,9,1,1,1,1,"a\nb,1,2\n",0.5\n' + good[3])] == ["a\nb,1,2\n", "w3"]


def test_known_anchors_part_rows_whatever_their_quotes(spark):
    rows = ['pg1,0,1,1,1,1,1,"open', 'pg1,0,2,1,1,1,1,fine,1', 'close",0.5', "", 'pg1,0,3,1,1,1,1,"x\ny",']
    df = spark.createDataFrame(list(enumerate(rows)), "row_id long, raw string").coalesce(1)
    assert [r.reason for r in parse_word_rows(df).orderBy("row_id").collect()] == ["quoting", None, "quoting", "columns", None]


def test_leading_zeros_are_no_digits(spark):
    df = spark.createDataFrame([(1, f"p,{'0' * 401},-{'0' * 50}1,0,0,0001,1,a,1"), (2, "p,-0,1,0,0,1,1,a,1"), (3, f"p,1,1,{'9' * 5000},0,1,1,a,1"), (4, "p,1,1,02147483648,0,1,1,a,1")], "row_id long, raw string")
    got = {r.row_id: r for r in parse_word_rows(df).collect()}
    assert [got[i].reason for i in (1, 2, 3, 4)] == ["value", None, "value", "value"]  # line 1: word_id is -1
    assert got[2].word.line_id == 0


def test_dumps_put_together_give_the_valid_rows(spark):
    words = spark.read.parquet(f"{SF_SMALL}/word_rows.parquet")
    want = {r.row_id for r in parse_word_rows(words.select("row_id", "raw").distinct()).filter("reason IS NULL").collect()}
    got = [r.row_id for r in read_dumps(words.withColumn("word", F.lit(1))).filter("reason IS NULL").collect()]
    assert set(got) == want and len(got) == len(want)
    assert read_dumps(words.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None, None, None), (1, None, None, "p,0,1,0,0,1,1,a,1"), (1, None, None, "p,0,1,0,0,1,1,a,1")], "row_id long, src_file string, row_no int, raw string")
    assert [r.row_id for r in read_dumps(odd).filter("reason IS NULL").collect()] == [1]


@given(st.text(alphabet='{}[]:,"a1e.- \\utrfN', max_size=12))
@settings(max_examples=300, deadline=None)
def test_quick_reading_accepts_what_the_grammar_accepts(text):
    def of(read):
        try:
            return repr(read(text))
        except Fault:
            return None

    assert of(json_grammar.quick) == of(json_grammar.parse)


def test_quick_reading_of_deep_and_long_values():
    deep = "[" * 100_000 + "]" * 100_000
    assert json_grammar.dump(json_grammar.quick(deep)) == deep and json_grammar.quick("7" * 6000) == "7" * 6000


def test_answers_without_an_id_have_keys_of_their_own(spark, tmp_path):
    text = '{"ret": [{"word": "%s", "word": "%s"}, {"word": "x", "charset": [{"word": "y"}, {"word": "z"}]}]}'
    rows = [(0, text % ("p", "a"), "json"), (None, text % ("q", "a"), "json"), (None, text % ("p", "b"), "json"), (None, text % ("p", "b"), "json")]
    spark.createDataFrame(rows, "response_id long, result string, result_type string").write.parquet(f"{tmp_path}/responses.parquet")
    q = records.queries()
    top = [r.row_id for r in q["p5_records"](spark, str(tmp_path)).collect()]
    lines = q["p5_lines"](spark, str(tmp_path)).collect()
    chars = q["p5_chars"](spark, str(tmp_path)).collect()
    assert len(set(top)) == len(top) == 3 and "0" in top
    assert len({r.row_id for r in lines}) == len(lines) == 6 and {r.parent_id for r in lines} == set(top)
    assert sorted(r.word for r in lines) == ["a", "a", "b", "x", "x", "x"]
    assert len({r.row_id for r in chars}) == 6 and {r.parent_id for r in chars} <= {r.row_id for r in lines}
    assert records.p5_found(spark, str(tmp_path)).count() == 12
