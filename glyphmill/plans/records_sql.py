"""SQL of problems 4 and 5: the rules for results and the flat tables, on DuckDB's JSON functions."""


def _listed(value: str, member: str) -> str:
    """The elements at a member: a list as stored, a single element as a list of one."""
    at = f"'$.{member}'"
    return f"CASE coalesce(json_type({value}, {at}), 'NULL') WHEN 'NULL' THEN [] WHEN 'ARRAY' THEN json_extract({value}, '$.{member}[*]') ELSE [json_extract({value}, {at})] END"


def _level(name: str, parent: str, item: str, member: str, ordinal: str, where: str) -> str:
    """A table of the elements of one level, with the row key of the parent."""
    inner = f"SELECT k, response_id, row_id AS parent_id, {_listed(item, member)} AS l FROM {parent} WHERE {where}"
    rows = f"SELECT k, response_id, parent_id, generate_subscripts(l, 1) - 1 AS {ordinal}, unnest(l) AS item FROM ({inner})"
    return f"{name} AS MATERIALIZED (SELECT *, parent_id || '/' || {ordinal} AS row_id FROM ({rows}))"


_OBJECT = "json_type(item) = 'OBJECT'"
_DIGITS = "regexp_full_match({}, '{}')"
_SIDES = "['left', 'top', 'width', 'height']"
#: Results, the texts in them, the objects (null for a syntax fault), the elements of their levels, and each result's reason.
JUDGED = f"""
  src AS (SELECT DISTINCT response_id, result, result_type FROM responses WHERE result IS NOT NULL),
  txt AS (SELECT *, CASE WHEN result_type IS DISTINCT FROM 'json_base64' THEN result
          WHEN regexp_full_match(result, '([A-Za-z0-9+/]{{4}})*([A-Za-z0-9+/]{{2}}==|[A-Za-z0-9+/]{{3}}=)?') THEN try(decode(from_base64(result))) END AS j FROM src),
  obj AS MATERIALIZED (SELECT *, row_number() OVER () AS k, coalesce(CAST(response_id AS VARCHAR), '#' || sha256(result)) AS row_id,
          CASE WHEN json_valid(j) AND NOT regexp_matches(regexp_replace(j, '"(\\\\.|[^"\\\\])*"', '""', 'g'), ',\\s*[\\]}}]|[Nn]a[Nn]|[Ii]nf')
          THEN CASE WHEN json_type(j) = 'OBJECT' THEN j::JSON END END AS o FROM txt),
  {_level("items", "obj", "o", "ret", "ret_no", "o IS NOT NULL")},
  {_level("chrs", "items", "item", "charset", "char_no", _OBJECT)},
  rects AS (SELECT k, json_extract(item, '$.rect') AS r FROM items WHERE {_OBJECT} UNION ALL SELECT k, json_extract(item, '$.rect') FROM chrs WHERE {_OBJECT}),
  four AS (SELECT k, CASE json_type(r) WHEN 'VARCHAR' THEN string_split(r->>'$', ' ') WHEN 'OBJECT' THEN CASE WHEN list_has_all(json_keys(r), {_SIDES}) THEN
          list_transform({_SIDES}, lambda n: CASE WHEN json_type(r, '$.' || n) IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') THEN json_extract_string(r, '$.' || n) ELSE 'x' END) END END AS m
          FROM rects WHERE coalesce(json_type(r), 'NULL') <> 'NULL'),
  bad AS (SELECT k, CASE WHEN bool_or(m IS NULL OR len(m) <> 4) THEN 'columns' WHEN bool_or(NOT ({_DIGITS.format("m[1]", "-?[0-9]+")} AND {_DIGITS.format("m[2]", "-?[0-9]+")}
          AND {_DIGITS.format("m[3]", "0*[1-9][0-9]*")} AND {_DIGITS.format("m[4]", "0*[1-9][0-9]*")})) THEN 'value' END AS reason FROM four GROUP BY k),
  judged AS (SELECT obj.*, CASE WHEN o IS NULL THEN 'syntax' ELSE bad.reason END AS reason FROM obj LEFT JOIN bad USING (k)),
  good AS (SELECT k FROM judged WHERE reason IS NULL)"""
_MORE = f"""
  {_level("cands", "chrs", "item", "candidate", "cand_no", _OBJECT)}"""

FAILING_RESPONSES = "SELECT DISTINCT 'responses' AS src, response_id AS rec_id, reason FROM judged WHERE reason IS NOT NULL"
_POSITION = "CAST(split_part(row_id, '/', {}) AS INTEGER)"
FOUND = f"""WITH {JUDGED},{_MORE},
  el AS (SELECT k, response_id, item, row_id || '/-1/-1' AS row_id FROM items UNION ALL SELECT k, response_id, item, row_id || '/-1' FROM chrs UNION ALL SELECT k, response_id, item, row_id FROM cands)
  SELECT response_id, {_POSITION.format(2)} AS ret_no, {_POSITION.format(3)} AS char_no, {_POSITION.format(4)} AS cand_no FROM el SEMI JOIN good USING (k) WHERE json_type(item) <> 'NULL'"""


def _text(item: str, path: str) -> str:
    """A scalar as text, null where an object stands."""
    return f"CASE WHEN json_type({item}, '$.{path}') <> 'OBJECT' THEN json_extract_string({item}, '$.{path}') END"


def _members(item: str, paths: str) -> str:
    return ", ".join(f"{_text(item, p)} AS {p.replace('.', '_')}" for p in paths.split())


def _table(level: str, ordinal: str, paths: str, more: str = "", ctes: str = "") -> str:
    columns = _members("item", paths) + more
    return f"WITH {JUDGED}{ctes} SELECT parent_id, row_id, CAST({ordinal} AS INTEGER) AS ordinal, {columns.removeprefix(', ')} FROM {level} SEMI JOIN good USING (k) WHERE json_type(item) <> 'NULL'"


_RECT = "rect rect.height rect.left rect.top rect.width"
_VALUE = ", CASE WHEN json_type(item) <> 'OBJECT' THEN json_extract_string(item, '$') END AS value"
TABLES = {
    "p5_records": f"WITH {JUDGED} SELECT row_id, {_members('o', 'errmas errno image_info.image_dir image_info.image_status image_info.lang_cate image_info.obj_type image_info.text_type querysign')} FROM judged WHERE reason IS NULL",
    "p5_lines": _table("items", "ret_no", f"{_RECT} word"),
    "p5_chars": _table("chrs", "char_no", f"recg_prob {_RECT} word"),
    "p5_candidates": _table("cands", "cand_no", "prob word", _VALUE, f",{_MORE}"),
    "p5_points": _table("points", "point_no", "x y", "", "," + _level("points", "items", "item", "poly_location.points", "point_no", _OBJECT)),
    "p5_languages": _table("langs", "lang_no", "lang prob", "", "," + _level("langs", "obj", "o", "image_info.lang_prob_map", "lang_no", "o IS NOT NULL")),
    "p5_object_types": _table("types", "type_no", "", _VALUE, "," + _level("types", "obj", "o", "image_info.detected_obj_type_list", "type_no", "o IS NOT NULL")),
}
