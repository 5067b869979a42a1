"""Valid records as typed rows, each of the others with its reason (problem 4).

Both operators keep every input row and every input column (a column that bears
an added name is replaced). Defined cases: a null delimited record counts as
the empty text (one field); a null result is neither valid nor failing; tables
may be empty; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from glyphmill.lineage import python_partitions
from glyphmill.operators import json_grammar, nested
from glyphmill.operators.arrow_map import append_columns
from glyphmill.operators.row_grammar import Fault, Record, RowGrammar

#: The nine fields of a dumped word, in order.
WORD_FIELDS = ["page_id", "line_id", "word_id", "left", "top", "wid", "hei", "text", "prob"]
WORD_TYPE = T.StructType(
    [T.StructField("page_id", T.StringType())]
    + [T.StructField(n, T.IntegerType()) for n in WORD_FIELDS[1:7]]
    + [T.StructField("text", T.StringType()), T.StructField("prob", T.DoubleType())]
)
FAULT_FIELDS = [
    T.StructField("reason", T.StringType()),
    T.StructField("fault_at", T.IntegerType()),
    T.StructField("fault", T.StringType()),
]
WORD_GRAMMAR = RowGrammar(9, r'(?:[^",\n]*|"[^"\n]*"),-?[0-9]+,-?[0-9]+,-?[0-9]+,')

_WHOLE = re.compile(r"-?[0-9]+")
_NUMBER = re.compile(r"-?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_LOW, _HIGH = -(2**31), 2**31 - 1


def _whole(field: str, name: str, least: int = _LOW) -> int:
    if not _WHOLE.fullmatch(field):
        raise Fault("value", f"{name} is not a whole number", 0)
    if len(field) > 10:  # leading zeros are no digits of the number
        field = field[: field[0] == "-"] + (field.lstrip("-").lstrip("0") or "0")
    value = int(field) if len(field) < 12 else _HIGH + 1
    if not max(least, _LOW) <= value <= _HIGH:
        raise Fault("value", f"{name} is out of range", 0)
    return value


def typed_word(fields: list[str]) -> dict:
    """The typed record of nine fields; raises Fault of kind value."""
    out: dict = {"page_id": fields[0]}
    for name, field in zip(WORD_FIELDS[1:7], fields[1:7]):
        out[name] = _whole(field, name, {"line_id": 0, "word_id": 0, "wid": 1, "hei": 1}.get(name, _LOW))
    if fields[7] == "":
        raise Fault("value", "the text is empty", 0)
    out["text"] = fields[7]
    prob = fields[8]
    if prob == "":
        out["prob"] = None
    elif _NUMBER.fullmatch(prob) and 0 <= float(prob) <= 1:
        out["prob"] = float(prob)
    else:
        raise Fault("value", "prob is not a number from 0 to 1", 0)
    return out


def _typed(record: Record) -> tuple[dict | None, Fault | None]:
    """The typed record, or why there is none."""
    if record.fault is not None:
        return None, record.fault
    try:
        return typed_word(record.fields), None
    except Fault as fault:
        fault.offset = record.start
        return None, fault


def parse_word_rows(df: DataFrame, raw: str = "raw", out: str = "word") -> DataFrame:
    """``df`` with ``out`` (the typed record, or null), ``reason``, ``fault_at`` and ``fault``.

    The rows of a batch are read as one dump whose anchors are known: after a broken
    quote reading resumes at the next row. ``reason`` is null for a valid record, else
    ``quoting``, ``columns`` or ``value``; ``fault_at`` is the offset of the error
    within the row, in code points.
    """
    added = T.StructType([T.StructField(out, WORD_TYPE), *FAULT_FIELDS])
    word_arrow = to_arrow_schema(T.StructType([added[0]]))[0].type

    def make():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            words, reasons, ats, faults = [], [], [], []
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(raw)).to_pylist()]
            anchors = list(accumulate((len(t) + 1 for t in texts[:-1]), initial=0))
            for record in WORD_GRAMMAR.dump("\n".join(texts), anchors):
                word, fault = _typed(record)
                words.append(word)
                reasons.append(fault.kind if fault else None)
                ats.append(fault.offset - record.start if fault else None)
                faults.append(fault.message if fault else None)
            return [pa.array(words, word_arrow), pa.array(reasons, pa.string()), pa.array(ats, pa.int32()), pa.array(faults, pa.string())]

        return compute

    return append_columns(df, added, make)


def parse_word_dump(df: DataFrame, text: str = "text") -> DataFrame:
    """One row for each record of ``text``, a whole dump with LF between records.

    Keeps the other columns and adds ``record_no``, ``start`` (offset), ``word``,
    ``reason``, ``fault_at`` and ``fault``. After a broken quote, reading resumes
    at the next validated record start.
    """
    kept = [f for f in df.schema if f.name != text and f.name not in {"record_no", "start", "word", "reason", "fault_at", "fault"}]
    schema = T.StructType(
        [*kept, T.StructField("record_no", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("word", WORD_TYPE), *FAULT_FIELDS]
    )
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                base = {f.name: row[f.name] for f in kept}
                for no, record in enumerate(WORD_GRAMMAR.dump(row[text] or "")):
                    word, fault = _typed(record)
                    rows.append(
                        base
                        | {"record_no": no, "start": record.start, "word": word}
                        | {"reason": fault and fault.kind, "fault_at": fault and fault.offset, "fault": fault and fault.message}
                    )
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(run, schema)


#: Rows of a dump that are put together at a time; a block begins at a row, so no record is cut.
BLOCK_ROWS = 4096


def read_dumps(df: DataFrame) -> DataFrame:
    """The word records of dumps whose pieces are rows (row_id, src_file, row_no, raw).

    The rows of a file are put together again in the order of row_no (ties: row_id),
    and read by the grammar, which finds the record starts itself. One row for each
    record: ``row_id``, ``src_file``, ``row_no`` and ``start`` (offset) of the piece in
    which it begins, ``word``, ``reason``, ``fault_at`` (offset from the record's start)
    and ``fault``. A file of any size is spread over blocks of BLOCK_ROWS row numbers.
    Repeated rows count once; a null raw is an empty line, which gives no record; rows
    without a file are one file, those without a number go by their id. Other columns are
    not looked at.
    """
    rows = df.select("row_id", "src_file", "row_no", F.coalesce("raw", F.lit("")).alias("raw")).distinct()
    block = (F.coalesce(F.col("row_no").cast("long"), F.col("row_id"), F.lit(0)) / BLOCK_ROWS).cast("long")
    rows = rows.withColumn("block", block)
    rows = rows.repartition(python_partitions(rows), "src_file", "block").sortWithinPartitions("src_file", "block", "row_no", "row_id", "raw")
    kept = [rows.schema[n] for n in ("row_id", "src_file", "row_no")]
    schema = T.StructType([*kept, T.StructField("start", T.IntegerType()), T.StructField("word", WORD_TYPE), *FAULT_FIELDS])
    arrow = to_arrow_schema(schema)

    def run(batches):
        pieces = (r for b in batches for r in b.to_pylist())
        for _, block in groupby(pieces, lambda r: (r["src_file"], r["block"])):
            held = list(block)
            starts = list(accumulate((len(r["raw"]) + 1 for r in held[:-1]), initial=0))
            out = []
            for record in WORD_GRAMMAR.dump("\n".join(r["raw"] for r in held)):
                word, fault = _typed(record)
                i = bisect_right(starts, record.start) - 1
                out.append(
                    {n: held[i][n] for n in ("row_id", "src_file", "row_no")}
                    | {"start": record.start - starts[i], "word": word, "reason": fault and fault.kind}
                    | {"fault_at": fault and fault.offset - record.start, "fault": fault and fault.message}
                )
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema)


# --- service responses ------------------------------------------------------------------------

_RECT = ("left", "top", "width", "height")


def _elements(value) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def _rect_faults(rect) -> tuple[bool, bool]:
    """(columns fault, value fault) of one rect."""
    if isinstance(rect, str) and not isinstance(rect, json_grammar.Number):
        members = rect.split(" ")
        if len(members) != 4:
            return True, False
    elif isinstance(rect, dict):
        if any(n not in rect for n in _RECT):
            return True, False
        members = [rect[n] for n in _RECT]
    else:
        return True, False
    for i, x in enumerate(members):
        if not isinstance(x, str) or not _WHOLE.fullmatch(x) or (i > 1 and (x[0] == "-" or not x.strip("0"))):
            return False, True
    return False, False


def check_response(tree) -> Fault | None:
    """The first fault of a parsed result: columns of any rect, then values."""
    bad_value = False
    for i, item in enumerate(_elements(tree.get("ret"))):
        if not isinstance(item, dict):
            continue
        holders = [item, *(c for c in _elements(item.get("charset")) if isinstance(c, dict))]
        for holder in holders:
            rect = holder.get("rect")
            if rect is None:
                continue
            columns, value = _rect_faults(rect)
            if columns:
                return Fault("columns", f"a rect of item {i} does not have four members", 0)
            bad_value |= value
    return Fault("value", "a member of a rect is no whole number or out of range", 0) if bad_value else None


def read_response(result: str, kind: str | None, quick: bool = False):
    """(JSON text, tree) of a result; raises Fault of kind syntax. In the text, of repeated members the last alone is left, unless ``quick``."""
    text = result
    if kind == "json_base64":
        try:
            text = base64.b64decode(result.encode("ascii"), validate=True).decode("utf-8")
        except (binascii.Error, UnicodeError, ValueError) as e:
            raise Fault("syntax", f"no base64 of UTF-8: {str(e)[:80]}", 0) from None
    repeated: list[str] = []
    tree = json_grammar.quick(text) if quick else json_grammar.parse(text, repeated)
    if not isinstance(tree, dict):
        raise Fault("syntax", "the value is not an object", 0)
    return json_grammar.dump(tree) if repeated else text, tree


def parse_responses(df: DataFrame, result: str = "result", kind: str = "result_type", text: str | None = None, pairs: str | None = None, quick: bool = False) -> DataFrame:
    """``df`` with ``reason`` (null if valid or if the result is null), ``fault_at`` and ``fault``.

    With ``text``, a column of that name gets the JSON text of a valid result
    (decoded from base64, and with the last of repeated members alone), else null;
    with ``pairs``, one of that name gets the (path, kind) pairs of a valid result that
    no row of the task had before, null if there are none. ``quick`` leaves valid results
    to Python's own parser, whose tree is the same, and faults without their offset.
    """
    pairs_type = T._parse_datatype_string(nested.PAIRS_TYPE)
    more = ([T.StructField(text, T.StringType())] if text else []) + ([T.StructField(pairs, pairs_type)] if pairs else [])
    added = T.StructType(FAULT_FIELDS + more)
    pairs_arrow = to_arrow_schema(T.StructType([T.StructField("p", pairs_type)]))[0].type

    def make():
        seen = nested.Seen()

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            reasons, ats, faults, texts, kinds_seen = [], [], [], [], []
            results = batch.column(batch.schema.get_field_index(result)).to_pylist()
            kinds = batch.column(batch.schema.get_field_index(kind)).to_pylist()
            for value, how in zip(results, kinds):
                fault, json_text, tree = None, None, None
                if value is not None:
                    try:
                        json_text, tree = read_response(value, how, quick)
                        fault = check_response(tree)
                    except Fault as f:
                        fault = f
                reasons.append(fault.kind if fault else None)
                ats.append(fault.offset if fault else None)
                faults.append(fault.message if fault else None)
                texts.append(None if fault else json_text)
                fresh = seen.grow(tree) if pairs and not fault and tree is not None else []
                kinds_seen.append([{"path": list(p), "kind": k} for p, k in fresh] or None)
            out = [pa.array(reasons, pa.string()), pa.array(ats, pa.int32()), pa.array(faults, pa.string())]
            return out + ([pa.array(texts, pa.string())] if text else []) + ([pa.array(kinds_seen, pairs_arrow)] if pairs else [])

        return compute

    return append_columns(df, added, make)
