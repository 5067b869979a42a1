"""Nested records as related flat tables (problem 5).

A column of JSON text becomes one table for the records and one for each array
level below them. Every row of a child table carries the surrogate key of its
parent row and its position in the array.

The merged schema is inferred over all rows: each path gets the kinds of value
seen there. A path that is an array in some record is an array level for all;
a single element that stands without its list is at position 0. Null elements
keep their position and give no row. Missing members become null.

All of it runs on Spark's VARIANT type: the text is parsed once, and the levels
are exploded in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.operators import json_grammar
from glyphmill.operators.row_grammar import Fault

#: A merged schema may have this many paths; beyond it, member names are data.
MAX_PATHS = 10_000


@dataclass
class Node:
    """A path of the merged schema: kinds of value seen, and members."""

    kinds: set[str] = field(default_factory=set)
    members: dict[str, Node] = field(default_factory=dict)

    @property
    def is_array(self) -> bool:
        return "array" in self.kinds

    def arrays(self, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
        """The array levels at or below this path, outer before inner."""
        out = [path] if self.is_array and path else []
        for name in sorted(self.members):
            out += self.members[name].arrays((*path, name))
        return out


#: Type of a column of (path, kind) pairs.
PAIRS_TYPE = "array<struct<path: array<string>, kind: string>>"


class Seen:
    """The (path, kind) pairs met so far, as a tree; ``grow`` names those that a value adds."""

    _KINDS = {dict: "object", list: "array", bool: "boolean", json_grammar.Number: "number", str: "string"}

    def __init__(self) -> None:
        self._root: tuple[set, dict, tuple] = (set(), {}, ())
        self._nodes = 0

    def grow(self, value) -> list[tuple[tuple[str, ...], str]]:
        out = []
        todo = [(self._root, value)]
        while todo:
            node, x = todo.pop()
            kind = self._KINDS.get(type(x))
            if kind == "object":
                members = node[1]
                for name, v in x.items():
                    child = members.get(name)
                    if child is None:
                        child = members[name] = (set(), {}, (*node[2], name))
                        self._nodes += 1
                    todo.append((child, v))
            elif kind == "array":
                todo += [(node, e) for e in x]
            if kind is not None and kind not in node[0]:
                node[0].add(kind)
                out.append((node[2], kind))
        if self._nodes > MAX_PATHS:
            raise ValueError("too many paths for a schema")
        return out


def merged(df: DataFrame, pairs: str) -> Node:
    """The merged schema of a column of pairs (of PAIRS_TYPE, see :class:`Seen`), over all rows.

    What comes to the driver is bounded by MAX_PATHS, else this raises.
    """
    rows = df.select(F.explode(pairs).alias("p")).select("p.path", "p.kind").distinct().limit(8 * MAX_PATHS + 1).collect()
    return _tree([(r.path, r.kind) for r in rows])


def _tree(pairs: list[tuple[list[str], str]]) -> Node:
    if len(pairs) > 8 * MAX_PATHS:
        raise ValueError("too many paths for a schema")
    root = Node()
    for path, kind in pairs:
        node = root
        for name in path:
            node = node.members.setdefault(name, Node())
        node.kinds.add(kind)
    return root


def levels_to(schema: Node, path: tuple[str, ...], single: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """The array levels of the merged schema down to ``path``, each relative to the one above.

    Members named in ``single`` count as levels even if all records hold single
    elements without their list. Ends early where no record has the next member.
    """
    out: list[tuple[str, ...]] = []
    step: tuple[str, ...] = ()
    node = schema
    for name in path:
        if name not in node.members:
            break
        node = node.members[name]
        step = (*step, name)
        if node.is_array or (name in single and node.kinds):
            out.append(step)
            step = ()
    return out


def infer(df: DataFrame, text: str) -> Node:
    """The merged schema of a column of JSON text, over all rows.

    Each task sends the distinct (path, kind) pairs it saw; what comes to the
    driver is bounded by MAX_PATHS, else this raises.
    """

    def run(batches):
        seen = Seen()
        pairs = []
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if value is not None:
                    try:
                        pairs += seen.grow(json_grammar.quick(value))
                    except Fault:
                        continue
        yield pa.RecordBatch.from_arrays(
            [pa.array([list(p) for p, _ in pairs], pa.list_(pa.string())), pa.array([k for _, k in pairs], pa.string())], names=["path", "kind"]
        )

    pairs = df.select(text).mapInArrow(run, "path array<string>, kind string").distinct().limit(8 * MAX_PATHS + 1).collect()
    return _tree([(r.path, r.kind) for r in pairs])


def _json_path(names: tuple[str, ...]) -> str:
    return "$" + "".join("['" + n.replace("\\", "\\\\").replace("'", "\\'") + "']" for n in names)


def elements(value: Column, names: tuple[str, ...]) -> Column:
    """The array at a path of a variant: a list as stored, a single element as a list of one, else empty."""
    at = F.try_variant_get(value, _json_path(names), "variant")
    listed = F.try_variant_get(value, _json_path(names), "array<variant>")
    none = F.array().cast("array<variant>")
    return F.when(at.isNull() | F.is_variant_null(at), none).otherwise(F.coalesce(listed, F.array(at)))


def explode_levels(df: DataFrame, value: str, levels: list[tuple[str, ...]], ordinals: list[str], node: str = "node") -> DataFrame:
    """All rows of all levels below the variant column ``value``, in one pass.

    ``levels`` holds the path of each array level, relative to its parent
    element; ``ordinals`` names its position column. Rows of level k have -1 in
    the ordinals below it; ``node`` is the element (a variant). Null elements
    give no row; the records themselves give none either. Other columns are kept; one
    that bears the name of an ordinal or of ``node`` is replaced. Null values and
    records without the members give no rows, repeated records repeated ones.
    """
    out = df.drop(*[c for c in ordinals if c != value])
    out = out.withColumn(node, F.col(value)).drop(value) if value != node else out
    last = None
    for path, ordinal in zip(levels, ordinals):
        self_row = F.array(F.struct(F.lit(-1).alias("at"), F.col(node).alias("v")))
        children = F.transform(elements(F.col(node), path), lambda v, i: F.struct(i.alias("at"), v.alias("v")))
        children = F.filter(children, lambda x: x["v"].isNotNull() & ~F.is_variant_null(x["v"]))
        if last is not None:  # rows of levels above stand for themselves alone
            children = F.when(F.col(last) >= 0, children).otherwise(F.filter(children, lambda x: F.lit(False)))
        others = [c for c in out.columns if c != node]
        out = out.select(*[F.col(f"`{c}`") for c in others], F.explode(F.concat(self_row, children)).alias("_level"))
        out = out.select(*[F.col(f"`{c}`") for c in others], F.col("_level.at").alias(ordinal), F.col("_level.v").alias(node))
        last = ordinal
    return out.filter(F.col(ordinals[0]) >= 0)


def is_level(schema: Node, path: tuple[str, ...], single: tuple[str, ...] = ()) -> bool:
    """Whether ``path`` is an array level; ``single`` as in :func:`levels_to`."""
    levels = levels_to(schema, path, single)
    return bool(levels) and sum(levels, ()) == path


def _scalar(value: str, path: tuple[str, ...], node: Node) -> Column:
    """The scalar at a path as a string; null where an object stands in its place, which has columns of its own."""
    text = F.try_variant_get(value, _json_path(path), "string")
    if "object" not in node.kinds:
        return text
    kind = F.schema_of_variant(F.try_variant_get(value, _json_path(path), "variant"))
    return F.when(~F.startswith(kind, F.lit("OBJECT")), text)


def _columns(value: str, schema: Node, path: tuple[str, ...], single: tuple[str, ...]) -> list[Column]:
    """A string column for each scalar below an element at ``path`` of the schema, objects of any depth flattened.

    Array levels have tables of their own. A name that is taken gets a "_".
    """
    top = schema
    for name in path:
        top = top.members[name]
    out: list[Column] = []
    taken: set[str] = set()
    todo = [((n,), top.members[n]) for n in sorted(top.members, reverse=True)]
    while todo:
        at, node = todo.pop()
        if node.is_array or is_level(schema, (*path, *at), single):
            continue
        if node.kinds - {"object"}:
            name = "_".join(at)
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            out.append(_scalar(value, at, node).alias(name))
        todo += [((*at, m), node.members[m]) for m in sorted(node.members, reverse=True)]
    return out


def with_key(df: DataFrame, key: str, text: str, out: str) -> DataFrame:
    """``df`` with the surrogate key ``out`` of its records: ``key`` as text, or for a null one "#" and a hash of ``text``.

    So records without a key that differ have keys of their own, and equal ones are one record.
    """
    return df.withColumn(out, F.coalesce(F.col(key).cast("string"), F.concat(F.lit("#"), F.sha2(F.col(text), 256))))


def child_table(df: DataFrame, key: str, value: str, path: tuple[str, ...], schema: Node, single: tuple[str, ...] = ()) -> DataFrame:
    """The table of the array level ``path`` below the variant column ``value``.

    Columns: ``parent_id`` (surrogate key of the parent row), ``row_id`` (its
    own), ``ordinal``, and one column for each scalar member at any depth, as a
    string, and ``value`` for elements that are not objects. Surrogate keys are the
    record's key (see :func:`with_key` where it may be null) and the positions down to the element, joined with "/", so they need
    no coordination between tasks and are the same in every run; a level that is a
    sibling of another has keys of its own. ``single`` as in :func:`levels_to`.
    """
    out = df.select(F.col(key).cast("string").alias("parent_id"), F.col(value).alias("node"))
    if not is_level(schema, path, single):
        raise ValueError(f"{path} is no array level")
    node = schema
    for name in path:
        node = node.members[name]
    for i, step in enumerate(levels_to(schema, path, single)):
        if i:
            out = out.withColumn("parent_id", F.concat_ws("/", "parent_id", F.col("ordinal").cast("string"))).drop("ordinal")
        out = out.select("parent_id", F.posexplode(elements(F.col("node"), step)).alias("ordinal", "node"))
        out = out.filter(F.col("node").isNotNull() & ~F.is_variant_null("node"))
    columns = _columns("node", schema, path, single)
    if node.kinds - {"array", "object"}:
        columns.append(_scalar("node", (), node).alias("value"))
    row_id = F.concat_ws("/", "parent_id", F.col("ordinal").cast("string")).alias("row_id")
    return out.select("parent_id", row_id, "ordinal", *columns)


def record_table(df: DataFrame, key: str, value: str, schema: Node, single: tuple[str, ...] = ()) -> DataFrame:
    """One row for each record: ``row_id`` and its scalar members at any depth, as strings."""
    return df.select(F.col(key).cast("string").alias("row_id"), *_columns(value, schema, (), single))


#: Depth and digits that Spark's JSON parser surely takes.
_DEEP, _DIGITS = 400, 300


def fitted(text: str, values: bool) -> str:
    """JSON text that Spark's parser takes in place of a text that it does not.

    Long numbers become strings of their digits, what is nested deeper than any
    level is left out; without ``values`` all strings are empty.
    """
    tree = json_grammar.parse(text)
    todo: list[tuple] = [(tree, 0)]
    while todo:
        at, depth = todo.pop()
        for k, x in list(at.items() if isinstance(at, dict) else enumerate(at)) if isinstance(at, (dict, list)) else ():
            if isinstance(x, json_grammar.Number):
                at[k] = x if len(x) < _DIGITS and "e" not in x.lower() else str.__str__(x)
            elif isinstance(x, str):
                at[k] = x if values else ""
            elif isinstance(x, (dict, list)):
                if depth < _DEEP:
                    todo.append((x, depth + 1))
                else:
                    x.clear()
    return json_grammar.dump(tree)


def to_variant(df: DataFrame, text: str, out: str = "value", values: bool = True) -> DataFrame:
    """``df`` with the JSON column ``text`` replaced by the variant ``out`` (null if null or no JSON).

    Spark's parser has limits of depth, digits and length that the grammar here has
    not. What it does not take is parsed here and given to it again as :func:`fitted`.
    Without ``values`` only the positions of elements are of use there. A text that
    is valid and still too large for a variant raises, so that no record is lost.
    """

    def again(t: str | None) -> str | None:
        try:
            return None if t is None else fitted(t, values)
        except Fault:
            return None

    # only texts that failed go to Python
    read = df.withColumn(out if out != text else "_value", F.try_parse_json(F.col(text)))
    value = F.col(out if out != text else "_value")
    read = read.withColumn("_again", F.udf(again, T.StringType(), useArrow=True)(F.when(value.isNull(), F.col(text))))
    too_large = F.raise_error(F.lit("a valid JSON text is too large for a variant")).cast("variant")
    second = F.when(F.col("_again").isNotNull(), F.coalesce(F.try_parse_json("_again"), too_large))
    read = read.withColumn("_value", F.coalesce(value, second)).drop("_again", *([text] if text != out else []))
    return read.drop(out).withColumnRenamed("_value", out)
