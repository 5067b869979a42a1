"""A strict JSON grammar (RFC 8259) that locates errors.

Descent over an explicit stack, so nesting depth is bounded by memory alone.
Numbers stay as written (class :class:`Number`), objects keep the last of
repeated members.
"""

from __future__ import annotations

import json
import re

from glyphmill.operators.row_grammar import Fault

_TOKEN = re.compile(
    r"[ \t\n\r]*+(?:"
    r'("[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+")'
    r"|([{}\[\]:,])"
    r"|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?)"
    r"|(true|false|null)|($))"
)
#: A member's name with its colon: the usual case, taken in one step.
_NAME = re.compile(r'[ \t\n\r]*+"([^"\\\x00-\x1f]*+)"[ \t\n\r]*+:')
_WORDS = {"true": True, "false": False, "null": None}


class Number(str):
    """A number as it was written."""

    __slots__ = ()


def parse(text: str, repeated: list[str] | None = None):
    """The value of ``text``; raises Fault with the offset of the first error.

    Names of members that an object holds more than once are put into ``repeated``.
    """
    nxt, name = _TOKEN.match, _NAME.match
    at = 0
    stack: list[tuple[object, str | None]] = []
    holder: object = None  # the open object or array
    key: str | None = None
    want = "value"
    while True:
        if (want == "key" or want == "key or close") and (m := name(text, at)):
            key, at, want = m.group(1), m.end(), "value"
        m = nxt(text, at)
        if m is None:
            raise Fault("syntax", "no JSON token", at)
        kind = m.lastindex
        at = m.end()
        if want == "end":
            if kind == 5:
                return holder
            raise Fault("syntax", "text follows the value", m.start(kind))
        if kind == 1:
            token = m.group(1)
            value = json.loads(token) if "\\" in token else token[1:-1]
            if want in ("key", "key or close"):
                key = value
                m = nxt(text, at)
                if m is None or m.group(2) != ":":
                    raise Fault("syntax", "a colon is missing", at)
                at = m.end()
                want = "value"
                continue
        elif kind == 2:
            token = m.group(2)
            if token in "{[" and want in ("value", "value or close"):
                stack.append((holder, key))
                if token == "{":
                    holder, want = {}, "key or close"
                else:
                    holder, want = [], "value or close"
                continue
            if token == "," and want == "comma or close":
                want = "key" if isinstance(holder, dict) else "value"
                continue
            is_object = isinstance(holder, dict)
            closes = token == ("}" if is_object else "]") and stack
            if not closes or want not in ("comma or close", "key or close" if is_object else "value or close"):
                raise Fault("syntax", f"unexpected {token}", m.start(2))
            value = holder
            holder, key = stack.pop()
            want = "value"
        elif kind == 3:
            value = Number(m.group(3))
        elif kind == 4:
            value = _WORDS[m.group(4)]
        else:
            raise Fault("syntax", "the text ends early", at)
        if want not in ("value", "value or close"):
            raise Fault("syntax", "a comma or a closing bracket is missing", m.start(kind))
        if not stack:
            holder, want = value, "end"
        elif isinstance(holder, dict):
            if repeated is not None and key in holder:
                repeated.append(key)
            holder[key] = value
            want = "comma or close"
            if text.startswith(",", at):
                at, want = at + 1, "key"
        else:
            holder.append(value)
            want = "comma or close"
            if text.startswith(",", at):
                at, want = at + 1, "value"


def _refuse(word: str):
    raise ValueError(f"{word} is no JSON")


_DECODER = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_refuse)


def quick(text: str):
    """The value of ``text``, from Python's own parser where that takes it; else :func:`parse` decides.

    For readers that want the value alone: no offsets, and repeated members are not named.
    """
    try:
        return _DECODER.decode(text)
    except (ValueError, RecursionError):
        return parse(text)


def dump(value) -> str:
    """JSON text of a parsed value, numbers as they were written."""
    out: list[str] = []
    todo: list[object] = [value]
    raw = object()
    while todo:
        x = todo.pop()
        if isinstance(x, tuple) and len(x) == 2 and x[0] is raw:
            out.append(x[1])
        elif isinstance(x, Number):
            out.append(str(x))
        elif isinstance(x, dict):
            todo.append((raw, "}"))
            for i, (k, v) in enumerate(reversed(x.items())):
                todo += [v, (raw, json.dumps(k) + ":")]
                if i < len(x) - 1:
                    todo.append((raw, ","))
            out.append("{")
        elif isinstance(x, list):
            todo.append((raw, "]"))
            for i, v in enumerate(reversed(x)):
                todo.append(v)
                if i < len(x) - 1:
                    todo.append((raw, ","))
            out.append("[")
        else:
            out.append(json.dumps(x))
    return "".join(out)
