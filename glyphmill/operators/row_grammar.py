"""A recursive-descent grammar for delimited records that recovers from errors.

    dump    := record (LF record)*
    record  := field ("," field)*
    field   := quoted | plain
    quoted  := '"' (any character but '"' | '""')* '"'
    plain   := any characters but '"', "," and LF

A quote that is not where the grammar wants one makes a located fault. Reading
then resumes at the next *validated* record start, or anchor. Anchors are either
known, as the rows of a table are, or found: line starts behind which the leading
fields of a record really parse, so that text inside a broken quoted field is not
taken for a record. No record reaches beyond an anchor: a quote that a stray quote
closes some records later makes one fault, and the records between are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

_PLAIN = re.compile(r'[^",\n]*+')
_QUOTED = re.compile(r'"((?:[^"]++|"")*+)"')


class Fault(Exception):
    """A syntax error: its kind, what was wrong, and the offset in the text."""

    def __init__(self, kind: str, message: str, offset: int):
        super().__init__(message)
        self.kind, self.message, self.offset = kind, message, offset


@dataclass(slots=True)
class Record:
    """Fields of one record and where it stands; ``fault`` instead of fields if it could not be read."""

    start: int
    end: int
    fields: list[str] | None
    fault: Fault | None = None


class RowGrammar:
    """``width`` fields make a record; ``anchor`` matches the leading fields by which a record start is known."""

    def __init__(self, width: int, anchor: str):
        self.width = width
        self._anchor = re.compile(rf"\n(?={anchor})")

    def _field(self, text: str, at: int, limit: int) -> tuple[str, int]:
        if at < limit and text[at] == '"':
            m = _QUOTED.match(text, at, limit)
            if m is None:
                raise Fault("quoting", "a quoted field does not end", at)
            end = m.end()
            if end < limit and text[end] not in ",\n":
                raise Fault("quoting", "characters follow a closing quote", end)
            return m.group(1).replace('""', '"'), end
        end = _PLAIN.match(text, at, limit).end()
        if end < limit and text[end] == '"':
            raise Fault("quoting", "a quote stands inside a plain field", end)
        return text[at:end], end

    def _record(self, text: str, at: int, limit: int) -> tuple[list[str], int]:
        value, end = self._field(text, at, limit)
        fields = [value]
        while end < limit and text[end] == ",":
            value, end = self._field(text, end + 1, limit)
            fields.append(value)
        return fields, end

    def _width_fault(self, fields: list[str], end: int) -> Fault | None:
        return None if len(fields) == self.width else Fault("columns", f"{len(fields)} fields instead of {self.width}", end)

    def one(self, text: str) -> Record:
        """The record that ``text`` as a whole must be."""
        return next(self.dump(text, [0]))

    def dump(self, text: str, anchors: Sequence[int] | None = None) -> Iterator[Record]:
        """All records of a text that holds many, faulty ones too.

        ``anchors`` are all record starts, where they are known, in rising order; each
        gives a record, that of an empty line too. Without them, empty lines are skipped.
        """
        if anchors is not None:
            for i, at in enumerate(anchors):
                yield self._between(text, at, anchors[i + 1] - 1 if i + 1 < len(anchors) else len(text))
            return
        at, length = 0, len(text)
        while at < length:
            fields = None
            try:
                fields, end = self._record(text, at, length)
                fault = self._width_fault(fields, end)
                inner = self._whole_record(text, at, end)
                if inner is not None:
                    fault, end = Fault("quoting", "a quoted field holds a whole record", at), inner
            except Fault as f:
                fault = f
                m = self._anchor.search(text, at)
                end = m.start() if m else length
            if fields != [""] or end > at:
                yield Record(at, end, None if fault else fields, fault)
            at = end + 1

    def _between(self, text: str, at: int, limit: int) -> Record:
        """The record that stands from one known anchor to the next."""
        try:
            fields, end = self._record(text, at, limit)
            fault = Fault("quoting", "a line feed stands outside quotes", end) if end < limit else self._width_fault(fields, end)
        except Fault as f:
            fault = f
        return Record(at, limit, None if fault else fields, fault)

    def _whole_record(self, text: str, at: int, end: int) -> int | None:
        """The line end before the first whole record that stands inside a record of several lines."""
        while (m := self._anchor.search(text, at, end)) is not None:
            at = m.end()
            try:
                if len(self._record(text, at, len(text))[0]) == self.width:
                    return m.start()
            except Fault:
                pass
        return None
