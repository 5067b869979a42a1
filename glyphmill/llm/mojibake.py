"""Texts decoded with another encoding than they were written in (problem 8).

Characters are mapped back to the bytes of a legacy encoding. A byte-structure
automaton (the well-formed sequences of UTF-8, or of a two-byte set) finds the
maximal spans that are multibyte text, and only those spans are decoded anew;
the rest of the text stays. This is repeated until nothing more is found, which
undoes damage upon damage and damage of several kinds. Runs that were
written in one single-byte set and read in another are found by the same
mapping, and judged by how far the bytes read as words of the writer's script.

A text is affected if a span was restored, or if bytes were lost in decoding
(replacement characters), in which case it cannot be restored in full. Null,
empty and blank texts are not affected. A narrow operation without a shuffle.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glyphmill.operators.arrow_map import append_columns

#: Encodings in which UTF-8 bytes may have been read, the likelier first.
READ_AS = ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8-r"]
#: How much likelier (natural logarithm) a reading must be than what is shown: damage is rarer than sound text.
GBK_ODDS = 7.0
#: The same for words in one of two Cyrillic sets, in letters times the gain of :func:`_russian`.
SWAPPED_GAIN = 2.7

_NONE = "\ufffe"  # stands for a character without a byte

#: The automaton of UTF-8 on text whose characters are bytes: well-formed sequences of two to four bytes.
_UTF8 = re.compile(
    "(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    "|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)
_CYRILLIC_WORD = re.compile("[А-Яа-яЁё]{2,}")
_BOX = re.compile("[─-▟]")


def _byte_table(codec: str) -> dict[int, int]:
    """Character to byte for bytes from 0x80 on; undefined bytes of a code page stand for themselves."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            c = ord(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            c = b
        table.setdefault(c, b)
    return table


class _Bytes(dict):
    """For str.translate: ASCII stays, characters without a byte become _NONE."""

    def __missing__(self, c: int):
        return c if c < 0x80 else _NONE


_TABLES = {c: _Bytes(_byte_table(c)) for c in READ_AS}


def _pair_pattern(codec: str) -> re.Pattern:
    """A lead byte before a trail byte, as characters of ``codec``: without it there is no span."""
    chars = {b: chr(c) for c, b in _byte_table(codec).items()}
    both = ["".join(chars[b] for b in range(*r) if b in chars) for r in ((0xC2, 0xF5), (0x80, 0xC0))]
    return re.compile("[{}][{}]".format(*map(re.escape, both)))


_PAIRS = {c: _pair_pattern(c) for c in READ_AS}


def _plausible(c: str) -> bool:
    """Whether a decoded character belongs to what people write: European letters, signs, ideographs, symbols."""
    o = ord(c)
    return (
        0xA0 <= o <= 0x17F
        or 0x391 <= o <= 0x3C9
        or 0x400 <= o <= 0x45F
        or o in (0x490, 0x491, 0x192, 0x218, 0x219, 0x21A, 0x21B, 0x2C6, 0x2DC, 0xFEFF, 0xFFFD)
        or 0x2000 <= o <= 0x206F
        or 0x20A0 <= o <= 0x20BF
        or 0x2100 <= o <= 0x22FF
        or 0x2500 <= o <= 0x27BF
        or 0x3000 <= o <= 0x30FF
        or 0x4E00 <= o <= 0x9FFF
        or 0xFF00 <= o <= 0xFFEF
        or 0x1F300 <= o <= 0x1FAFF
        or 0xFE00 <= o <= 0xFE0F
    )


_CLOSING = "“”‘’„‚…–—›»™ "


def _accept(codec: str, text: str, start: int, end: int, decoded: str) -> bool:
    """Whether a well-formed span is damage and not chance."""
    # bytes of twice damaged text may decode to controls, but not on their own
    if not all(_plausible(c) or ("\x80" <= c <= "\x9f" and len(decoded) > 1) for c in decoded):
        return False
    seen = text[start:end]
    if len(decoded) == 1 and decoded >= "\u3000" and all(c in _CLOSING for c in seen[1:]):
        return False  # an accented letter before closing quotes
    before, after = text[start - 1 : start], text[end : end + 1]
    if codec == "cp1251":
        # a capital before a closing sign is ordinary Russian
        if len(decoded) == 1 and len(seen) == 2 and (seen[1] in "»„“”…–—’‘" or _CYRILLIC_WORD.match(before + before)) and seen[0] not in "РС":
            return False
        return not (len(decoded) == 1 and seen[0] in "РС" and seen[1] in "»„“”…–—’‘" and not _CYRILLIC_WORD.search(before + after))
    if codec in ("cp866", "koi8-r"):
        # lower-case Cyrillic words are well-formed sequences of ideographs
        if any(ord(c) >= 0x3000 for c in decoded) and not _BOX.search(seen):
            return False
        if len(decoded) == 1 and not _BOX.search(seen):
            return codec == "cp866" and decoded in "‘’“”–—…•€™†‡‰"
    if codec in ("cp437", "cp850", "cp866") and len(decoded) == 1 and _BOX.sub("", seen) == "":
        return not _BOX.match(before) and not _BOX.match(after)  # drawn lines
    if codec == "mac_roman" and len(decoded) == 1 and seen[0] in "–—“”‘’":
        return False
    if codec == "koi8-r" and len(decoded) == 1:
        return False
    return True


def _utf8_spans(codec: str, text: str) -> list[tuple[int, int, str]]:
    if not _PAIRS[codec].search(text):
        return []
    mapped = text.translate(_TABLES[codec])
    out = []
    for m in _UTF8.finditer(mapped):
        start, end = m.span()
        decoded = m.group().encode("latin-1").decode("utf-8")
        if _accept(codec, text, start, end, decoded):
            out.append((start, end, decoded))
            continue
        at = start  # single sequences of a span may still be damage
        for one in decoded:
            size = len(one.encode("utf-8"))
            if _accept(codec, text, at, at + size, one):
                out.append((at, at + size, one))
            at += size
    return out


# --- UTF-8 read in a two-byte set ------------------------------------------------------------

#: A lead byte of UTF-8 is shown as one of these, whatever byte follows.
_IDEOGRAPH = re.compile("[\u3400-\u9fff\ue000-\ufaff\U00020000-\U0010ffff]")
#: Without such a sequence no ideograph can come out.
_THREE_BYTES = re.compile("[\xe3-\xe9][\x80-\xbf]{2}")
_WIDE_RUN = re.compile("[¤-￥\U000e0000-\U0010ffff\x80]+[\x20-\x7e]?")


@lru_cache(30_000)
def _ideograph(c: str) -> float:
    """Log probability of a character of Chinese text, by its place in the set: common, less common, or neither."""
    try:
        lead = c.encode("gb2312")[0]
    except UnicodeEncodeError:
        return -14.2 if c != "\ufffd" else -7.0  # one in a hundred, of 15,000
    if lead >= 0xD8:
        return -10.4  # one in eleven, of 3,008
    return -8.3 if lead >= 0xB0 else -6.5  # nine in ten, of 3,755; signs


def _gbk_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if not _IDEOGRAPH.search(text):
        return out
    for m in _WIDE_RUN.finditer(text):
        start, run = m.start(), m.group()
        if not _IDEOGRAPH.search(run):
            continue
        # most runs hold no span at all: look at the run as a whole first
        whole = run.replace("\ufffd", "\x7f").encode("gb18030", "replace").decode("latin-1")
        if not _THREE_BYTES.search(whole) and not _latin_context(text, start, start + len(run)):
            continue
        data, ends = bytearray(), []
        for c in run:
            try:
                data += c.encode("gb18030") if c != "\ufffd" else b"\xff"
            except UnicodeEncodeError:
                data += b"\xff"
            ends.append(len(data))
        seen = bytes(data).decode("latin-1")
        for s in _UTF8.finditer(seen):
            b0, b1 = s.span()
            decoded = s.group().encode("latin-1").decode("utf-8")
            hanzi = sum("一" <= c <= "鿿" or c in "、。" for c in decoded)
            latin = all(0xC0 <= ord(c) <= 0x17F or 0x2013 <= ord(c) <= 0x2026 or c in "£§©°±¶¿·½×" for c in decoded)
            # whole characters only: a span may begin or end within one
            i0 = next((i for i in range(len(ends)) if (ends[i - 1] if i else 0) >= b0), None)
            i1 = max((i + 1 for i in range(len(ends)) if ends[i] <= b1), default=0)
            if i0 is None or i1 <= i0:
                continue
            if hanzi >= 0.9 * len(decoded):  # the longer the span, the surer
                if sum(map(_ideograph, decoded)) < sum(map(_ideograph, run[i0:i1])) + GBK_ODDS:
                    continue
            elif not (latin and _latin_context(text, start, start + len(run))):
                continue
            piece = bytes(data[(ends[i0 - 1] if i0 else 0) : ends[i1 - 1]])
            out.append((start + i0, start + i1, piece.decode("utf-8", "replace")))
    return out


def _latin_context(text: str, start: int, end: int) -> bool:
    """A short run of ideographs that touches ASCII letters on either side."""
    if end - start > 4:
        return False
    touch = text[start - 1 : start] + text[end : end + 1] + (text[end - 1 : end] if text[end - 1 : end].isascii() else "")
    return any(c.isascii() and c.isalpha() for c in touch)


# --- one single-byte set read in another -----------------------------------------------------

#: Letters of Russian by frequency.
_FREQUENT = "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё"
_RANK = {c: i for i, c in enumerate(_FREQUENT)}


def _russian(word: str) -> float:
    """How much a run of Cyrillic letters looks like Russian: near 0 for ordinary words, above 1 for noise."""
    low = word.lower()
    score = sum(_RANK.get(c, 40) for c in low) / (8.0 * len(low))
    body = word[1:]
    if body and sum(c.isupper() for c in body) > len(body) / 2:
        score += 0.35
    if word[0].islower() and any(c.isupper() for c in body):
        score += 0.35
    return score


_WESTERN = _Bytes(_byte_table("cp1252") | {b: b for b in range(0x80, 0xA0)})
_WESTERN_RUN = re.compile("[{}]{{3}}".format(re.escape("".join(map(chr, _WESTERN)))))


def _as_cyrillic(run: bytes, codec: str) -> str | None:
    """A run of bytes in a Cyrillic set, if it reads as Russian words there."""
    try:
        decoded = run.decode(codec)
    except UnicodeDecodeError:
        return None
    words = _CYRILLIC_WORD.findall(decoded)
    letters = sum(map(len, words))
    if letters < 0.8 * len(decoded) or sum(_russian(w) * len(w) for w in words) >= 1.2 * letters:
        return None
    return decoded


def _as_chinese(run: bytes, codec: str) -> str | None:
    """A run of bytes in a Chinese set, if nearly all of it is ideographs, most of them common."""
    if len(run) < 4:
        return None
    decoded = run.decode(codec, "replace")
    hanzi = sum("一" <= c <= "鿿" or c in "、。" for c in decoded)
    common = sum(0xB0 <= b <= 0xD7 or b == 0xA1 for b in run[::2])
    return decoded if hanzi >= 0.8 * len(decoded) and common >= 0.5 * (len(run) // 2) else None


def _high_runs(text: str) -> list[tuple[int, int, str]]:
    """Runs of upper bytes, read in a Western set, that are Cyrillic or Chinese in another.

    The set is the one in which most of the runs of three bytes or more read as
    words; the other runs of letters follow it, short ones if they touch no Latin letter.
    """
    if not _WESTERN_RUN.search(text):
        return []
    mapped = text.translate(_WESTERN)
    runs = [(m.start(), m.end(), m.group().encode("latin-1")) for m in re.finditer("[\x80-\xff]+", mapped)]
    best: tuple[float, str, list] = (0.0, "", [])
    for codec, read in (("cp1251", _as_cyrillic), ("cp866", _as_cyrillic), ("koi8-r", _as_cyrillic), ("gb18030", _as_chinese)):
        found = [(s, e, d) for s, e, run in runs if len(run) >= 3 and len(set(run)) >= 3 and (d := read(run, codec)) is not None]
        weight = float(sum(e - s for s, e, _ in found))
        if read is _as_cyrillic and found:  # of several readings the most Russian one
            text_of = "".join(d for _, _, d in found)
            weight *= 2.0 - min(1.5, _russian("".join(_CYRILLIC_WORD.findall(text_of)).lower()))
        if weight > best[0]:
            best = (weight, codec, found)
    _, codec, found = best
    if found and codec != "gb18030":
        known = {s for s, _, _ in found}
        for s, e, run in runs:
            touches = text[s - 1 : s] + text[e : e + 1]
            decoded = run.decode(codec, "replace")
            words = _CYRILLIC_WORD.findall(decoded * 2)
            if s not in known and sum(map(len, words)) >= 1.6 * len(decoded) and (len(run) >= 3 or not any(c.isascii() and c.isalpha() for c in touches)):
                found.append((s, e, decoded))
    return found


_MIXED = re.compile("[A-Za-zÀ-ÿ]*[A-Za-z][А-яЁёЂ-џҐґ]{1,2}(?=[A-Za-z]|\\b)|\\b[А-яЁёЂ-џҐґ]{1,2}[A-Za-z]{2,}")
_SIGN = re.compile("(?<![А-яЁёЂ-џ])[ЂЈҐўЎЅЄЯ](?=[0-9]{1,6}(?![0-9А-яЁё]))|(?<=[0-9])[ЂЅ](?![А-яЁё0-9])|(?<![А-яЁё])ї(?=[A-Z])")
_MIXED_OR_SIGN = re.compile("[A-Za-z][А-яЁёЂ-џҐґ]|[А-яЁёЂ-џҐґ][A-Za-z]|[ЂЈҐўЎЅЄЯ][0-9]|[0-9][ЂЅ]|ї[A-Z]")
#: Text in the other of two Cyrillic sets has capitals within words, or letters that Russian lacks.
_ODD_CYRILLIC = re.compile("[а-яё][А-ЯЁ]|[А-ЯЁ]{3}|[Ѐ-ЏѐђѓєѕіїјљњћќўџҐґѢ-ӿ]")
_CYR = re.compile("[Ѐ-ӿ]+")
_BACK = {b: bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0x100)}


def _western_in_cyrillic(text: str) -> list[tuple[int, int, str]]:
    """Accented letters and signs of Western text that were read in cp1251: Cyrillic inside Latin words."""
    if not _MIXED_OR_SIGN.search(text):
        return []
    to_byte = _TABLES["cp1251"]
    out = []
    for pattern in (_MIXED, _SIGN):
        for m in pattern.finditer(text):
            for c in _CYR.finditer(text, m.start(), m.end()):
                back = [_BACK.get(b) if isinstance(b := to_byte[ord(x)], int) else None for x in c.group()]
                if None in back or "\ufffd" in back:
                    continue
                if pattern is _MIXED and not all(x.isalpha() for x in back):
                    continue
                out.append((c.start(), c.end(), "".join(back)))
    return sorted(set(out))


def _swapped_cyrillic(text: str) -> list[tuple[int, int, str]]:
    """Cyrillic runs that are Russian only when read in the other of two Cyrillic sets."""
    if not _ODD_CYRILLIC.search(text):
        return []
    words = [m for m in re.finditer("[Ѐ-ӿ]+", text)]
    odd = [m for m in words if len(m.group()) >= 3 and _russian(m.group()) > 0.85]
    if not odd:
        return []
    out = []
    for read, written in (("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("iso8859-5", "cp1251"), ("mac_cyrillic", "cp1251")):
        found = []
        for m in odd:
            try:
                other = m.group().encode(read).decode(written)
            except UnicodeError:
                continue
            if _CYRILLIC_WORD.fullmatch(other) and _russian(other) < 1.0 and _russian(m.group()) - _russian(other) > 0.45:
                found.append((m.start(), m.end(), other))
        if sum(len(f[2]) for f in found) > sum(len(f[2]) for f in out):
            out = found
    # one short word may be chance
    return out if sum(len(new) * (_russian(text[a:b]) - _russian(new)) for a, b, new in out) >= SWAPPED_GAIN else []


def _apply(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, new in sorted(spans):
        if start >= at:
            out += [text[at:start], new]
            at = end
    return "".join([*out, text[at:]])


_SUSPECT = re.compile("[^\x00-\x7f]")


def restore(text: str | None) -> tuple[bool, str | None, list[str]]:
    """(affected, text with the damaged spans restored, what was undone in each round).

    A round undoes the encoding that covers most of the text, as spans of others
    may be chance until it is gone. It ends when no finder has a span, or when a
    round would lead back to a text that was there before.
    """
    if not text or not _SUSPECT.search(text):
        return False, text, []
    steps: list[str] = []
    met = {text}
    while True:
        best_name, new = "", text
        finders = [(f"utf-8 read as {c}", _utf8_spans, c) for c in READ_AS]
        finders += [("utf-8 read as gbk", _gbk_spans, None), ("upper bytes read as cp1252", _high_runs, None)]
        found = [(name, find(codec, text) if codec else find(text)) for name, find, codec in finders]
        found.sort(key=lambda f: -sum(end - start for start, end, _ in f[1]))
        for name, spans in found:
            if spans and (changed := _apply(text, spans)) not in met:
                best_name, new = name, changed
                break
        if not best_name:
            for name, find in (("cp1252 read as cp1251", _western_in_cyrillic), ("one Cyrillic set read as another", _swapped_cyrillic)):
                spans = find(text)
                if spans and (changed := _apply(text, spans)) not in met:
                    best_name, new = name, changed
                    break
        if not best_name:
            break
        text = new
        met.add(text)
        steps.append(best_name)
    if "\ufffd" in text:
        steps.append("bytes lost")
    return bool(steps), text, steps


def find_damage(df: DataFrame, text: str = "text", affected: str = "affected", restored: str = "restored", steps: str = "steps") -> DataFrame:
    """``df`` with ``affected``, ``restored`` (the text, repaired where it can be) and ``steps``.

    Null, empty and blank texts are not affected and stay as they are. Every row and
    every other column is kept, repeated rows give repeated results, and a column
    that bears an added name is replaced. Of readings that cover equally much of a
    text the first of READ_AS is taken.
    """
    added = T.StructType(
        [T.StructField(affected, T.BooleanType()), T.StructField(restored, T.StringType()), T.StructField(steps, T.ArrayType(T.StringType()))]
    )

    def make():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [restore(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            return [
                pa.array([r[0] for r in rows], pa.bool_()),
                pa.array([r[1] for r in rows], pa.string()),
                pa.array([r[2] for r in rows], pa.list_(pa.string())),
            ]

        return compute

    return append_columns(df, added, make)
