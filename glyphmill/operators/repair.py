"""Repairs of lines: noise by lexicon, lines that cross, pieces that belong together, second readings."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.decode import LOG_ZERO
from glyphmill.operators.grouped import map_groups

LINE = ["page_id", "line_id"]


def noisy_words_removed(words: DataFrame, lines: DataFrame, lexicon: DataFrame, edge_only: bool = False) -> DataFrame:
    """Words of three characters or more that the lexicon does not hold, dropped from noisy lines.

    A line is noisy if it has no more known words of four characters than unknown
    characters, or more than two of those; a line that fills 0.6 of the image's
    height is left alone. With ``edge_only`` only lines at the upper or lower
    border of the image are looked at. ``lexicon`` is (word); words are compared in
    lower case, without what stands around them.
    """
    known = lexicon.select(F.lower("word").alias("_bare")).distinct().withColumn("_hit", F.lit(True))
    bare = F.lower(F.regexp_replace(F.coalesce("word_str", F.lit("")), "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", ""))
    at_edge = (F.col("box_top") <= 1) | (F.col("box_top") + F.col("hei") >= F.col("img_h") - 2)
    size = lines.select(*LINE, (F.col("hei") > 0.6 * F.col("img_h")).alias("_only"), at_edge.alias("_edge"))
    rows = words.withColumn("_bare", bare).join(known, "_bare", "left").join(size, LINE)
    hit, n = F.coalesce("_hit", F.lit(False)), F.length("_bare")
    w = Window.partitionBy(*LINE)
    rows = rows.withColumn("_long", F.count_if(hit & (n >= 4)).over(w)).withColumn("_noise", F.sum(F.when(hit, 0).otherwise(n)).over(w))
    noisy = ~F.col("_only") & ((F.col("_long") <= F.col("_noise")) | (F.col("_noise") > 2))
    if edge_only:
        noisy = noisy & F.col("_edge")
    return rows.filter(~(noisy & ~hit & (n >= 3))).select(*words.columns)


def crossing_lines(lines: list[dict]) -> list[list[int]]:
    """Groups of lines of a page (positions in the list) that are parts of one line.

    Lines are taken in order; each one still free gathers the later ones of its
    polarity that touch it along the line and share most of its height.
    """
    free = list(range(len(lines)))
    out = []
    while free:
        i = free.pop(0)
        x0, y0 = lines[i]["box_left"], lines[i]["box_top"]
        x1, y1 = x0 + lines[i]["wid"], y0 + lines[i]["hei"]
        group, rest = [i], []
        for j in free:
            b = lines[j]
            h, bh = y1 - y0, b["hei"]
            along = (x1 - x0) + b["wid"] - (max(x1, b["box_left"] + b["wid"]) - min(x0, b["box_left"]))
            across = h + bh - (max(y1, b["box_top"] + bh) - min(y0, b["box_top"]))
            least = min(h, bh)
            alike = (across > 0.7 * least and 0.5 * h < bh < 1.5 * h) or (across > 0.5 * least and 0.7 * h < bh < 1.3 * h)
            if b["is_black_wd"] == lines[i]["is_black_wd"] and along > -0.3 * least and alike:
                x0, y0 = min(x0, b["box_left"]), min(y0, b["box_top"])
                x1, y1 = max(x1, b["box_left"] + b["wid"]), max(y1, b["box_top"] + bh)
                group.append(j)
            else:
                rest.append(j)
        free = rest
        out.append(group)
    return out


def joined_crossing_lines(lines: DataFrame) -> DataFrame:
    """(page_id, line_id, first_line): each line with the first of its group."""
    def fn(g: list[dict]) -> list[dict]:
        return [{"page_id": g[i]["page_id"], "line_id": g[i]["line_id"], "first_line": g[group[0]]["line_id"]} for group in crossing_lines(g) for i in group]

    cols = ["page_id", "line_id", "box_left", "box_top", "wid", "hei", "is_black_wd"]
    return map_groups(lines.select(*cols), ["page_id"], ["line_id"], fn, "page_id string, line_id int, first_line int")


_EURO_PIECE = re.compile(r"[^\W\d_]+(?:[-'][^\W\d_]+)*|\d+(?:[-.]\d+)*(?:[^\W\d_]{1,3}(?![^\W\d_]))?|(?:[^\w]|_)+")


def split_european(word: str) -> list[tuple[str, int]]:
    """Pieces of a word where letters of any alphabet, digits and punctuation meet, with their offsets."""
    return [(m.group(), m.start()) for m in _EURO_PIECE.finditer(word)]


def merge_special(words: list[dict], mean_space: float) -> list[dict]:
    """A lone s behind an English word becomes 's; behind w w w all that follows closely is one address."""
    out: list[dict] = []
    address = False
    for i, w in enumerate(words):
        text = w["word_str"]
        if i and i + 1 < len(words) and all(x["word_str"].lower() == "w" for x in words[i - 1 : i + 2]):
            address = True
        english = i > 0 and len(words[i - 1]["word_str"]) > 1 and words[i - 1]["word_str"].isascii() and words[i - 1]["word_str"].isalpha()
        if out and text and (address or (text in ("s", "S") and english)):
            last = out[-1]
            if w["box_left"] <= last["box_left"] + last["wid"] + 2 * mean_space:
                right = max(last["box_left"] + last["wid"], w["box_left"] + w["wid"])
                left = min(last["box_left"], w["box_left"])
                out[-1] = dict(last, word_str=last["word_str"] + ("" if address else "'") + text, box_left=left, wid=right - left)
                continue
        out.append(dict(w))
    return out


def merge_known(words: list[dict], lexicon: set[str], mean_space: float) -> list[dict]:
    """Neighbours become one word if the lexicon holds it and neither half, or it and one half at a gap under 0.8 mean spaces."""
    out: list[dict] = []
    for w in words:
        if out:
            a, b = out[-1]["word_str"].lower(), w["word_str"].lower()
            gap = w["box_left"] - out[-1]["box_left"] - out[-1]["wid"]
            if a + b in lexicon and (not {a, b} & lexicon or gap < 0.8 * mean_space):
                out[-1] = dict(out[-1], word_str=out[-1]["word_str"] + w["word_str"], wid=w["box_left"] + w["wid"] - out[-1]["box_left"])
                continue
        out.append(dict(w))
    return out


def second_readings(best: list[int], matrix: list[float], labels: int, log_prob: float, shift: int = 2, quotes: frozenset[int] = frozenset()) -> list[tuple[list[int], float]]:
    """Readings by attention that differ in one character: (path, log probability).

    Frames hold ``shift`` labels more than paths, the second of them ending the
    string. A character is in doubt below 0.8, an apostrophe inside the word below
    0.4; its next best label needs more than 0.1. The label that ends the string is
    taken for the last character alone, which is then dropped.
    """
    out = []
    for j, k in enumerate(best):
        row = matrix[j * labels : (j + 1) * labels]
        first = row[k + shift]
        inside = 0 < j < len(best) - 1
        if first >= (0.4 if k in quotes and inside else 0.8):
            continue
        other = [(p, -i) for i, p in enumerate(row) if 0.1 < p < first - 0.001]
        if not other:
            continue
        p, i = max(other)
        i = -i
        change = (math.log(p) if p > 0 else LOG_ZERO) - (math.log(first) if first > 0 else LOG_ZERO)
        if shift <= i < labels - 1:
            out.append(([*best[:j], i - shift, *best[j + 1 :]], log_prob + change))
        elif i == shift - 1 and j == len(best) - 1:
            out.append((best[:-1], log_prob + change))
    return out


def char_boxes_by_frames(row: dict) -> list[dict]:
    """Boxes of a word's characters by the frames they were read in; the last one is as wide as the mean of the others."""
    spans = row["spans"]
    if not spans:
        return []
    frames = max(1, row["frames"])
    x = [row["box_left"] + row["wid"] * s // frames for s in spans]
    widths = [b - a for a, b in zip(x, x[1:])]
    right = row["box_left"] + row["wid"]
    last = min(right - x[-1], sum(widths) // len(widths)) if widths else right - x[-1]
    return [{"char_id": i, "box_left": a, "wid": max(1, w)} for i, (a, w) in enumerate(zip(x, [*widths, last]))]


def row_noise_removed(rects: list[dict], small: float = 0.3) -> list[dict]:
    """Boxes of one row without noise: those whose sides are both under ``small`` of the row's median height go,
    unless they stand above or below another box, as dots and accents do; boxes that share most of their width join."""
    if not rects:
        return []
    heights = sorted(r["hei"] for r in rects)
    size = heights[len(heights) // 2] * small
    out: list[dict] = []
    for r in sorted(rects, key=lambda r: (r["box_left"], r["box_top"])):
        tiny = r["wid"] < size and r["hei"] < size
        over = [o for o in rects if o is not r and min(o["box_left"] + o["wid"], r["box_left"] + r["wid"]) > max(o["box_left"], r["box_left"])]
        if tiny and not over:
            continue
        if out:
            last = out[-1]
            shared = min(last["box_left"] + last["wid"], r["box_left"] + r["wid"]) - max(last["box_left"], r["box_left"])
            if shared > 0.5 * min(last["wid"], r["wid"]):
                left, top = min(last["box_left"], r["box_left"]), min(last["box_top"], r["box_top"])
                right, low = max(last["box_left"] + last["wid"], r["box_left"] + r["wid"]), max(last["box_top"] + last["hei"], r["box_top"] + r["hei"])
                out[-1] = dict(last, box_left=left, box_top=top, wid=right - left, hei=low - top)
                continue
        out.append(dict(r))
    return out


def split_at_punctuation(path: list[int], spans: list[tuple[int, int]], punctuation: set[int], skipped: set[int] = frozenset()) -> list[tuple[list[int], int, int]]:
    """Sub-words of a word read frame by frame: (labels, first frame, last frame).

    Every punctuation label is a sub-word of its own; words that hold a label of
    ``skipped`` give none; a word of punctuation alone stays whole, once.
    """
    if not path or skipped & set(path):
        return []
    if all(k in punctuation for k in path):
        return [(list(path), spans[0][0], spans[-1][1])]
    out: list[tuple[list[int], int, int]] = []
    joined = False
    for k, (a, b) in zip(path, spans):
        if k in punctuation:
            out.append(([k], a, b))
            joined = False
        elif joined:
            out[-1] = ([*out[-1][0], k], out[-1][1], b)
        else:
            out.append(([k], a, b))
            joined = True
    return out


def read_label_stream(stream: list[int], separator: int = -1, shift: int = 2) -> list[list[int]]:
    """Label paths of a batch from one stream: results end at ``separator``; labels below ``shift`` (end and start marks) are dropped, an end mark ends a result."""
    out: list[list[int]] = [[]]
    ended = False
    for k in stream:
        if k == separator:
            out.append([])
            ended = False
        elif ended:
            continue
        elif k >= shift:
            out[-1].append(k - shift)
        elif k == shift - 1:
            ended = True
    if stream and stream[-1] == separator:
        out.pop()
    return out


def legacy_check_scores(word: str, suggestions: list[tuple[str, int]]) -> list[tuple[str, float]]:
    """Suggestions of a word with their scores 1 - d / (length + 5).

    An apostrophe is taken out before and put back after, a punctuation mark at the
    end is kept behind every suggestion.
    """
    core = word.rstrip(".,;:!?")
    tail = word[len(core) :]
    at = core.find("'") if core.count("'") == 1 else -1
    bare = core.replace("'", "") if at >= 0 else core
    out = []
    for text, d in suggestions:
        shown = text[:at] + "'" + text[at:] if 1 <= at <= len(text) else text
        out.append((shown + tail, 1 - d / (len(bare) + 5)))
    return out


def alternative_readings(words: list[dict], alternates: list[dict], least: float = -3.5) -> list[dict]:
    """Readings of whole lines by attention added to their words' candidates.

    An alternate joins a word if it has the same text without blanks, or is the
    word without one unsure character; those under ``least`` are left out, and each
    text is added once, with the greater log probability.
    """
    out = []
    for w in words:
        plain = w["word_str"].replace(" ", "")
        shorter = {plain[:i] + plain[i + 1 :] for i, p in enumerate(w.get("char_probs") or []) if p < (0.8 if i in (0, len(plain) - 1) else 0.4)}
        found: dict[str, float] = {}
        for a in alternates:
            text = a["word_str"].replace(" ", "")
            if a["log_prob"] >= least and (text == plain or text in shorter) and a["word_str"] != w["word_str"]:
                found[a["word_str"]] = max(found.get(a["word_str"], -1e9), a["log_prob"])
        out.append(dict(w, alternates=sorted(found.items(), key=lambda x: (-x[1], x[0]))))
    return out
