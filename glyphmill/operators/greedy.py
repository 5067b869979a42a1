"""Operators whose result depends on the order of steps, done exactly, group by group.

Each has a plain function on the rows of one group, which the tests call, and a
DataFrame operator around it. Boxes are box_left, box_top, wid, hei.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.grouped import map_groups

LINE = ["page_id", "line_id"]
_WORD = "page_id string, line_id int, word_id int, word_str string, box_left int, wid int, log_prob double"


def _shared(a: dict, b: dict, left: str = "box_left", wid: str = "wid") -> int:
    """Pixels that two spans share; 0 or less where they lie apart."""
    return a[wid] + b[wid] - (max(a[left] + a[wid], b[left] + b[wid]) - min(a[left], b[left]))


def suppress(words: list[dict], punctuation_needs_same_text: bool = False) -> list[dict]:
    """Of two overlapping words the less sure one goes, pair by pair in order.

    A word that is gone is not taken as first of a pair any more, but still beats
    or loses as second; one that goes while it is first keeps comparing. Ties keep
    the earlier. Overlap counts from a quarter of both widths, for two punctuation
    marks from one pixel.
    """
    alive = [True] * len(words)
    for i, a in enumerate(words):
        if not alive[i]:
            continue
        for j in range(i + 1, len(words)):
            b = words[j]
            least = (a["wid"] + b["wid"]) / 4.0
            if a["lc_type"] == 3 and b["lc_type"] == 3 and (not punctuation_needs_same_text or a["word_str"] == b["word_str"]):
                least = 1
            if _shared(a, b) > max(least, 0):
                alive[j if _sure(a) >= _sure(b) else i] = False
    return [w for w, keep in zip(words, alive) if keep]


def _sure(word: dict) -> float:
    """Log probability; unset (null or 1) counts as the least sure."""
    p = word["log_prob"]
    return -1e9 if p is None or p == 1.0 else p


def suppress_overlaps(words: DataFrame, punctuation_needs_same_text: bool = False) -> DataFrame:
    """:func:`suppress` on every line, words in the order of word_id."""
    cols = ["page_id", "line_id", "word_id", "word_str", "box_left", "wid", "log_prob", "lc_type"]
    return map_groups(words.select(*cols), LINE, ["word_id"], lambda g: suppress(g, punctuation_needs_same_text), _WORD + ", lc_type int")


def dominated_removed(words: DataFrame) -> DataFrame:
    """The set-based relative of :func:`suppress_overlaps`: every word goes that overlaps a surer one.

    A plain anti join; it differs from the exact operator in chains of overlaps.
    """
    sure = F.when(F.col("log_prob").isNull() | (F.col("log_prob") == 1.0), -1e9).otherwise(F.col("log_prob"))
    rows = words.select("page_id", "line_id", "word_id", "word_str", "box_left", "wid", "log_prob", "lc_type", sure.alias("sure"))
    a, b = rows.alias("a"), rows.alias("b")
    shared = F.col("a.wid") + F.col("b.wid") - (
        F.greatest(F.col("a.box_left") + F.col("a.wid"), F.col("b.box_left") + F.col("b.wid")) - F.least("a.box_left", "b.box_left")
    )
    least = F.when((F.col("a.lc_type") == 3) & (F.col("b.lc_type") == 3), 1.0).otherwise((F.col("a.wid") + F.col("b.wid")) / 4.0)
    surer = (F.col("b.sure") > F.col("a.sure")) | ((F.col("b.sure") == F.col("a.sure")) & (F.col("b.word_id") < F.col("a.word_id")))
    same = (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.line_id") == F.col("b.line_id")) & (F.col("a.word_id") != F.col("b.word_id"))
    return a.join(b, same & (shared > least) & surer, "left_anti").drop("sure")


def merge_duplicates(words: list[dict]) -> list[dict]:
    """Equal words that overlap become one at their mean place.

    Chinese ones must share 0.6 of the narrower box, others need only touch. The
    log probability is the greatest so far divided by the size of the group, once
    for each member, as in the reference.
    """
    gone = [False] * len(words)
    out = []
    for i, a in enumerate(words):
        if gone[i]:
            continue
        members = [a]
        for j in range(i + 1, len(words)):
            b = words[j]
            if gone[j] or a["word_str"] != b["word_str"]:
                continue
            ratio = (a["wid"] + b["wid"] - (max(a["box_left"] + a["wid"], b["box_left"] + b["wid"]) - min(a["box_left"], b["box_left"]) + 1)) / max(1, min(a["wid"], b["wid"]))
            if ratio >= (0.6 if a["lc_type"] == 0 else 0.0):
                gone[j] = True
                members.append(b)
        row = dict(a, copies=len(members))
        if len(members) > 1:
            n = len(members)
            log_prob = a["log_prob"]
            for m in members:
                known = [x for x in (log_prob, m["log_prob"]) if x is not None]
                log_prob = max(known) / n if known else None
            centre = sum(m["box_left"] + m["wid"] / 2.0 for m in members) / n
            width = sum(m["wid"] for m in members) / n
            row |= {"box_left": int(centre - width / 2), "wid": int(width), "log_prob": log_prob}
        out.append(row)
    return out


def merged_duplicates(words: DataFrame) -> DataFrame:
    cols = ["page_id", "line_id", "word_id", "word_str", "box_left", "wid", "log_prob", "lc_type"]
    return map_groups(words.select(*cols), LINE, ["word_id"], merge_duplicates, _WORD + ", lc_type int, copies int")


def merge_lines(words: list[dict]) -> list[dict]:
    """Words of overlapping lines of a page, the less sure of two that overlap both ways being dropped."""
    lines: dict[int, list[dict]] = {}
    for w in words:
        lines.setdefault(w["line_id"], []).append(w)
    ids = sorted(lines)

    def box(ws: list[dict]) -> tuple[int, int, int, int]:
        return min(w["box_left"] for w in ws), min(w["box_top"] for w in ws), max(w["box_left"] + w["wid"] for w in ws), max(w["box_top"] + w["hei"] for w in ws)

    boxes = {i: box(lines[i]) for i in ids}
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = boxes[i], boxes[j]
            if min(a[2], b[2]) <= max(a[0], b[0]) or min(a[3], b[3]) <= max(a[1], b[1]):
                continue
            lose_a, lose_b = set(), set()
            for x, p in enumerate(lines[i]):
                for y, q in enumerate(lines[j]):
                    wide, high = _shared(p, q), _shared(p, q, "box_top", "hei")
                    if wide > (p["wid"] + q["wid"]) / 4.0 and high > (p["hei"] + q["hei"]) / 4.0:
                        (lose_b if _sure(p) >= _sure(q) else lose_a).add(y if _sure(p) >= _sure(q) else x)
            lines[i] = [w for x, w in enumerate(lines[i]) if x not in lose_a]
            lines[j] = [w for y, w in enumerate(lines[j]) if y not in lose_b]
    return [w for i in ids for w in lines[i]]


def merged_lines(words: DataFrame) -> DataFrame:
    cols = ["page_id", "line_id", "word_id", "word_str", "box_left", "box_top", "wid", "hei", "log_prob"]
    return map_groups(words.select(*cols), ["page_id"], ["line_id", "word_id"], merge_lines, "page_id string, line_id int, word_id int, word_str string, box_left int, box_top int, wid int, hei int, log_prob double")


def group_into_lines(words: list[dict]) -> list[dict]:
    """Words from left to right; each line takes the next word whose vertical centre lies within its last word."""
    rest = sorted(words, key=lambda w: (w["box_left"], w["line_id"], w["word_id"]))
    out, number = [], 0
    while rest:
        last, left = None, []
        for w in rest:
            if last is None or last["box_top"] <= w["box_top"] + w["hei"] / 2.0 <= last["box_top"] + last["hei"]:
                out.append({"page_id": w["page_id"], "line_id": w["line_id"], "word_id": w["word_id"], "found_line": number})
                last = w
            else:
                left.append(w)
        rest = left
        number += 1
    return out


def words_to_lines(words: DataFrame) -> DataFrame:
    cols = ["page_id", "line_id", "word_id", "box_left", "box_top", "wid", "hei"]
    return map_groups(words.select(*cols), ["page_id"], ["line_id", "word_id"], group_into_lines, "page_id string, line_id int, word_id int, found_line int")


# --- reading order ---------------------------------------------------------------------------


def reads_before(a: dict, b: dict, direction: int = 0) -> bool:
    """Whether box ``a`` is read before ``b`` on a page turned by ``direction`` quarter turns.

    Boxes that share 0.3 of the narrower one across the lines go by their place
    along the page; boxes whose middle bands (0.2 to 0.8 of their height) lie apart
    go by those bands, and others by their place in the row. The relation is not
    transitive, so the order depends on how it is sorted by.
    """
    ax0, ay0, ax1, ay1 = a["box_left"], a["box_top"], a["box_left"] + a["wid"] - 1, a["box_top"] + a["hei"] - 1
    bx0, by0, bx1, by1 = b["box_left"], b["box_top"], b["box_left"] + b["wid"] - 1, b["box_top"] + b["hei"] - 1
    # (start, end) along the lines, and across them in reading order
    if direction == 0:
        along, across = ((ax0, ax1), (bx0, bx1)), ((ay0, ay1), (by0, by1))
        row = ax0 < bx0
    elif direction == 1:
        along, across = ((ay0, ay1), (by0, by1)), ((ax0, ax1), (bx0, bx1))
        row = ay1 > by1
    elif direction == 2:
        along, across = ((ax0, ax1), (bx0, bx1)), ((-ay1, -ay0), (-by1, -by0))
        row = ax1 > bx1
    else:
        along, across = ((ay0, ay1), (by0, by1)), ((-ax1, -ax0), (-bx1, -bx0))
        row = ay0 < by0
    (a0, a1), (b0, b1) = along
    shared = min(a1 - b0, b1 - a0)
    if shared > 0 and shared > 0.3 * min(a1 - a0, b1 - b0):
        return across[0][0] < across[1][0]
    ah, bh = across[0][1] - across[0][0] + 1, across[1][1] - across[1][0] + 1
    if across[0][0] + 0.2 * ah > across[1][0] + 0.8 * bh:
        return False
    if across[0][0] + 0.8 * ah < across[1][0] + 0.2 * bh:
        return True
    return row


def pivot_sort(items: list, before: Callable[[dict, dict], bool]) -> list:
    """Quicksort around the first item of a range, with the hole moving from both ends.

    Which order comes out of a relation that is not transitive depends on exactly
    these steps; the ranges are kept on a stack of our own.
    """
    a = list(items)
    todo = [(0, len(a) - 1)]
    while todo:
        low, high = todo.pop()
        if low >= high:
            continue
        i, j, pivot = low, high, a[low]
        while i < j:
            while i < j and not before(a[j], pivot):
                j -= 1
            a[i] = a[j]
            i += i < j
            while i < j and not before(pivot, a[i]):
                i += 1
            a[j] = a[i]
            j -= i < j
        a[i] = pivot
        todo += [(i + 1, high), (low, i - 1)]
    return a


def order_page(boxes: list[dict]) -> list[dict]:
    """The reading order of a page's lines: sorted by their box written as text first, then by :func:`pivot_sort`."""
    def as_text(b: dict) -> str:
        return f"{b['box_left']}_{b['box_top']}_{b['box_left'] + b['wid'] - 1}_{b['box_top'] + b['hei'] - 1}_{b['n_words']}"

    first = sorted(boxes, key=lambda b: (as_text(b), b["line_id"]))
    turn = boxes[0]["direction"] if boxes else 0
    ordered = pivot_sort(first, lambda a, b: reads_before(a, b, turn))
    return [{"page_id": b["page_id"], "line_id": b["line_id"], "place": i} for i, b in enumerate(ordered)]


def reading_order(lines: DataFrame) -> DataFrame:
    """``lines`` has page_id, line_id, a box, n_words and direction; gives the place of each line on its page."""
    cols = ["page_id", "line_id", "box_left", "box_top", "wid", "hei", "n_words", "direction"]
    return map_groups(lines.select(*cols), ["page_id"], ["line_id"], order_page, "page_id string, line_id int, place int")


# --- layout ----------------------------------------------------------------------------------


def push_down(rows: list[dict], ahead: int = 3) -> list[dict]:
    """Lines of a page moved so that their real heights do not overlap the lines that follow.

    A line that overlaps by more than half and begins within a mean height of the
    other's right edge moves right by that mean, others move down. At first only
    ``ahead`` followers are looked at (with the height of the next one for the mean,
    as in the reference), for the last lines all. At the end no line has moved less
    than the one before it.
    """
    at = [dict(r) for r in rows]
    high = [r["real_height"] or r["hei"] for r in rows]
    n = len(at)
    times = max(0, n - ahead)

    def move(i: int, j: int, mean: int) -> None:
        a, b = at[i], at[j]
        right = a["box_left"] + a["wid"]
        if not (a["box_top"] + high[i] > b["box_top"] and right > b["box_left"]):
            return
        over = a["box_top"] + high[i] - b["box_top"]
        if over > mean * 0.5 and right - b["box_left"] < mean:
            b["box_left"] += mean
        else:
            b["box_top"] += over

    for i in range(times):
        for j in range(i + 1, i + 1 + ahead):
            move(i, j, (high[i] + high[i + 1]) // 2)
    for i in range(times, n - 1):
        for j in range(i + 1, n):
            move(i, j, (high[i] + high[j]) // 2)
    for i in range(n - 1):
        moved = at[i]["box_top"] - rows[i]["box_top"]
        if at[i + 1]["box_top"] - rows[i + 1]["box_top"] < moved:
            at[i + 1]["box_top"] = rows[i + 1]["box_top"] + moved
    return [{k: r[k] for k in ("page_id", "line_id", "box_left", "box_top")} for r in at]


def pushed_down(lines: DataFrame) -> DataFrame:
    cols = ["page_id", "line_id", "box_left", "box_top", "wid", "hei", "real_height"]
    return map_groups(lines.select(*cols), ["page_id"], ["line_id"], push_down, "page_id string, line_id int, box_left int, box_top int")


def stitch(words: list[dict]) -> list[dict]:
    """Words of overlapping tiles of a line put together: each tile gives those between the last word kept and the next tile."""
    tiles: dict[int, list[dict]] = {}
    for w in words:
        tiles.setdefault(w["tile"], []).append(w)
    ids = sorted(tiles)
    out, right = [], 0
    for n, t in enumerate(ids):
        left, width = tiles[t][0]["tile_left"], tiles[t][0]["tile_wid"]
        limit = tiles[ids[n + 1]][0]["tile_left"] if n + 1 < len(ids) else left + width
        right = max(right, left)
        kept = [w for w in sorted(tiles[t], key=lambda w: w["word_id"]) if right <= w["box_left"] <= limit]
        out += kept
        right = kept[-1]["box_left"] + kept[-1]["wid"] if kept else 0
    return [{k: w[k] for k in ("page_id", "line_id", "tile", "word_id", "word_str", "box_left", "wid")} for w in out]


def stitched(words: DataFrame) -> DataFrame:
    cols = ["page_id", "line_id", "tile", "tile_left", "tile_wid", "word_id", "word_str", "box_left", "wid"]
    return map_groups(words.select(*cols), LINE, ["tile", "word_id"], stitch, "page_id string, line_id int, tile int, word_id int, word_str string, box_left int, wid int")


def refine_positions(words: list[dict], line_left: int, line_right: int) -> list[dict]:
    """Narrow words given a centre and an extent by their kind, between neighbours; each uses its left neighbour's new place."""
    # fixed values: centre (in frame widths) and half extent (share of height; of width for punctuation) by kind
    centre = {0: 1.4, 1: 1.0, 2: 0.9}
    extent = {0: 0.4, 1: 0.25, 2: 0.35}
    out = [dict(w) for w in words]
    for i, w in enumerate(out):
        if w["hei"] <= 0 or w["wid"] / w["hei"] > 0.75:
            continue
        high = out[i + 1]["box_left"] - 3 if i + 1 < len(out) else line_right
        low = line_left if i == 0 else out[i - 1]["box_left"] + out[i - 1]["wid"] + 3
        frames = max(1, (w["t_end"] or 0) - (w["t_start"] or 0) + 1)
        step = w["wid"] // frames
        kind = w["lc_type"]
        middle = int(w["box_left"] + step * centre.get(kind, 1.0))
        half = int(w["hei"] * extent[kind]) if kind in extent else int(0.6 * w["wid"])
        left, right = max(middle - half, low), min(middle + half, high)
        w["box_left"], w["wid"] = left, max(right - left + 1, 2)
    return out


def refined_positions(words: DataFrame, lines: DataFrame) -> DataFrame:
    bounds = lines.select("page_id", "line_id", F.col("box_left").alias("line_left"), (F.col("box_left") + F.col("wid")).alias("line_right"))
    rows = words.join(bounds, LINE).select("page_id", "line_id", "word_id", "box_left", "wid", "hei", "lc_type", "t_start", "t_end", "line_left", "line_right")

    def fn(group: list[dict]) -> list[dict]:
        keep = ("page_id", "line_id", "word_id", "box_left", "wid")
        return [{k: w[k] for k in keep} for w in refine_positions(group, group[0]["line_left"], group[0]["line_right"])]

    return map_groups(rows, LINE, ["word_id"], fn, "page_id string, line_id int, word_id int, box_left int, wid int")
