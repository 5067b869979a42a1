"""Grouping of boxes that grows step by step: word groups, rows of components, picture regions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from glyphmill.operators.grouped import map_groups


def _box(r: dict) -> list[int]:
    return [r["box_left"], r["box_top"], r["box_left"] + r["wid"], r["box_top"] + r["hei"]]


def _union(a: list[int], b: list[int]) -> list[int]:
    return [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]


def adaptive_groups(rects: list[dict], aspect: float = 2.0, even: float = 0.15, gap: float = 0.5) -> list[tuple[int, int]]:
    """(first, last) of groups of boxes from left to right.

    A group takes the next box until it is ``aspect`` times as wide as high; from
    then on only while tops, bottoms and heights differ by at most ``even`` and the
    gap by ``gap`` heights. Groups overlap by one box; a last group that is higher
    than twice its width joins the one before.
    """
    if not rects:
        return []
    out, first = [], 0
    while True:
        box, last = _box(rects[first]), first
        while last + 1 < len(rects):
            nxt = _box(rects[last + 1])
            h = max(1, box[3] - box[1])
            if (box[2] - box[0]) / h >= aspect:
                cur = _box(rects[last])
                differs = max(abs(nxt[1] - cur[1]), abs(nxt[3] - cur[3]), abs((nxt[3] - nxt[1]) - (cur[3] - cur[1]))) > even * h
                if differs or nxt[0] - cur[2] > gap * h:
                    break
            box, last = _union(box, nxt), last + 1
        out.append((first, last, box))
        if last == len(rects) - 1:
            break
        first = last if last > first else last + 1
    if len(out) > 1:
        box = out[-1][2]
        if (box[2] - box[0]) / max(1, box[3] - box[1]) <= 0.5:
            out[-2:] = [(out[-2][0], out[-1][1], _union(out[-2][2], box))]
    return [(a, b) for a, b, _ in out]


def word_groups(words: DataFrame, whole: bool = False) -> DataFrame:
    """(page_id, line_id, grp, first_word, last_word) of :func:`adaptive_groups` on every line; with ``whole`` a line is one group."""

    def fn(g: list[dict]) -> list[dict]:
        if whole:
            return [{"page_id": g[0]["page_id"], "line_id": g[0]["line_id"], "grp": 0, "first_word": g[0]["word_id"], "last_word": g[-1]["word_id"]}]
        return [{"page_id": g[0]["page_id"], "line_id": g[0]["line_id"], "grp": i, "first_word": g[a]["word_id"], "last_word": g[b]["word_id"]} for i, (a, b) in enumerate(adaptive_groups(g))]

    cols = ["page_id", "line_id", "word_id", "box_left", "box_top", "wid", "hei"]
    return map_groups(words.select(*cols), ["page_id", "line_id"], ["box_left", "word_id"], fn, "page_id string, line_id int, grp int, first_word int, last_word int")


def component_rows(rects: list[dict], least: float = 0.25) -> list[list[int]]:
    """Rows (left, top, right, bottom) of components.

    Components that overlap by half their height and touch, or by most of the
    narrower width, are merged until nothing changes. A row grows from the widest
    component left, taking those that share half of the lower height and stand
    within three mean heights. Rows lower than ``least`` of the largest are
    dropped, rows that overlap in height merged.
    """
    boxes = [_box(r) for r in rects]
    changed = True
    while changed:
        changed = False
        boxes.sort()
        for i in range(len(boxes)):
            for j in range(i + 1, len(boxes)):
                a, b = boxes[i], boxes[j]
                if b[0] > a[2]:
                    break
                high = min(a[3], b[3]) - max(a[1], b[1])
                wide = min(a[2], b[2]) - max(a[0], b[0])
                h = min(a[3] - a[1], b[3] - b[1])
                if (high > 0.5 * h and wide > -0.1 * min(a[2] - a[0], b[2] - b[0])) or (high > 0 and wide > 0.8 * min(a[2] - a[0], b[2] - b[0])):
                    boxes[i] = _union(a, b)
                    del boxes[j]
                    changed = True
                    break
            if changed:
                break
    rest, rows = boxes[:], []
    while rest:
        seed = max(rest, key=lambda b: (b[2] - b[0], -b[0]))
        rest.remove(seed)
        row, n, heights = seed, 1, seed[3] - seed[1]
        grown = True
        while grown:
            grown = False
            for b in sorted(rest):
                share = min(row[3], b[3]) - max(row[1], b[1])
                gap = max(b[0] - row[2], row[0] - b[2])
                if share >= 0.5 * min(row[3] - row[1], b[3] - b[1]) and gap < 3 * heights / n:
                    row, n, heights, grown = _union(row, b), n + 1, heights + b[3] - b[1], True
                    rest.remove(b)
        rows.append(row)
    if not rows:
        return []
    largest = max(rows, key=lambda b: (b[2] - b[0]) * (b[3] - b[1]))
    rows = sorted((r for r in rows if r[3] - r[1] >= least * (largest[3] - largest[1])), key=lambda r: (r[1], r[3]))
    out: list[list[int]] = []
    for r in rows:
        if out and r[1] < out[-1][3]:
            out[-1] = _union(out[-1], r)
        else:
            out.append(r)
    return out


def sample_rows_of_components(letters: DataFrame) -> DataFrame:
    """Rows of each sample's letters: (sample_id, row_no, left, top, right, bottom)."""

    def fn(g: list[dict]) -> list[dict]:
        return [{"sample_id": g[0]["sample_id"], "row_no": i, "left": r[0], "top": r[1], "right": r[2], "bottom": r[3]} for i, r in enumerate(component_rows(g))]

    cols = ["sample_id", "letter_no", "box_left", "box_top", "wid", "hei"]
    return map_groups(letters.filter("box_left >= 0").select(*cols), ["sample_id"], ["letter_no"], fn, "sample_id long, row_no int, left int, top int, right int, bottom int")


def picture_regions(shapes: list[list[int]], texts: list[list[int]], least_side: int = 3) -> list[list[int]]:
    """Shapes that touch no text, united one by one as long as the union touches neither text nor another shape."""

    def meets(a: list[int], b: list[int]) -> bool:
        return min(a[2], b[2]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[1], b[1])

    out: list[list[int]] = []
    free = [s for s in shapes if min(s[2] - s[0], s[3] - s[1]) >= least_side and not any(meets(s, t) for t in texts)]
    for s in free:
        for i, o in enumerate(out):
            both = _union(o, s)
            if not any(meets(both, t) for t in texts) and not any(meets(both, x) for k, x in enumerate(out) if k != i):
                out[i] = both
                break
        else:
            out.append(s)
    return out
