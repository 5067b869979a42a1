"""Text of scanned pages as continuous, readable paragraphs (problem 1).

Lines are range-partitioned and sorted in reading order (volume, page, line), so
neighbouring lines meet in one task and a volume of any size is spread over many.
In one pass over them
  * a gradient-boosted classifier of a line and its neighbours tells furniture
    (running headers and footers, page numbers, stamps) from running text,
  * a second one judges each pair of consecutive lines of running text: does the
    last word of the first go on in the second? It knows words of the lexicon, but
    judges names and trade words too, by spelling, signs and the room in the line.
Words outside the lexicon are then looked up once each: q-gram candidates and
their ranking are in :mod:`misreadings`. Both classifiers are trained once, on the
driver, from bounded samples.

The two ends of a partition, at most two lines each, are paired afterwards.
Repeated lines count once; null and empty lines are running text without words;
a line whose page is not in ``scan_pages`` stands in a volume of its own page.
"""

from __future__ import annotations

import random
import re
from collections import deque
from collections.abc import Iterable
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.lineage import cut, python_partitions
from glyphmill.llm import misreadings
from glyphmill.llm.boosting import Booster
from glyphmill.llm.lookalikes import Consistent, Spelling, bare, read_lexicon

#: Lines from which the furniture classifier is fitted, besides made-up pages: at most so
#: many, of TRAIN_RUNS runs of RUN_PAGES neighbouring pages, picked by hash.
TRAIN_LINES = 20_000
TRAIN_RUNS = 150
RUN_PAGES = 8
MADE_PAGES = 400
#: Made-up lines of each language from which the classifier of line pairs is fitted.
MADE_LINES = 1500
#: How sure the classifier must be to join words without a sign between, which does more harm if it is wrong.
UNSIGNED = 0.9
#: Pages of up to so many lines stay in one partition; longer ones may be cut at multiples of it.
WHOLE_PAGE = 2000
#: Lines at the top, and as many at the foot, of a page that are remembered for the page that follows.
REMEMBERED = 12

_SIGNS = "-‐‑–—¬=~_"
_AROUND = " \t.,;:()[]{}\"'«»„“”‘’…*?¿¡" + _SIGNS
# numbers, also with letters that look like digits; signs with a number; capitals with a number and perhaps a small letter
_CODE = re.compile(r"[\W\d_]*|[§£€¥¢¶†‡‰Ωß]\d+|[A-Z]{1,4}-?\d+(?:[./,\-]\d+)*[a-z]?|[lIOoSsBbZgq\d.,/]*\d[lIOoSsBbZgq\d.,/]*")
_ROMAN = re.compile(r"\b[ivxlc]+\b")
_DIGIT = re.compile(r"\d")

LINE_COLUMNS = ["page_id", "line_id", "box_left", "box_top", "wid", "hei", "img_w", "img_h", "line_str", "book_id", "volume_no", "page_seq", "lang"]
_OUT = (
    "page_id string, line_id int, book_id int, volume_no long, page_seq int, lang string, box_left int, text string, furniture boolean, "
    "broken boolean, in_lexicon boolean, starts boolean, tokens array<string>, room double, part int, edge int"
)


def _with_pages(text_lines: DataFrame, scan_pages: DataFrame, books: DataFrame) -> DataFrame:
    """Distinct lines with the volume, the page number and the language of their page."""
    pages = scan_pages.select("page_id", "volume_no", "page_seq").dropDuplicates(["page_id"])
    langs = books.select("book_id", F.col("lang").alias("lang"))
    # copies of a line go first, so that no range holds them all
    rows = text_lines.select("page_id", "line_id", "book_id", "box_left", "box_top", "wid", "hei", "img_w", "img_h", "line_str").distinct()
    return rows.join(pages, "page_id", "left").join(langs, "book_id", "left").select(*LINE_COLUMNS)


def lines_in_order(text_lines: DataFrame, scan_pages: DataFrame, books: DataFrame) -> DataFrame:
    """Lines with the volume and page number of their page, sorted in reading order within ranges."""
    rows = _with_pages(text_lines, scan_pages, books)
    order = ["book_id", "volume_no", "page_seq", "page_id"]
    cut_at = (F.col("line_id") / WHOLE_PAGE).cast("int")
    return rows.repartitionByRange(python_partitions(rows), *order, cut_at).sortWithinPartitions(*order, "line_id")


# --- furniture -------------------------------------------------------------------------------


def masked(text: str | None) -> str:
    """A line without what changes from page to page: digits, Roman numbers, case, spaces, signs."""
    return re.sub(r"[\W\d_]+", "", _ROMAN.sub("", (text or "").lower()))


class LineView:
    """Features of lines in reading order, from a line, its neighbours, and the outer lines of the page before."""

    def __init__(self) -> None:
        self._page: object = None
        self._volume: object = None
        self._before: dict[str, float] = {}
        self._top: list[tuple[str, float]] = []
        self._low: deque[tuple[str, float]] = deque(maxlen=REMEMBERED)
        self._gap = 30.0

    def features(self, prev: dict | None, row: dict, nxt: dict | None) -> list[float]:
        volume = (row["book_id"], row["volume_no"], row["page_id"] if row["volume_no"] is None else None)
        if row["page_id"] != self._page:
            self._before = dict([*self._low, *self._top]) if volume == self._volume else {}
            self._top, self._page, self._volume, self._gap = [], row["page_id"], volume, 30.0
            self._low.clear()
        height = float(max(row["img_h"] or 0, 1))
        top, hei = float(row["box_top"] or 0), float(max(row["hei"] or 0, 1))
        rel_top, rel_low = top / height, (height - top - hei) / height
        first = prev is None or prev["page_id"] != row["page_id"]
        last = nxt is None or nxt["page_id"] != row["page_id"]
        gap_up = 30.0 if first else min(30.0, (top - (prev["box_top"] or 0)) / hei)
        gap_down = 30.0 if last else min(30.0, ((nxt["box_top"] or 0) - top) / hei)
        above, self._gap = self._gap, gap_up
        text = row["line_str"] or ""
        mask = masked(text)
        again = float(mask in self._before and abs(self._before[mask] - rel_top) < 0.05) if text else 0.0
        if text and rel_top < 0.2 and len(self._top) < REMEMBERED:
            self._top.append((mask, rel_top))
        elif text and rel_low < 0.2:
            self._low.append((mask, rel_top))
        digits = len(_DIGIT.findall(text)) / max(1, len(text))
        return [rel_top, rel_low, gap_up, gap_down, float(first), float(last), again, digits, float(len(text.split())), float(row["wid"] or 0) / max(1.0, float(row["img_w"] or 0)), above]


def _made_pages(rng: random.Random, n: int) -> tuple[list[list[float]], list[float]]:
    """Features and labels of made-up pages: a body of lines, with and without furniture around it."""
    x, y = [], []
    for _ in range(n):
        height = rng.choice([1200, 1400, 1750, 2300, 3300])
        hei = rng.uniform(0.008, 0.026)
        gap = hei * rng.uniform(1.15, 1.9)
        head, foot, stamp = rng.random() < 0.7, rng.random() < 0.7, rng.random() < 0.2
        top = rng.uniform(0.055, 0.15)
        count = max(3, int(min(rng.uniform(0.2, 0.75), 0.82 - top) / gap))
        tops = [(rng.uniform(0.015, 0.035), 1)] if head else []
        tops += [(top + i * gap, 0) for i in range(count)]
        low = max(tops[-1][0] + 1.5 * gap, rng.uniform(0.9, 0.955))
        tops += [(low, 1)] if foot else []
        tops += [(min(low + rng.uniform(1.0, 2.5) * hei, 0.985), 1)] if stamp else []
        above = 30.0
        for i, (t, kind) in enumerate(tops):
            up = 30.0 if i == 0 else min(30.0, (t - tops[i - 1][0]) / hei)
            down = 30.0 if i == len(tops) - 1 else min(30.0, (tops[i + 1][0] - t) / hei)
            number = kind and t > 0.5 and rng.random() < 0.7
            digits = rng.uniform(0.4, 1) if number else 1.0 if rng.random() < 0.03 else rng.uniform(0, 0.15)
            words = 1.0 if number else float(rng.randint(1, 5) if kind or rng.random() < 0.12 else rng.randint(4, 12))
            x.append([t, 1 - t - hei, up, down, float(i == 0), float(i == len(tops) - 1), float(kind and rng.random() < 0.7), digits, words, words * 0.05, 30.0 if i == 0 else above])
            above = up
            y.append(float(kind))
    return x, y


def training_lines(text_lines: DataFrame, scan_pages: DataFrame, books: DataFrame, bound: int = TRAIN_LINES) -> DataFrame:
    """At most ``bound`` lines in order: runs of RUN_PAGES neighbouring pages, the TRAIN_RUNS first by hash.

    The pages are picked before lines are looked at, so that of the corpus only one
    filtered scan is read for it.
    """
    run = F.struct("book_id", "volume_no", (F.col("page_seq") / RUN_PAGES).cast("int").alias("run"))
    pages = scan_pages.select("page_id", "book_id", "volume_no", "page_seq").withColumn("run", run)
    runs = pages.select("run", F.xxhash64("run").alias("h")).distinct().orderBy("h", "run").limit(TRAIN_RUNS)
    picked = pages.join(F.broadcast(runs), "run", "left_semi").select("page_id").distinct()
    lines = text_lines.join(F.broadcast(picked.limit(TRAIN_RUNS * RUN_PAGES * 2)), "page_id", "left_semi")
    order = ["book_id", "volume_no", "page_seq", "page_id", "line_id"]
    return _with_pages(lines, scan_pages, books).orderBy(*order).limit(bound)


def train_furniture(text_lines: DataFrame, scan_pages: DataFrame, books: DataFrame, bound: int = TRAIN_LINES) -> Booster:
    """Fitted on made-up pages and on the lines of :func:`training_lines`.

    The lines are labelled by what no feature of a single page shows: one is furniture
    if its text, without what changes from page to page, stands at the same place of
    the page before or after; it is running text if it is on neither and all lines between
    it and the page's middle follow at the page's own pitch. All others are left out. Half
    of the lines found so are shown without the recurrence, so that it is not all the
    model learns.
    """
    rng = random.Random(7)
    x, y = _made_pages(rng, MADE_PAGES)
    sample = training_lines(text_lines, scan_pages, books, bound).toPandas()
    rows = [r for r in sample.astype(object).where(sample.notna(), None).to_dict("records")]
    pages: list[list[int]] = []
    for i, row in enumerate(rows):
        if i and rows[i - 1]["page_id"] == row["page_id"]:
            pages[-1].append(i)
        else:
            pages.append([i])

    def place(i: int) -> tuple[str, float]:
        return masked(rows[i]["line_str"]), (rows[i]["box_top"] or 0) / max(rows[i]["img_h"] or 0, 1)

    held = [[place(i) for i in page] for page in pages]
    recurs: dict[int, bool] = {}
    for n, page in enumerate(pages):
        volume = lambda k: (rows[pages[k][0]]["book_id"], rows[pages[k][0]]["volume_no"])  # noqa: B023,E731
        others = [q for k in (n - 1, n + 1) if 0 <= k < len(pages) and volume(k) == volume(n) for q, j in zip(held[k], pages[k]) if rows[j]["line_str"]]
        steps = [b[1] - a[1] for a, b in zip(held[n], held[n][1:])]
        pitch = sorted(steps)[len(steps) // 2] if len(steps) > 4 else 0.0
        for k, (i, (mask, top)) in enumerate(zip(page, held[n])):
            again = bool(rows[i]["line_str"]) and any(mask == m and abs(top - t) < 0.02 for m, t in others)
            middle = len(page) // 2
            inner = pitch > 0 and all(abs(step - pitch) < 0.25 * pitch for step in steps[min(k, middle) : max(k, middle)])
            if again != inner:  # a text that recurs inside the page tells nothing
                recurs[i] = again
    view = LineView()
    for i, row in enumerate(rows):
        f = view.features(rows[i - 1] if i else None, row, rows[i + 1] if i + 1 < len(rows) else None)
        if i in recurs:
            if recurs[i] and rng.random() < 0.5:
                f[6] = 0.0
            x.append(f)
            y.append(float(recurs[i]))
    return Booster(rounds=50, depth=3, bins=96).fit(np.array(x), np.array(y))


# --- broken words ----------------------------------------------------------------------------


def ends(text: str) -> tuple[str, bool, str]:
    """(last word without the sign at its end, whether there is a sign, first word) of a line's plain text."""
    words = text.split()
    if not words:
        return "", False, ""
    first = words[0]
    tail = words[-1]
    while len(words) > 1 and all(c in _SIGNS for c in tail):
        words.pop()
        tail = words[-1] + tail
    last = tail.rstrip(_SIGNS)
    return last, last != tail, first


def stands_off(text: str) -> bool:
    """Whether a sign at the end of a line stands apart from the word before it."""
    words = text.split()
    return len(words) > 1 and all(c in _SIGNS for c in words[-1])


class Pairs:
    """Whether the last word of a line goes on in the next: features, and a model trained on made-up lines."""

    _SIGN = 13  # place of the sign among the features

    def __init__(self, lexicon: list[tuple[str, str]]):
        self.words: dict[str, set[str]] = {}
        for word, lang in lexicon:
            self.words.setdefault(lang, set()).add(bare(word))
        self._make()
        self.model = self._train()

    def _make(self) -> None:
        self._spelling = {lang: Spelling(words) for lang, words in self.words.items()}
        self._halves = lru_cache(100_000)(self._of_words)

    def __getstate__(self):  # caches stay behind
        return {"words": self.words, "model": self.model}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._make()

    def in_lexicon(self, last: str, first: str, lang: str | None) -> bool:
        """Whether both parts together, with or without a sign between, are a lexicon word."""
        f = self._halves(last, first, lang)
        return bool(f[0] or f[1])

    def _of_words(self, last: str, first: str, lang: str | None) -> tuple[float, ...]:
        words = self.words.get(lang or "", set())
        a, b = bare(last), bare(first)
        joinable = last[-1:].isalnum() and first[:1].isalnum() and bool(a) and bool(b)
        spell = self._spelling.get(lang or "")
        scores = (spell.score(a + b), spell.score(a), spell.score(b)) if spell and joinable else (0.0, 0.0, 0.0)
        return (
            float(joinable and a + b in words),
            float(joinable and f"{a}-{b}" in words),
            float(a in words),
            float(b in words),
            float(joinable),
            float(first[:1].islower()),
            float(last[:1].isupper()),
            float(len(a)),
            float(len(b)),
            float(any(c.isdigit() for c in a + b)),
            *scores,
        )

    def features(self, last: str, sign: bool, first: str, lang: str | None, off: bool = False, room: float = 0.0) -> tuple[float, ...]:
        """``off``: the sign stands apart; ``room``: characters left in the line."""
        return (*self._halves(last, first, lang), float(sign), float(off), room, room - len(first))

    def _names(self, words: list[str], rng: random.Random) -> str:
        """A word that no lexicon holds, of pieces of its words."""
        a, b = rng.choice(words), rng.choice(words)
        name = a[: rng.randint(2, max(2, len(a) - 1))] + b[rng.randint(0, max(0, len(b) - 3)) :]
        return name.capitalize() if rng.random() < 0.6 else name

    def made_lines(self, lang: str, rng: random.Random, count: int) -> list[tuple[str, bool, float]]:
        """Lines (text, broken, width in characters) set from words of the lexicon, names and numbers, some misread."""
        words = sorted(w for w in self.words[lang] if w)
        compounds = [w for w in words if "-" in w.strip("-")]
        # words that stand side by side though together they are a word too
        ready = [(w[:k], w[k:]) for w in words for k in range(2, len(w) - 1) if w[:k] in self.words[lang] and w[k:] in self.words[lang]]
        out: list[tuple[str, bool, float]] = []
        queue: list[str] = []
        while len(out) < count:
            width, known = rng.randint(28, 74), rng.uniform(0.3, 0.95)  # texts differ in how many of their words a lexicon holds
            for _ in range(rng.randint(2, 12)):
                line, size = [], 0
                stop = width if rng.random() < 0.85 else rng.randint(8, width)
                broken = False
                while True:
                    if not queue:
                        r = rng.random()
                        queue = [self._names(words, rng) if rng.random() > known else str(rng.randint(1, 2100)) if r < 0.04 else rng.choice(compounds) if compounds and r < 0.1 else rng.choice(words)]
                        if rng.random() < 0.02:
                            queue += ["-"]
                        elif rng.random() < 0.02:
                            queue = [rng.choice(words) + "-", rng.choice(words)]
                        elif ready and rng.random() < 0.02:
                            queue = list(rng.choice(ready))
                        elif rng.random() < 0.1:
                            queue[-1] += rng.choice(".,;:")
                        elif rng.random() < 0.1:
                            queue[-1] = misreadings.damaged(queue[-1], rng)
                        if rng.random() < 0.12:
                            queue[0] = queue[0][:1].upper() + queue[0][1:]
                    word = queue[0]
                    left = stop - size - (1 if line else 0)
                    if len(word) <= left:
                        line.append(word)
                        size = len(" ".join(line))
                        queue.pop(0)
                        continue
                    body = word.rstrip(".,;:")
                    if stop == width and len(body) > 3 and left > 2 and body.replace("-", "").isalpha() and rng.random() < 0.6:
                        k = rng.randint(2, min(len(body) - 1, left - 1))
                        if 0 < body.find("-") < left and rng.random() < 0.7:
                            k = body.find("-")
                        piece, rest = word[:k].rstrip("-"), word[k:].lstrip("-")
                        if piece and rest:
                            sign = rng.choice(["-", "-", "-", " -", "¬", ""])
                            line.append(piece + sign)
                            broken, queue[0] = True, rest
                    break
                if not line:
                    queue.clear()
                    continue
                text = " ".join(line)
                out.append((text, broken, len(text) + rng.uniform(-0.5, 0.5)))
        return out

    def examples(self, seed: int, count: int) -> tuple[list[tuple[float, ...]], list[float]]:
        """Features and labels of the pairs of made-up lines of all languages."""
        rng = random.Random(seed)
        x, y = [], []
        for lang in sorted(self.words):
            if lang == "zh" or len([w for w in self.words[lang] if len(w) > 3]) < 3:
                continue
            lines = self.made_lines(lang, rng, count)
            for i in range(len(lines) - 1):
                text, broken, right = lines[i]
                last, sign, _ = ends(text)
                margin = max(n[2] for n in lines[max(0, i - 1) : i + 2])
                x.append(self.features(last, sign, ends(lines[i + 1][0])[2], lang, stands_off(text), margin - right))
                y.append(float(broken))
        return x, y

    def _train(self) -> Booster:
        x, y = self.examples(3, MADE_LINES)
        if not x:
            return Booster(rounds=0).fit(np.zeros((0, 17)), np.zeros(0))
        return Booster(rounds=60, depth=4).fit(np.array(x), np.array(y))

    def judge(self, vectors: list[tuple[float, ...]]) -> list[bool]:
        """The model's word on each of the pairs, whose halves must be joinable."""
        if not vectors:
            return []
        x = np.array(vectors)
        least = np.where(x[:, self._SIGN] > 0, 0.5, UNSIGNED)
        return ((self.model.predict(x) >= least) & (x[:, 4] > 0)).tolist()

    def broken(self, last: str, sign: bool, first: str, lang: str | None, off: bool = False, room: float = 0.0) -> bool:
        return self.judge([self.features(last, sign, first, lang, off, room)])[0]


# --- the pass over the lines -----------------------------------------------------------------


class Doubtful:
    """Words of a line that may be misread: none of a lexicon, no numbers, codes or parts of broken words."""

    def __init__(self, lexicon: list[tuple[str, str]]):
        self._known = {bare(w) for w, _ in lexicon}
        self._token = lru_cache(200_000)(self._of_word)

    def _of_word(self, word: str) -> str | None:
        core = word.strip(_AROUND)
        token = core.lower()
        if not token or bare(word) in self._known or token.casefold() in self._known or _CODE.fullmatch(core):
            return None
        return token

    def tokens(self, text: str, skip_first: bool, skip_last: bool) -> list[str]:
        words = text.split()
        if skip_last:
            while words and all(c in _SIGNS for c in words[-1]):
                words.pop()
            words = words[:-1]
        return sorted({t for w in words[skip_first:] if (t := self._token(w)) is not None})


def _shown_rooms(rows: list[dict]) -> list[float]:
    """For each line the room to the right, in characters, up to the widest of it and its neighbours on the page."""
    rights = [float((r["box_left"] or 0) + (r["wid"] or 0)) for r in rows]
    out = []
    for i, r in enumerate(rows):
        margin = max(rights[k] for k in range(max(0, i - 1), min(len(rows), i + 2)) if rows[k]["page_id"] == r["page_id"])
        out.append((margin - rights[i]) * len(r["line_str"] or "") / max(1.0, float(r["wid"] or 0)))
    return out


def models(text_lines: DataFrame, scan_pages: DataFrame, books: DataFrame, lexicon: DataFrame, bound: int = TRAIN_LINES):
    """A broadcast of the lexicon's rows, both classifiers and the reader of look-alikes, trained once."""
    words = read_lexicon(lexicon)
    return lexicon.sparkSession.sparkContext.broadcast((words, train_furniture(text_lines, scan_pages, books, bound), Pairs(words), Consistent(words)))


def read_lines(ordered: DataFrame, shared) -> DataFrame:
    """One row for each line: its plain text, what it is, whether its last word is broken, and words in doubt.

    ``ordered`` is from :func:`lines_in_order`, ``shared`` from :func:`models`.
    ``in_lexicon`` tells of a broken word that it is one of the lexicon. ``edge`` is 1
    for the first and 2 for the last line of running text of a partition (3 for both),
    whose pairs :func:`edge_pairs` judges.
    """

    def run(batches):
        lexicon_rows, model, pairs, consistent = shared.value
        doubtful, view = Doubtful(lexicon_rows), LineView()
        part = TaskContext.get().partitionId()
        before: dict | None = None  # the line above those at hand
        open_line: dict | None = None  # last line of running text, its pair not judged
        any_running = False

        def finish(line: dict) -> None:
            line["tokens"] = [] if line["furniture"] or line["lang"] == "zh" else doubtful.tokens(line["text"], line["after_part"], line["sign"] or line["broken"])

        def judged(rows: list[dict], after: dict | None) -> list[dict]:
            nonlocal open_line, any_running, before
            out: list[dict] = []
            if not rows:
                return out
            around = [*([before] if before else []), *rows, *([after] if after else [])]
            rooms = _shown_rooms(around)
            shift = int(before is not None)
            vectors = []
            for i, row in enumerate(rows):
                above = around[i + shift - 1] if i + shift else None
                below = around[i + shift + 1] if i + shift + 1 < len(around) else None
                row["starts"] = _starts(above, row, below)
                vectors.append(view.features(above, row, below))
            before = rows[-1]
            scores = model.predict(np.array(vectors))
            running, links = [open_line] if open_line else [], []
            for i, (row, score) in enumerate(zip(rows, scores)):
                text = consistent.line(row["line_str"], row["lang"]) if row["line_str"] else ""
                line = {k: row[k] for k in ("page_id", "line_id", "book_id", "volume_no", "page_seq", "lang", "box_left", "starts")}
                line |= {"text": text, "furniture": bool(score >= 0.5), "broken": False, "in_lexicon": False, "part": part, "edge": 0, "room": rooms[i + shift]}
                if line["furniture"] or not text:  # a line without words has no part in pairs
                    line |= {"sign": False, "after_part": False}
                    finish(line)
                    out.append(line)
                    continue
                last, sign, first = ends(text)
                line |= {"last": last, "sign": sign, "off": sign and stands_off(text), "first": first, "after_part": False}
                if not any_running:
                    line["edge"], any_running = 1, True
                    line["after_part"] = True  # its first word waits for edge_pairs
                if running and _same_volume(running[-1], line):
                    up = running[-1]
                    links.append((up, line, pairs.features(up["last"], up["sign"], first, line["lang"], up["off"], up["room"])))
                running.append(line)
            for (up, line, _), yes in zip(links, pairs.judge([v for _, _, v in links])):
                if yes and line["lang"] != "zh":
                    up["broken"], up["in_lexicon"] = True, pairs.in_lexicon(up["last"], line["first"], line["lang"])
                line["after_part"] |= up["broken"] or up["sign"]
            for line in running[:-1]:
                finish(line)
            out += running[:-1]
            open_line = running[-1] if running else None
            return out

        names = [c.strip().split(" ")[0] for c in _OUT.split(",")]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.float64(), pa.int32(), pa.int32()]

        def emit(lines: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[n] for x in lines], k) for n, k in zip(names, kinds)], names=names)

        held: list[dict] = []  # the last line read, whose successor is not known yet
        for batch in batches:
            rows = held
            for row in batch.to_pylist():
                if not rows or (rows[-1]["page_id"], rows[-1]["line_id"]) != (row["page_id"], row["line_id"]):
                    rows.append(row)
            held = rows[-1:]
            if lines := judged(rows[:-1], held[0] if held else None):
                yield emit(lines)
        lines = judged(held, None)
        if open_line is not None:
            open_line["edge"] += 2
            finish(open_line)
            lines.append(open_line)
        if lines:
            yield emit(lines)

    return ordered.mapInArrow(run, _OUT)


def _same_volume(a: dict, b: dict) -> bool:
    """Whether two lines stand in one volume; a page of an unknown volume is one of its own."""
    return (a["book_id"], a["volume_no"]) == (b["book_id"], b["volume_no"]) and (b["volume_no"] is not None or a["page_id"] == b["page_id"])


def _starts(prev: dict | None, row: dict, nxt: dict | None) -> bool:
    """Whether a line is set in from a neighbour on its page, as the first of a paragraph is."""
    left, size = row["box_left"] or 0, row["hei"] or 0
    for other in (prev, nxt):
        if other is not None and other["page_id"] == row["page_id"] and abs((other["box_top"] or 0) - (row["box_top"] or 0)) < 3 * max(size, 1):
            if left - (other["box_left"] or 0) > 0.8 * size:
                return True
    return False


def edge_pairs(lines: DataFrame, shared) -> DataFrame:
    """What the pass could not tell at the ends of partitions: rows (page_id, line_id, lang, kind, in_lexicon, token).

    ``kind`` is broken for a last line whose word goes on in the next partition,
    and token for the first word of a first line, if that may be misread. At most
    two rows of each partition take part, so the window is over as many rows as
    there are partitions, whatever the size of the corpus.
    """
    w = Window.orderBy("part", "edge")
    key = F.struct("book_id", F.coalesce(F.col("volume_no").cast("string"), F.col("page_id")))
    rows = lines.filter("edge > 0").select("page_id", "line_id", "lang", "text", "edge", "part", "room", key.alias("volume"))
    for name, move in (("before", F.lag), ("after", F.lead)):
        rows = rows.withColumn(name, F.when(move("volume").over(w) == F.col("volume"), move(F.struct("text", "room")).over(w)))
    rows = rows.select("page_id", "line_id", "lang", "text", "edge", "room", "before", "after").filter("lang IS NULL OR lang <> 'zh'")

    def run(batches):
        lexicon_rows, _, pairs, _ = shared.value
        doubtful = Doubtful(lexicon_rows)

        def goes_on(text: str, room: float, first: str, lang: str | None) -> tuple[bool, bool]:
            last, sign, _ = ends(text)
            yes = pairs.broken(last, sign, first, lang, sign and stands_off(text), room)
            return yes, yes and pairs.in_lexicon(last, first, lang)

        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                at = (row["page_id"], row["line_id"], row["lang"])
                if row["edge"] >= 2 and row["after"]:
                    yes, in_lexicon = goes_on(row["text"], row["room"], ends(row["after"]["text"])[2], row["lang"])
                    if yes:
                        out.append((*at, "broken", in_lexicon, None))
                if row["edge"] in (1, 3):
                    first, above = ends(row["text"])[2], row["before"]
                    part = bool(above) and (ends(above["text"])[1] or goes_on(above["text"], above["room"], first, row["lang"])[0])
                    out += [(*at, "token", None, t) for t in doubtful.tokens(first, part, False)]
            columns = list(zip(*out)) if out else [[]] * 6
            types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["page_id", "line_id", "lang", "kind", "in_lexicon", "token"])

    return cut(rows.mapInArrow(run, "page_id string, line_id int, lang string, kind string, in_lexicon boolean, token string"))


def doubtful_tokens(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """(page_id, line_id, lang, token) for every word that may be misread."""
    inside = lines.filter(F.size("tokens") > 0).select("page_id", "line_id", "lang", F.explode("tokens").alias("token"))
    return inside.unionByName(edges.filter("kind = 'token'").select(*inside.columns))


def corrections(doubtful: DataFrame, lexicon: DataFrame, rows: list[tuple[str, str]]) -> DataFrame:
    """(lang, token, word, score) for tokens in doubt that were misread."""
    words = lexicon.filter("word IS NOT NULL AND lang IS NOT NULL AND lang <> 'zh'").select("lang", F.lower("word").alias("word")).distinct()
    pairs = misreadings.candidates(doubtful.select("lang", "token").distinct(), words, [(w.lower(), lang) for w, lang in rows if lang != "zh"])
    return misreadings.rank(pairs, misreadings.train_ranker(rows))


def _read(text_lines: DataFrame, scan_pages: DataFrame, books: DataFrame, lexicon: DataFrame):
    """The lines, what is to say of the edges of partitions, and (page_id, line_id, lang, token, word, score) of misread words; and the models."""
    shared = models(text_lines, scan_pages, books, lexicon)
    lines = cut(read_lines(lines_in_order(text_lines, scan_pages, books), shared))
    edges = edge_pairs(lines, shared)
    doubtful = doubtful_tokens(lines, edges)
    return lines, edges, doubtful.join(corrections(doubtful, lexicon, shared.value[0]), ["lang", "token"]), shared


def line_fixes(fixes: DataFrame) -> DataFrame:
    """(page_id, line_id, fixes): the misread words of a line with their words."""
    return fixes.groupBy("page_id", "line_id").agg(F.array_sort(F.collect_set(F.struct("token", "word"))).alias("fixes"))


def find_noise(text_lines: DataFrame, scan_pages: DataFrame, books: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rows (page_id, line_id, kind), kind being furniture, broken or misread.

    Lines of equal page_id and line_id count once (nulls are equal), columns beyond
    those named in :func:`lines_in_order` are not looked at, a null box counts as 0,
    and a page of unknown language has no words to be broken or misread. Of equally
    likely replacements the first in order is taken.
    """
    lines, edges, fixes, _ = _read(text_lines, scan_pages, books, lexicon)
    misread = fixes.select("page_id", "line_id").distinct()
    kinds = [
        lines.filter("furniture").select("page_id", "line_id", F.lit("furniture").alias("kind")),
        # of the broken words that the model finds, those of the lexicon are the cases asked for
        lines.filter("broken AND in_lexicon").select("page_id", "line_id", F.lit("broken").alias("kind")),
        edges.filter("kind = 'broken' AND in_lexicon").select("page_id", "line_id", "kind"),
        misread.select("page_id", "line_id", F.lit("misread").alias("kind")),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out


# --- paragraphs ------------------------------------------------------------------------------


def _corrected(word: str, fixes: dict[str, str]) -> str:
    """A word with its misread core replaced, in the case it had."""
    core = word.strip(_AROUND)
    right = fixes.get(core.lower())
    if right is None:
        return word
    if core.isupper() and len(core) > 1:
        right = right.upper()
    elif core[:1].isupper() or (not core[:1].isalpha() and word[:1] != core[:1] and core[1:2].isupper()):
        right = right[:1].upper() + right[1:]
    at = word.find(core)
    return word[:at] + right + word[at + len(core) :]


def joined_lines(lines: Iterable[tuple[str, bool, dict[str, str]]], known: set[str]) -> str:
    """Lines (text, broken, corrections) as one text: broken words whole, misread ones replaced."""
    done: list[str] = []
    last: str | None = None  # the word that may go on
    glue = False
    for text, broken, fixes in lines:
        words = [_corrected(w, fixes) for w in text.split()]
        if not words:
            continue
        if broken:
            while len(words) > 1 and all(c in _SIGNS for c in words[-1]):
                words.pop()
        shown = " ".join(words)
        if glue:
            bare_last, first = last.rstrip(_SIGNS), words[0]
            hyphen = bare(bare_last + first) not in known and bare(f"{bare_last}-{first}") in known
            shown = bare_last + ("-" if hyphen else "") + shown
        elif last is not None:
            done.append(last)
        rest, space, last = shown.rpartition(" ")
        if space:
            done.append(rest)
        glue = broken
    return " ".join(done if last is None else [*done, last])


def repaired_words(words: DataFrame, text_lines: DataFrame, scan_pages: DataFrame, books: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words that were misread: (page_id, line_id, word_id, word_str, repaired), repeats once.

    A word is repaired as its line is: by the replacements that :func:`find_noise` finds
    there, so parts of broken words and words of furniture stay. Null and empty words stay.
    """
    _, _, fixes, shared = _read(text_lines, scan_pages, books, lexicon)
    langs = books.select("book_id", "lang")
    rows = words.select("page_id", "book_id", "line_id", "word_id", "word_str").filter("word_str <> ''").distinct()
    rows = rows.join(line_fixes(fixes), ["page_id", "line_id"]).join(langs, "book_id", "left").drop("book_id")
    names = ["page_id", "line_id", "word_id", "word_str", "repaired"]

    def run(batches):
        consistent = shared.value[3]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                plain = consistent.line(r["word_str"], r["lang"])
                repaired = " ".join(_corrected(w, {e["token"]: e["word"] for e in r["fixes"]}) for w in plain.split())
                if repaired != plain:
                    out.append((r["page_id"], r["line_id"], r["word_id"], r["word_str"], repaired))
            columns = list(zip(*out)) if out else [[]] * 5
            types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return rows.mapInArrow(run, "page_id string, line_id int, word_id int, word_str string, repaired string")


#: Paragraphs of about so many characters leave a task together.
BATCH_CHARS = 1_000_000


def paragraphs(text_lines: DataFrame, scan_pages: DataFrame, books: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Running text in reading order: (book_id, volume_no, page_id, line_id, n_lines, text) of each paragraph.

    ``page_id`` and ``line_id`` are those of its first line. A paragraph begins at a
    line that is set in or at a new volume, and is whole however long it is: its lines
    are joined as they stream by. Furniture is left out, broken words are joined,
    misread ones replaced, look-alikes plain.
    """
    lines, edges, fixes, _ = _read(text_lines, scan_pages, books, lexicon)
    fixes = line_fixes(fixes)
    cut_off = edges.filter("kind = 'broken'").select("page_id", "line_id", F.lit(True).alias("edge_broken"))
    rows = lines.filter("NOT furniture AND text <> ''").join(fixes, ["page_id", "line_id"], "left").join(cut_off, ["page_id", "line_id"], "left")
    rows = rows.withColumn("broken", F.col("broken") | F.coalesce("edge_broken", F.lit(False)))
    volume = F.struct("book_id", F.coalesce(F.col("volume_no").cast("string"), F.col("page_id")))
    order = ["book_id", "volume_no", "page_seq", "page_id", "line_id"]
    # within a partition of the pass, which is as large as a task; the carry from one to the next is a row each
    w = Window.partitionBy("part").orderBy(*order)
    before = F.lag(volume).over(w)
    new = F.col("starts") | (before != volume)
    here = F.struct("page_id", "line_id")
    rows = rows.withColumn("volume", volume).withColumn("new", F.when(F.coalesce(new, F.lit(False)), here))
    rows = rows.withColumn("para", F.last("new", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends_of = rows.groupBy("part").agg(
        F.min_by(F.struct("volume", here.alias("here")), F.struct(*order)).alias("first"), F.max_by(F.struct("volume", "para"), F.struct(*order)).alias("last")
    )
    over_parts = Window.orderBy("part")  # one row for each partition
    same = F.coalesce(F.lag("last.volume").over(over_parts) == F.col("first.volume"), F.lit(False))
    ends_of = ends_of.withColumn("own", F.when(~same, F.col("first.here"))).withColumn("latest", F.coalesce("last.para", "own"))
    carry = F.last("latest", ignorenulls=True).over(over_parts.rowsBetween(Window.unboundedPreceding, -1))
    ends_of = ends_of.select("part", F.coalesce("own", carry).alias("carry"))
    rows = rows.join(ends_of, "part").withColumn("para", F.coalesce("para", "carry"))
    para = ["book_id", "volume_no", "para"]
    rows = rows.repartition(python_partitions(rows), *para).sortWithinPartitions(*para, *order)
    rows = rows.select("book_id", "volume_no", F.col("para.page_id").alias("page_id"), F.col("para.line_id").alias("line_id"), "text", "broken", "fixes")
    known = lexicon.sparkSession.sparkContext.broadcast({bare(x) for x, _ in read_lexicon(lexicon)})
    names = ["book_id", "volume_no", "page_id", "line_id", "n_lines", "text"]
    types = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string()]

    def run(batches):
        def table_of(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        n_lines = 0

        def counted(lines):
            nonlocal n_lines
            for r in lines:
                n_lines += 1
                yield r["text"], r["broken"], {e["token"]: e["word"] for e in r["fixes"] or []}

        out, size = [], 0
        for key, lines in groupby((r for b in batches for r in b.to_pylist()), lambda r: tuple(r[n] for n in names[:4])):
            n_lines = 0
            text = joined_lines(counted(lines), known.value)
            out.append((*key, n_lines, text))
            size += len(text)
            if size > BATCH_CHARS:
                yield table_of(out)
                out, size = [], 0
        if out:
            yield table_of(out)

    return rows.mapInArrow(run, "book_id int, volume_no long, page_id string, line_id int, n_lines long, text string")
