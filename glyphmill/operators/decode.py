"""Sequence decoding: CTC scores, string alignment, beam search over candidate words."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.operators.arrow_map import append_columns
from glyphmill.operators.grouped import map_groups

LOG_ZERO = -87.0


def log_add(a: float, b: float) -> float:
    """log(exp a + exp b); at or below LOG_ZERO stands for nothing."""
    high, low = max(a, b), min(a, b)
    if high <= LOG_ZERO:
        return LOG_ZERO
    return high if low <= LOG_ZERO else high + math.log1p(math.exp(low - high))


def _log(p: float) -> float:
    return max(math.log(p), LOG_ZERO) if p > 0 else LOG_ZERO


def _mul(a: float, b: float) -> float:
    return LOG_ZERO if a <= LOG_ZERO or b <= LOG_ZERO else max(a + b, LOG_ZERO)


def ctc_log_prob(matrix: list[float], labels: int, path: list[int], blank: int | None = None) -> float:
    """log P(path) over all alignments of a frames x labels matrix of probabilities; no frames give LOG_ZERO."""
    blank = labels - 1 if blank is None else blank
    frames = len(matrix) // labels
    if not frames or any(not 0 <= k < labels for k in path):
        return LOG_ZERO
    p = np.asarray(matrix[: frames * labels], float).reshape(frames, labels)
    on_blank, on_class = [], [LOG_ZERO] * frames
    total = 0.0
    for t in range(frames):
        total = _mul(total, _log(p[t, blank]))
        on_blank.append(total)
    last = None
    for k in path:
        new_class, new_blank = [LOG_ZERO] * frames, [LOG_ZERO] * frames
        if last is None:
            new_class[0] = _log(p[0, k])
        for t in range(1, frames):
            entering = on_blank[t - 1] if last == k else log_add(on_blank[t - 1], on_class[t - 1])
            new_class[t] = _mul(_log(p[t, k]), log_add(entering, new_class[t - 1]))
            new_blank[t] = _mul(_log(p[t, blank]), log_add(new_class[t - 1], new_blank[t - 1]))
        on_class, on_blank, last = new_class, new_blank, k
    return log_add(on_class[-1], on_blank[-1])


def with_ctc_score(df: DataFrame, matrix: str, path: str, labels: int, out: str = "log_prob") -> DataFrame:
    """``df`` with the CTC log probability of each row's path."""
    added = T.StructType([T.StructField(out, T.DoubleType())])

    def make():
        def compute(batch):
            a = batch.column(batch.schema.get_field_index(matrix)).to_pylist()
            b = batch.column(batch.schema.get_field_index(path)).to_pylist()
            return [pa.array([ctc_log_prob(m, labels, p) if m is not None and p is not None else None for m, p in zip(a, b)], pa.float64())]

        return compute

    return append_columns(df, added, make)


def case_variant(matrix: list[float], labels: int, variants: list[list[int]]) -> tuple[float, int]:
    """Log sum over a word's spellings (lower, capital, upper) and the likeliest of them; of equals the first."""
    scores = [ctc_log_prob(matrix, labels, v) for v in variants]
    total = LOG_ZERO
    for s in scores:
        total = log_add(total, s)
    return total, scores.index(max(scores))


# --- alignment -------------------------------------------------------------------------------


def align(a: str, b: str, gap: float = -1.0, mismatch: float = -1.5, match: float = 1.0) -> tuple[float, list[int]]:
    """Global alignment: the score, and for each character of ``a`` its place in ``b`` or -1.

    Of equally good steps a gap in ``a`` is taken before a gap in ``b``, and that
    before a pair.
    """
    n, m = len(a), len(b)
    score = [[gap * (i + j) if not i or not j else 0.0 for i in range(n + 1)] for j in range(m + 1)]
    came = [["left" if not j else "top" for i in range(n + 1)] for j in range(m + 1)]
    for j in range(1, m + 1):
        for i in range(1, n + 1):
            best, how = score[j - 1][i] + gap, "top"
            if score[j][i - 1] + gap > best:
                best, how = score[j][i - 1] + gap, "left"
            pair = score[j - 1][i - 1] + (match if a[i - 1] == b[j - 1] else mismatch)
            if pair > best:
                best, how = pair, "pair"
            score[j][i], came[j][i] = best, how
    place = [-1] * n
    i, j = n, m
    while i or j:
        how = came[j][i]
        if how == "top":
            j -= 1
        elif how == "left":
            i -= 1
        else:
            place[i - 1] = j - 1
            i, j = i - 1, j - 1
    return score[m][n], place


def edit_distance(a: str | bytes, b: str | bytes, substitute: float = 1, insert: float = 1, delete: float = 1) -> float:
    """Cost of turning ``a`` into ``b``; on bytes as the reference counts, on text by code points."""
    row = [j * insert for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [i * delete]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + delete, new[-1] + insert, row[j - 1] + (0 if x == y else substitute)))
        row = new
    return row[-1]


def shrink(frames: str, blank: str = "_") -> tuple[str, list[int], list[int]]:
    """Characters of a frame string without blanks and repeats, each with its first and last frame."""
    first = [i for i, c in enumerate(frames) if c != blank and (i == 0 or frames[i - 1] != c)]
    last = [b - 1 for b in first[1:]]
    if first:
        last.append(min(first[-1] + 1, len(frames) - 1))
    return "".join(frames[i] for i in first), first, last


def frame_runs(labels: list[int], blank: int) -> list[tuple[int, int, int]]:
    """(label, first frame, last frame) of each run of a label that is not blank."""
    out: list[tuple[int, int, int]] = []
    for t, k in enumerate(labels):
        if k == blank:
            continue
        if t and labels[t - 1] == k:
            out[-1] = (k, out[-1][1], t)
        else:
            out.append((k, t, t))
    return out


_PIECE = re.compile(
    r"[A-Za-z]+(?:[-'][A-Za-z]+)*"  # letters, with - and ' between them
    r"|[0-9]+(?:[-.][0-9]+)*(?:[A-Za-z]{1,3}(?![A-Za-z]))?"  # digits, with a unit of up to three letters
    r"|[^A-Za-z0-9]+"
)


def split_word(word: str) -> list[tuple[str, int]]:
    """Pieces of a word where letters, digits and punctuation meet, with their offsets ("16mb" stays whole)."""
    return [(m.group(), m.start()) for m in _PIECE.finditer(word)]


def split_boxes(row: dict) -> list[dict]:
    """The pieces of a word with boxes in proportion, one character's width being left between two pieces."""
    pieces = split_word(row["word_str"] or "")
    if len(pieces) < 2:
        return [dict(row, piece=0)]
    unit = row["wid"] / (len(row["word_str"]) + len(pieces) - 1)
    return [
        dict(row, piece=i, word_str=text, box_left=int(row["box_left"] + unit * (at + i)), wid=max(1, int(unit * len(text)))) for i, (text, at) in enumerate(pieces)
    ]


def merge_close(words: list[dict], mean_space: float) -> list[dict]:
    """``a - b`` and ``it ' s`` become one word where the gaps are small: up to one mean space for -, three for '."""
    out: list[dict] = []
    i = 0
    while i < len(words):
        w = dict(words[i])
        while i + 2 < len(words) and words[i + 1]["word_str"] in ("-", "'"):
            sign, nxt = words[i + 1], words[i + 2]
            limit = mean_space * (1 if sign["word_str"] == "-" else 3)
            if not (w["word_str"][-1:].isalpha() and nxt["word_str"][:1].isalpha()):
                break
            if sign["box_left"] - (w["box_left"] + w["wid"]) > limit or nxt["box_left"] - (sign["box_left"] + sign["wid"]) > limit:
                break
            w["word_str"] += sign["word_str"] + nxt["word_str"]
            w["wid"] = nxt["box_left"] + nxt["wid"] - w["box_left"]
            i += 2
        out.append(w)
        i += 1
    return out


# --- beam search -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Weights:
    """Weights of language model, its unigram part, check, recognition and edit scores."""

    lm: float = 0.02
    lm0: float = 0.03
    check: float = 0.4
    recognition: float = 0.2
    edit: float = 3.2


# fixed values: the weights of the three recognisers
PLAIN = Weights()
ATTENTION = Weights(0.03, 0.02, 0.6, 0.15, 3.3)
RESNET = Weights(0.02, 0.03, 0.6, 0.25, 2.4)
BEAM = 20
#: A language model starts anew below this score.
LM_RESET = -25.0
BULLET_BONUS = 10.5


def reachable(words: list[dict], i: int, j: int, char_width: float) -> bool:
    """Whether word j may follow word i: it does not overlap it, and no other starts between, or the gap is small."""
    right, left = words[i]["box_left"] + words[i]["wid"], words[j]["box_left"]
    if left < right - 0.2 * char_width:
        return False
    between = any(right < w["box_left"] < left for w in words)
    return not between or left - right < 1.5 * char_width


def beam_search(words: list[dict], lm, char_width: float, weights: Weights = PLAIN, beam: int = BEAM) -> list[tuple[int, int]]:
    """The best path as (word, candidate) pairs.

    Each word has a box and ``candidates``: (text, log_prob, check, edit). ``lm``
    gives log P(word | previous word or None). A path starts and ends within half
    a character of the line's ends; of equal scores the later node wins.
    """
    if not words:
        return []
    left = min(w["box_left"] for w in words)
    right = max(w["box_left"] + w["wid"] for w in words)
    width = max(1, right - left)
    slack = 0.5 * char_width
    nodes: list[dict] = []

    def node(i, k, parent):
        text, log_prob, check, edit = words[i]["candidates"][k]
        end = words[i]["box_left"] + words[i]["wid"]
        if parent is None:
            lm_score = lm(None, text)
            n = {"lm_total": lm_score, "lm": lm_score, "lm0": lm_score * abs(end - left) / width, "check": check, "rec": log_prob, "edit": edit, "parent": -1, "prev": text}
        else:
            p = nodes[parent]
            step = lm(p["prev"], text)
            total = p["lm_total"] + step
            unigram = lm(None, text) if weights.lm0 > 0 else 0.0
            n = {
                "lm": p["lm"] + step, "lm0": p["lm0"] + unigram * abs(end - p["end"]) / width, "check": p["check"] + check, "rec": p["rec"] + log_prob,
                "edit": p["edit"] + edit, "parent": parent, "lm_total": 0.0 if total < LM_RESET else total, "prev": None if total < LM_RESET else text,
            }
        n |= {"word": i, "cand": k, "end": end}
        n["score"] = weights.lm * n["lm"] + weights.lm0 * n["lm0"] + weights.check * n["check"] + weights.recognition * n["rec"] + weights.edit * n["edit"]
        if parent is None and text == "●":
            n["rec"] += BULLET_BONUS  # seen by followers alone
        return n

    for i, word in enumerate(words):
        fresh = []
        for j in range(len(nodes) - 1, -1, -1):
            if reachable(words, nodes[j]["word"], i, char_width):
                fresh += [node(i, k, j) for k in range(len(word["candidates"]))]
        if word["box_left"] - left < slack:
            fresh += [node(i, k, None) for k in range(len(word["candidates"]))]
        fresh.sort(key=lambda n: -n["score"])
        nodes += fresh[:beam]

    def best(indices):
        pick = -1
        for i in indices:
            if pick < 0 or nodes[i]["score"] > nodes[pick]["score"]:
                pick = i
        return pick

    backwards = range(len(nodes) - 1, -1, -1)
    at = best(i for i in backwards if right - nodes[i]["end"] < slack)
    if at < 0:
        at = best(backwards)
    out = []
    while at >= 0:
        out.append((nodes[at]["word"], nodes[at]["cand"]))
        at = nodes[at]["parent"]
    return out[::-1]


def _rests(df: DataFrame, column: str, distance: int) -> DataFrame:
    """``df`` with ``rest``: the column after each choice of up to ``distance`` deletions, each once."""
    rests = F.array(F.col(column))
    for _ in range(distance):
        fewer = F.transform(rests, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r), F.lit(1))), lambda i: F.concat(F.substring(r, F.lit(1), i - 1), F.substring(r, i + 1, F.length(r)))))
        rests = F.array_distinct(F.concat(rests, F.flatten(fewer)))
    return df.withColumn("rest", F.explode(rests))


def expand_candidates(words: DataFrame, lexicon: DataFrame, most: int = 5, distance: int = 2) -> DataFrame:
    """Rows (page_id, line_id, word_id, cand_id, text, log_prob, check, edit): each word and its lexicon neighbours.

    Suggestions are the ``most`` nearest lexicon words within ``distance`` edits and
    of like length, with check score -0.1 x rank and edit score -d / length; a word
    that is itself a suggestion gets 0.5 - 0.1 x rank. Words under three letters
    have no suggestions. The join is on the rests of both after up to ``distance``
    deletions, which words within that distance always share.
    """
    keys = ["page_id", "line_id", "word_id"]
    rows = words.filter("word_str IS NOT NULL AND word_str <> ''").select(*keys, F.lower("word_str").alias("seen"), F.coalesce("log_prob", F.lit(-5.0)).alias("log_prob"))
    seen = rows.select("seen").distinct().filter(F.length("seen") >= 3)
    lex = lexicon.select(F.lower("word").alias("word")).distinct()

    # words longer or shorter than any of the lexicon have none; the rests of long ones would be many
    sizes = lex.select(F.explode(F.sequence(F.length("word") - distance, F.length("word") + distance)).alias("size")).distinct()
    seen = seen.withColumn("size", F.length("seen")).join(sizes, "size", "left_semi").select("seen")
    # words within that many edits share a rest after as many deletions from each
    met = _rests(seen, "seen", distance).join(_rests(lex, "word", distance), "rest").select("seen", "word").distinct()
    near = met.withColumn("d", F.levenshtein("seen", "word", distance)).filter("d >= 0")

    w = Window.partitionBy("seen").orderBy("d", "word")
    near = near.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < most)
    own = near.filter("d = 0").select("seen", F.col("rank").alias("own_rank"))
    near = near.filter("d > 0")
    base = rows.join(own, "seen", "left")
    self_rows = base.select(*keys, F.lit(0).alias("cand_id"), F.col("seen").alias("text"), "log_prob", F.when(F.col("own_rank").isNotNull(), 0.5 - 0.1 * F.col("own_rank")).otherwise(0.0).alias("check"), F.lit(0.0).alias("edit"))
    others = rows.join(near, "seen").select(
        *keys, (F.col("rank") + 1).alias("cand_id"), F.col("word").alias("text"), (F.col("log_prob") - F.col("d")).alias("log_prob"), (-0.1 * F.col("rank")).alias("check"),
        (-F.col("d") / F.greatest(F.length("seen"), F.lit(1))).alias("edit"),
    )
    return self_rows.unionByName(others)


def decode_lines(words: DataFrame, candidates: DataFrame, bigrams: DataFrame, weights: Weights = PLAIN, unknown: float = -12.0, most_bigrams: int = 2_000_000) -> DataFrame:
    """The best reading of each line: (page_id, line_id, decoded, path).

    ``bigrams`` (prev, word, logp; prev null for a start) is a closed table, sent to
    the tasks after a check of its size.
    """
    table = bigrams.select("prev", "word", "logp").limit(most_bigrams + 1).collect()
    if len(table) > most_bigrams:
        raise ValueError("the bigram table is larger than its bound")
    shared = words.sparkSession.sparkContext.broadcast({(r.prev, r.word): r.logp for r in table})
    cells = F.array_sort(F.collect_list(F.struct("cand_id", "text", "log_prob", "check", "edit")))
    keys = ["page_id", "line_id", "word_id"]
    rows = words.select(*keys, "box_left", "wid").join(candidates.groupBy(*keys).agg(cells.alias("candidates")), keys)

    def fn(group: list[dict]) -> list[dict]:
        model = shared.value
        items = [dict(w, candidates=[(c["text"], c["log_prob"], c["check"], c["edit"]) for c in w["candidates"]]) for w in group]
        letters = sum(len(w["candidates"][0][0]) for w in items)
        char_width = sum(w["wid"] for w in items) / max(1, letters)
        path = beam_search(items, lambda prev, word: model.get((prev, word), model.get((None, word), unknown)), char_width, weights)
        text = " ".join(items[i]["candidates"][k][0] for i, k in path)
        return [{"page_id": group[0]["page_id"], "line_id": group[0]["line_id"], "decoded": text, "path": [items[i]["word_id"] for i, _ in path]}]

    return map_groups(rows, ["page_id", "line_id"], ["box_left", "word_id"], fn, "page_id string, line_id int, decoded string, path array<int>")


def spread(word: str, frames: str, lower: bool = False) -> list[tuple[float, float]]:
    """Where each character of a word lies among the frames of its string, by alignment with the collapsed frames.

    Unmatched characters share the room between their matched neighbours evenly.
    """
    if lower:
        word, frames = word.lower(), frames.lower()
    short, first, last = shrink(frames)
    _, place = align(word, short)
    out: list[tuple[float, float] | None] = [(float(first[p]), float(last[p])) if p >= 0 else None for p in place]
    i = 0
    while i < len(out):
        if out[i] is not None:
            i += 1
            continue
        j = i
        while j < len(out) and out[j] is None:
            j += 1
        start = out[i - 1][1] + 1 if i else 0.0
        end = out[j][0] - 1 if j < len(out) else float(max(len(frames) - 1, 0))
        step = max(end - start + 1, 0.0) / (j - i)
        for k in range(i, j):
            out[k] = (start + step * (k - i), start + step * (k - i + 1) - 1 if step else start)
        i = j
    return [o for o in out if o is not None]


def words_of_frames(labels: list[int], blank: int, space: int) -> list[tuple[int, int, list[int]]]:
    """(first frame, last frame, label path) of words parted by the space class."""
    out: list[tuple[int, int, list[int]]] = []
    open_word = False
    for k, a, b in frame_runs(labels, blank):
        if k == space:
            open_word = False
        elif open_word:
            out[-1] = (out[-1][0], b, [*out[-1][2], k])
        else:
            out.append((a, b, [k]))
            open_word = True
    return out


def attention_score(matrix: list[list[float]], own: list[int], candidate: list[int], miss: float = 1e-4, step: float = 0.1) -> float:
    """Log probability of a candidate on the frames of a word read by attention.

    The candidate is aligned with the word's own labels; a label that stands at a
    frame takes its probability there, one without a frame a penalty, and every
    difference beyond the first costs another factor of ``step``.
    """
    n, m = len(own), len(candidate)
    d = [[max(i, j) if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (own[i - 1] != candidate[j - 1]))
    total, i, j = 0.0, n, m
    while j:
        if i and d[i][j] == d[i - 1][j - 1] + (own[i - 1] != candidate[j - 1]):
            total += _log(max(matrix[i - 1][candidate[j - 1]], miss))
            i, j = i - 1, j - 1
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
        else:
            total += math.log(miss)
            j -= 1
    return total + max(0, d[n][m] - 1) * math.log(step)
