"""Which words were misread, and for which words of a lexicon (part of problem 1).

Words outside the lexicon meet it in an inverted join of character q-grams; the
candidates that share enough of them are described by features, and a
gradient-boosted model, trained on lexicon words that were damaged here, ranks
them. The best candidate is a replacement if the model finds it likely enough.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.lineage import python_partitions
from glyphmill.llm.boosting import Booster

Q = 2
#: Damaged words made for training, of each lexicon word.
TRAIN_COPIES = 3
TRAIN_WORDS = 1500
ACCEPT = 0.8

# What recognisers take for one another, in groups written "right>wrong wrong ...".
_CONFUSED = """
a>o @ e|b>6 h|c>e o|d>cl|e>c 6 o|f>t|g>9 q|h>b n|i>l 1 ! j|l>1 i | I|m>rn nn|n>u r|o>0 c a|p>q|q>g|r>t f|s>5 $|t>f + l|u>n v ii|v>y u|w>vv|x>%|y>v|z>2
in>m|ve>w|ch>dr|cl>d|li>h|vv>w|rn>m|ri>n|nn>m rm|ß>fs B 8|k>h lc|é>6 e ó|è>e 6|ê>e|ë>e|à>a|â>a|ç>c|ô>o|ö>o 6|ü>u ii|ä>a|ù>u|û>u|ñ>n|í>i|á>a|ó>o 6|ú>u
а>о @|б>6|в>8|г>т|д>л|е>с 6|ж>х|з>3|и>н п|й>и|к>н х|л>п|м>н ы|н>п и|о>0 с|п>н л|р>п|с>е о|т>г|у>ч|х>ж|ц>и п|ч>4|ш>щ|щ>ш|ы>ь1 ьi|ь>6|э>з|ю>о|я>л|ё>е|л>д|ч>у
"""


def _confusions() -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for group in re.split(r"[|\n](?=[^ >]+>)", _CONFUSED.strip()):
        right, wrong = group.split(">", 1)
        for w in wrong.split(" "):
            if w:
                out.setdefault(right, set()).add(w.lower())
                if len(right) == 1 and len(w) == 1 and w.isalpha():
                    out.setdefault(w.lower(), set()).add(right)
    return out


def plain(word: str) -> str:
    """A word in lower case without what is around its letters and digits (bare() folds ß, which is read letter by letter here)."""
    start, end = 0, len(word)
    while start < end and not word[start].isalnum():
        start += 1
    while end > start and not word[end - 1].isalnum():
        end -= 1
    return word[start:end].lower()


CONFUSED = _confusions()
_LOW_COST = 0.3


@lru_cache(400_000)
def _same_letter(a: str, b: str) -> bool:
    return unicodedata.normalize("NFD", a)[0] == unicodedata.normalize("NFD", b)[0]


def sight_distance(seen: str, word: str, limit: float = 4.0) -> float:
    """Edits that make ``seen`` of ``word``; confusions of recognisers cost less than others."""
    n, m = len(word), len(seen)
    if abs(n - m) > limit:
        return limit
    rows = [[0.0] * (m + 1) for _ in range(n + 1)]
    for j in range(1, m + 1):
        rows[0][j] = float(j)
    for i in range(1, n + 1):
        row, up = rows[i], rows[i - 1]
        row[0] = float(i)
        wrong = CONFUSED.get(word[i - 1], ())
        pair = CONFUSED.get(word[i - 2 : i], ()) if i > 1 else ()
        for j in range(1, m + 1):
            c = seen[j - 1]
            if c == word[i - 1]:
                best = up[j - 1]
            else:
                best = up[j - 1] + (_LOW_COST if c in wrong or _same_letter(c, word[i - 1]) else 1.0)
            best = min(best, up[j] + 1.0, row[j - 1] + 1.0)
            if j > 1 and seen[j - 2 : j] in wrong:
                best = min(best, up[j - 2] + _LOW_COST)
            if pair and c in pair:
                best = min(best, rows[i - 2][j - 1] + _LOW_COST)
            if pair and j > 1 and seen[j - 2 : j] in pair:
                best = min(best, rows[i - 2][j - 2] + _LOW_COST)
            row[j] = best
    return min(rows[n][m], limit)


@lru_cache(100_000)
def grams(word: str) -> set[str]:
    padded = f"^{word}$"
    return {padded[i : i + Q] for i in range(len(padded) - Q + 1)}


def features(seen: str, word: str) -> list[float]:
    a, b = grams(seen), grams(word)
    d = sight_distance(seen, word)
    letters = sum(c.isalpha() for c in seen)
    return [
        d,
        d / max(len(word), 1),
        len(a & b) / max(1, len(a | b)),
        float(len(word)),
        float(len(seen) - len(word)),
        float(seen[:1] == word[:1]),
        float(seen[-1:] == word[-1:]),
        letters / max(1, len(seen)),
        float(any(not c.isalpha() and c != "-" for c in seen)),
    ]


def damaged(word: str, rng: random.Random) -> str:
    """A lexicon word as a recogniser might have read it."""
    for _ in range(1 if rng.random() < 0.75 else 2):
        spots = [(i, k) for i in range(len(word)) for k in (1, 2) if word[i : i + k] in CONFUSED and i + k <= len(word)]
        if spots and rng.random() < 0.9:
            i, k = rng.choice(spots)
            word = word[:i] + rng.choice(sorted(CONFUSED[word[i : i + k]])) + word[i + k :]
        elif len(word) > 3:
            i = rng.randrange(len(word))
            word = word[:i] + rng.choice("etaonirsl") + word[i + 1 :]
    return word


def _foreign(words: list[str], rng: random.Random) -> str:
    """A word that is none of the lexicon: halves of two words, or a piece of one."""
    a, b = rng.choice(words), rng.choice(words)
    if rng.random() < 0.3 and len(a) > 4:
        k = rng.randrange(2, len(a) - 1)
        return a[:k] if rng.random() < 0.5 else a[k:]
    return a[: max(2, len(a) // 2)] + b[len(b) // 2 :]


def train_ranker(lexicon: list[tuple[str, str]], copies: int = TRAIN_COPIES, bound: int = TRAIN_WORDS) -> Booster:
    """A model on pairs (seen, candidate): damaged words with their word, other candidates, and foreign words."""
    rng = random.Random(11)
    by_lang: dict[str, list[str]] = {}
    for word, lang in lexicon:
        by_lang.setdefault(lang, []).append(plain(word))
    x, y = [], []
    for lang in sorted(by_lang):
        words = sorted({w for w in by_lang[lang] if w and w.isascii() | (w[0].isalpha())})
        if lang == "zh" or len(words) < 5:
            continue
        known = set(words)
        index: dict[str, list[str]] = {}
        for w in words:
            for g in sorted(grams(w)):
                index.setdefault(g, []).append(w)
        picked = words if len(words) <= bound else rng.sample(words, bound)
        for w in picked:
            for k in range(copies):
                seen = damaged(w, rng) if k < copies - 1 else _foreign(words, rng)
                if seen in known:
                    continue
                shared: dict[str, int] = {}
                for g in grams(seen):
                    for c in index.get(g, ()):
                        shared[c] = shared.get(c, 0) + 1
                near = sorted(shared, key=lambda c: (-shared[c], c))[:6]
                if k < copies - 1 and w not in near:
                    near.append(w)
                for c in near:
                    x.append(features(seen, c))
                    y.append(float(c == w and k < copies - 1))
    if not x:
        return Booster(rounds=0).fit(np.zeros((0, 9)), np.zeros(0))
    return Booster(rounds=70, depth=3).fit(np.array(x), np.array(y))


def _least_shared(n: int, m: int) -> int:
    """Distinct q-grams that a reading of n letters shares at least with its word of m: all but those of two damaged places."""
    return max(1, max(n, m) + 1 - 2 * (3 if m >= 5 else 2))


def gram_counts(words: Iterable[tuple[str, str]]) -> dict[tuple[str, str], int]:
    """How many of the (word, lang) rows hold a q-gram of a language."""
    return Counter((lang, g) for word, lang in set(words) for g in grams(word))


def candidates(tokens: DataFrame, lexicon: DataFrame, rows: list[tuple[str, str]]) -> DataFrame:
    """Rows (lang, token, word) of an inverted q-gram join, distinct and partitioned by token.

    ``tokens`` has distinct (lang, token), ``lexicon`` (lang, word), ``rows`` the same
    lexicon as (word, lang). Only pairs that can share as many q-grams as
    :func:`_least_shared` asks for, and differ by three letters at most, need to meet: of
    sets of a and b grams that share t, the a - t + 1 rarest of the one and the b - t + 1
    rarest of the other have a gram in common. So each side goes into the join with
    its rarest grams alone, once for each length of the other, and the length is part of
    the key; grams that no word holds are not sent at all. :func:`rank` counts what is shared.
    """
    counts = tokens.sparkSession.sparkContext.broadcast(dict(gram_counts(rows)))

    def inverted(df: DataFrame, seen: bool) -> DataFrame:
        name, size = ("token", "n") if seen else ("word", "m")

        def run(batches):
            held = counts.value
            for batch in batches:
                langs, words, own, other, keys = [], [], [], [], []
                for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ordered = sorted(grams(word), key=lambda g: (held.get((lang, g), 0), g))
                    known = [held.get((lang, g), 0) > 0 for g in ordered]
                    for length in range(max(1, len(word) - 3), len(word) + 4):
                        least = _least_shared(len(word), length) if seen else _least_shared(length, len(word))
                        for g, k in zip(ordered[: max(0, len(ordered) - least + 1)], known):
                            if k:
                                langs.append(lang)
                                words.append(word)
                                own.append(len(word))
                                other.append(length)
                                keys.append(g)
                n, m = (own, other) if seen else (other, own)
                columns = [pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int32()), pa.array(m, pa.int32()), pa.array(keys, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", name, "n", "m", "gram"])

        return df.select("lang", name).mapInArrow(run, f"lang string, {name} string, n int, m int, gram string")

    parts = python_partitions(tokens)
    met = inverted(tokens.repartition(parts, "lang", "token"), True).join(inverted(lexicon, False), ["lang", "n", "m", "gram"])
    return met.select("lang", "token", "word").repartition(parts, "lang", "token").dropDuplicates(["lang", "token", "word"])


def rank(pairs: DataFrame, model: Booster, accept: float = ACCEPT) -> DataFrame:
    """The best candidate (lang, token, word, score) of each token that has a likely one."""
    shared = pairs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]):
        booster = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            met = [i for i, (s, w) in enumerate(pairs) if len(grams(s) & grams(w)) >= _least_shared(len(s), len(w))]
            batch = batch.take(pa.array(met, pa.int32()))
            if not met:
                continue
            pairs = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            score = booster.predict(np.array([features(s, w) for s, w in pairs]))
            keep = np.flatnonzero(score >= accept)
            part = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score[keep])], names=["lang", "token", "word", "score"])

    likely = pairs.select("lang", "token", "word").mapInArrow(run, "lang string, token string, word string, score double")
    # of equal scores the word that comes first in order
    best = likely.groupBy("lang", "token").agg(F.min_by(F.struct("word", "score"), F.struct(-F.col("score"), F.col("word"))).alias("best"))
    return best.select("lang", "token", F.col("best.word").alias("word"), F.col("best.score").alias("score"))
