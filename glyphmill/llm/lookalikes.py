"""One consistent form for text that looks the same (problem 2).

Three steps for each word. (1) Characters that show nothing are deleted, spaces
become plain spaces, compatibility forms their plain characters, and letters
are composed with their marks. (2) The letters become a lattice: at each place
stand the character and all those that look like it, in its own and other scripts.
(3) For each script a Viterbi search finds the best path on which all letters are of
it, scored by character trigrams of the language or script and by what it changes.
The best path over all scripts is the form; what a lexicon word, a code, the page's
script and so on weigh against the trigrams is fitted on lexicon words and codes
that are respelled here.

A word that is wholly in a foreign script stays, unless the lexicon holds what
it looks like. Characters of plain ASCII are never swapped for one another.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.lineage import python_partitions

#: A lexicon is a small closed table that is sent to all tasks; a larger one is refused.
MAX_LEXICON_WORDS = 500_000

# Letters that look alike, place by place. The first line of a pair is Latin.
_PAIRS = [
    ("Cyrillic", "aceopxyijsh" + "dwqlv" + "ABEKMHOPCTXYISJGQW", "асеорхуіјѕһ" + "ԁԝԛӏѵ" + "АВЕКМНОРСТХУІЅЈԌԚԜ"),
    ("Greek", "oavipuknw" + "ABEZHIKMNOPTYX", "οανιρυκηω" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"),
    ("Armenian", "ouhng", "օսհոց"),
]
# Latin letters outside the alphabet that look like letters of it.
_LATIN_TWINS = {"ɡ": "g", "ɑ": "a", "ſ": "s", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ʏ": "y", "ɴ": "N", "ʀ": "R", "ʜ": "H", "ʟ": "L"}
# Accented Cyrillic and Latin letters that look alike.
_ACCENTED = [("ë", "ё"), ("Ë", "Ё"), ("ï", "ї"), ("Ï", "Ї"), ("è", "ѐ"), ("È", "Ѐ"), ("ä", "ӓ"), ("Ä", "Ӓ"), ("ö", "ӧ"), ("Ö", "Ӧ")]
# Signs that are drawn the same as a plain one.
_SIGNS = {"‐": "-", "‑": "-", "‒": "-", "−": "-", "﹣": "-", "－": "-", "⁃": "-", "․": ".", "∕": "/", "⁄": "/", "ꞏ": "·", "։": ":", "꞉": ":", "\u2126": "\u03a9", "\u212a": "K", "\u212b": "\u00c5"}

#: The letters of scripts other than Latin in which a page may be set, without marks.
_BLOCKS = {"Cyrillic": "А-Яа-яЁё", "Greek": "Α-Ωα-ω", "Armenian": "Ա-Ֆա-և"}
_IGNORABLE = re.compile(
    "[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U000e0000-\U000e0fff]"
)
#: Compatibility forms that look the same as what they stand for.
_COMPATIBLE = re.compile(
    "[\ufb00-\ufb06\ufb13-\ufb17\uff01-\uff5e\uff61-\uff65\u2160-\u217f\u2e80-\u2fdf\uf900-\ufaff\U0002f800-\U0002fa1f"
    "\U0001d400-\U0001d7ff\u2102\u210a-\u2113\u2115\u2119-\u211d\u2124\u2128\u212c-\u2134\u01c4-\u01cc\u01f1-\u01f3"
    "\u0132\u0133\u013f\u0140\ufe30-\ufe4f\ufe50-\ufe6b]"
)
#: Letters that serve as signs.
_NEUTRAL = set("Ωµ")
_PLAIN_LINE = re.compile("[ -~]*")


def _script(c: str) -> str | None:
    """The script of a letter; None for digits, signs and letters used as signs."""
    if c in _NEUTRAL or not c.isalpha():
        return None
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00 or c in _LATIN_TWINS:
        return "Latin"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "Greek"
    if 0x400 <= o < 0x530:
        return "Cyrillic"
    if 0x530 <= o < 0x590:
        return "Armenian"
    return "other"


def respelled(word: str, rng: random.Random, most: int = 3) -> str:
    """A word in which some letters, ``most`` at most, are replaced by others that look the same."""
    places = [i for i, c in enumerate(word) if any(x != c for xs in readings(c).values() for x in xs)]
    out = list(word)
    for i in rng.sample(places, min(len(places), rng.randint(1, most))):
        out[i] = rng.choice(sorted({x for xs in readings(word[i]).values() for x in xs} - {word[i]}))
    return "".join(out)


def _tables() -> dict[str, dict[str, str]]:
    """For each target script, what a letter looks like in it."""
    to: dict[str, dict[str, str]] = {"Latin": dict(_LATIN_TWINS), "Cyrillic": {}, "Greek": {}, "Armenian": {}}
    for script, latin, other in _PAIRS:
        for a, b in zip(latin, other, strict=True):
            to["Latin"][b] = a
            to[script].setdefault(a, b)
    for a, b in _ACCENTED:
        to["Latin"].setdefault(b, a)
        to["Cyrillic"].setdefault(a, b)
    for script in ("Cyrillic", "Greek"):  # by way of the Latin letter
        for c, a in to["Latin"].items():
            if _script(c) != script and a in to[script]:
                to[script].setdefault(c, to[script][a])
    return to


LOOKS = _tables()
#: Letters that look like several of another script: the further readings.
_MORE = {"ӏ": "Il", "І": "Il", "Ι": "Il", "ı": "i", "ν": "v", "υ": "uv", "κ": "kк", "ʋ": "v", "ɩ": "i", "ѵ": "v"}


def readings(c: str) -> dict[str, list[str]]:
    """What a letter may be, by script: itself, and all that look like it. Plain Latin letters do not stand for each other."""
    out: dict[str, list[str]] = {}
    for x in (c, *(LOOKS[t][c] for t in LOOKS if c in LOOKS[t]), *(_MORE.get(c, ""))):
        s = _script(x)
        if s is not None and x not in out.setdefault(s, []):
            out[s].append(x)
    if c in _LATIN_TWINS:  # not a letter of any alphabet here
        out["Latin"].remove(c)
    return out


def script_of(words: list[str]) -> str:
    """The script in which most letters of ``words`` stand; Latin if they have none."""
    met = Counter(s for w in words for c in w if (s := _script(c)))
    return met.most_common(1)[0][0] if met else "Latin"



def plain_points(text: str) -> list[str]:
    """What each code point of ``text`` becomes before scripts are looked at."""
    out: list[str] = []
    base = -1  # place of the letter that marks go with
    for c in text:
        if " " <= c <= "~":
            out.append(c)
            base = len(out) - 1
        elif _IGNORABLE.match(c):
            out.append("")
        elif unicodedata.combining(c) and base >= 0 and out[base]:
            composed = unicodedata.normalize("NFC", out[base] + c)
            out[base] = composed
            out.append("")
        else:
            if c in _SIGNS:
                c = _SIGNS[c]
            elif unicodedata.category(c) == "Zs":
                c = " "
            elif _COMPATIBLE.match(c):
                c = unicodedata.normalize("NFKC", c)
            out.append(c)
            base = len(out) - 1
    return out


def bare(word: str) -> str:
    """A word without case and without what is around its letters and digits."""
    start, end = 0, len(word)
    while start < end and not word[start].isalnum():
        start += 1
    while end > start and not word[end - 1].isalnum():
        end -= 1
    return word[start:end].casefold()


_CODE = re.compile(r"[^\W\d_]{1,5}-?[0-9][0-9/\-]*[^\W\d_]?|[0-9]+[^\W\d_]|[^\W\d_]{1,5}-[0-9]+")
_ROMAN = re.compile("[IVXLCDM]+")


class Spelling:
    """How well letters follow each other in the words of a language: smoothed character trigrams."""

    def __init__(self, words: Iterable[str]):
        self._threes: Counter = Counter()
        self._twos: Counter = Counter()
        for w in words:
            padded = f"^^{w}$"
            for i in range(2, len(padded)):
                self._threes[padded[i - 2 : i + 1]] += 1
                self._twos[padded[i - 2 : i]] += 1
        self.score = lru_cache(100_000)(self._score)

    def after(self, two: str, c: str) -> float:
        """log P of a letter after two others."""
        return math.log((self._threes.get(two + c, 0) + 0.05) / (self._twos.get(two, 0) + 2.0))

    def _score(self, word: str) -> float:
        """Mean log probability of a letter of ``word``, its end included."""
        padded = f"^^{word}$"
        return sum(self.after(padded[i - 2 : i], padded[i]) for i in range(2, len(padded))) / (len(padded) - 2)

    def __getstate__(self):  # the cache stays behind
        return {"_threes": self._threes, "_twos": self._twos}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.score = lru_cache(100_000)(self._score)


#: Words respelled for the fit, of each kind and language, and rounds over them.
FIT_WORDS, FIT_ROUNDS = 150, 4
_AROUND_CODE = " \"'()[]{}.,:;!?*«»„“”…-—"
_NO_SPELLING = Spelling(())


class Consistent:
    """The consistent form of words, given the lexicon as (word, lang) rows. Can be sent to tasks."""

    #: What speaks for a path, in the order of ``weights``: its trigrams, letters changed, letters left in
    #: another script, a word of the page's lexicon, the page's script, a code in Latin, a Roman
    #: number in Latin, letters as they stand that look like none of another script, and small letters made capitals or the reverse.
    FEATURES = ("spelling", "changed", "left", "word", "page", "code", "roman", "own", "case")

    def __init__(self, lexicon: list[tuple[str, str]], fit: bool = True):
        self._words: dict[str, set[str]] = {}
        by_script: dict[str, list[str]] = {}
        for word, lang in lexicon:
            self._words.setdefault(lang, set()).add(bare(word))
        self._page = {lang: script_of(sorted(words)) for lang, words in self._words.items()}
        for lang, words in self._words.items():
            by_script.setdefault(self._page[lang], []).extend(words)
        self._spelling = {("", script): Spelling(words) for script, words in by_script.items()}
        self._spelling |= {(lang, self._page[lang]): Spelling(words) for lang, words in self._words.items()}
        self.weights = (1.0, -1.0, -8.0, 8.0, 1.0, 8.0, 4.0, 1.0, -2.0)
        self._caches()
        if fit:
            self._fit(lexicon)
            self._caches()

    def _caches(self) -> None:
        self._word = lru_cache(200_000)(self._settle)
        self._spelled = lru_cache(200_000)(self.form)
        self._readings = lru_cache(20_000)(readings)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_word", "_spelled", "_readings")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._caches()

    def page_script(self, lang: str | None) -> str:
        """The script of a language: that of its lexicon words, Latin if there are none."""
        return self._page.get(lang or "", "Latin")

    def _path(self, word: str, lattice: list[dict[str, list[str]]], script: str, lang: str | None) -> tuple[str, float, int, int, int]:
        """Viterbi over the lattice within one script: (letters, spelling, changed, left, case).

        A state is the last two letters. A letter that cannot be read in the script is left as it stands.
        """
        spelling = self._spelling.get((lang or "", script)) or self._spelling.get(("", script)) or _NO_SPELLING
        w_spell, w_changed, w_left, w_case = (*self.weights[:3], self.weights[8])
        states: dict[str, tuple[float, tuple, str]] = {"^^": (0.0, (0.0, 0, 0, 0), "")}
        for c, places in zip(word, lattice):
            options = places.get(script) if places else [c]
            left = not options
            new: dict[str, tuple[float, tuple, str]] = {}
            for two, (value, (spell, changed, n_left, n_case), way) in states.items():
                for o in options or [c]:
                    low = o.lower()
                    step = spelling.after(two, low[:1])
                    case = o.isupper() != c.isupper()
                    n = value + w_spell * step + w_changed * (o != c) + w_left * left + w_case * case
                    key = two[1] + low[:1]
                    if key not in new or n > new[key][0]:
                        new[key] = (n, (spell + step, changed + (o != c), n_left + left, n_case + case), way + o)
            states = new
        ends = ((v + w_spell * spelling.after(two, "$"), way, spelling.after(two, "$"), f) for two, (v, f, way) in states.items())
        _, way, last, (spell, changed, n_left, n_case) = max(ends)
        return way, spell + last, changed, n_left, n_case

    def candidates(self, word: str, lang: str | None) -> list[tuple[str, tuple[float, ...]]]:
        """The best path of each script in which the word may stand, with its features."""
        lattice = [self._readings(c) if _script(c) else {} for c in word]
        page = self.page_script(lang)
        words = self._words.get(lang or "", set())
        own = {s for c in word if (s := _script(c))}
        foreign = len(own) == 1 and page not in own and not any(c in _LATIN_TWINS for c in word)
        found: dict[str, tuple[float, ...]] = {}
        core = word.strip(_AROUND_CODE)
        at = word.find(core)
        for script in sorted({s for places in lattice for s in places}, key=lambda s: (s != page, s)):
            way, spell, changed, left, case = self._path(word, lattice, script, lang)
            in_words = script == page and bare(way) in words
            inner = way[at : at + len(core)]
            code = script == "Latin" and not left and any(c.isdigit() for c in inner) and bool(_CODE.fullmatch(inner))
            # a word that is wholly in a foreign script is no case, unless it is a word of the page or a code
            if way != word and foreign and not (in_words or code):
                continue
            roman = script == "Latin" and not left and bool(_ROMAN.fullmatch(inner))
            anchors = sum(1 for c, places in zip(word, lattice) if len(places) == 1 and c in places.get(script, ()))
            if way not in found:
                found[way] = (spell, changed, left, in_words, script == page, code, roman, anchors, case)
        return [(way, tuple(map(float, f))) for way, f in found.items()]

    def _settle(self, word: str, lang: str | None) -> str | None:
        """The letters of ``word`` (already plain) on the best path; None if they stay."""
        scripts = {s for c in word if (s := _script(c))}
        page = self.page_script(lang)
        if not scripts or scripts == {"other"} or (scripts == {page} and not any(c in _LATIN_TWINS or (c.isdigit() and page != "Latin") for c in word)):
            return None  # nothing to settle: one script, the page's own
        best = None
        for way, features in self.candidates(word, lang):
            value = sum(w * f for w, f in zip(self.weights, features))
            if best is None or value > best[0]:
                best = (value, way)
        return best[1] if best else None

    # --- the fit

    def examples(self, lexicon: list[tuple[str, str]], rng: random.Random, count: int = FIT_WORDS) -> list[tuple[str, str, str]]:
        """(respelled word, language of the page, word): lexicon words, names, foreign words, codes and Roman numbers."""
        out = []
        words = {lang: sorted({w for w, other in lexicon if other == lang}) for lang in sorted({lang for _, lang in lexicon})}
        for lang, own in words.items():
            others = [w for other in words if self.page_script(other) not in ("other", self.page_script(lang)) for w in words[other]]
            for _ in range(count):
                w = rng.choice(own)
                out.append((respelled(w, rng), lang, w))
                name = (w[: max(2, len(w) // 2)] + rng.choice(own)[-3:]).capitalize()
                if _script(name[0]) == self.page_script(lang):
                    out.append((respelled(name, rng, 2), lang, name))
                if others:
                    w = rng.choice(others)
                    if len(w) > 4:
                        out.append((respelled(w, rng, 1), lang, w))
                letters = "".join(rng.choice("ABCEHKMNOPTXYS") for _ in range(rng.randint(1, 3)))
                code = letters + rng.choice(["", "-"]) + str(rng.randint(1, 999)) + rng.choice(["", "", "a", "c"])
                out.append((respelled(code, rng), lang, code))
                roman = rng.choice(["IX", "XI", "XIX", "MCM", "XXI", "CX", "MM", "XC", "IC"])
                out.append((respelled(roman, rng, 1), lang, roman))
        return [e for e in out if e[0] != e[2]]

    def _fit(self, lexicon: list[tuple[str, str]]) -> None:
        """Weights by an averaged perceptron over the paths of respelled words; those whose truth is no path teach nothing."""
        rng = random.Random(17)
        rows = [(self.candidates(seen, lang), truth) for seen, lang, truth in self.examples(lexicon, rng)]  # paths by the first weights
        weights, total, steps = list(self.weights), [0.0] * len(self.weights), 0
        for _ in range(FIT_ROUNDS):
            rng.shuffle(rows)
            for paths, truth in rows:
                right = next((f for way, f in paths if way == truth), None)
                if right is None:
                    continue
                scored = [(sum(w * x for w, x in zip(weights, f)), f) for _, f in paths]
                value = sum(w * x for w, x in zip(weights, right))
                worst = max((s for s in scored if s[1] is not right), default=None, key=lambda s: s[0])
                if worst is not None and worst[0] > value - 1.0:
                    weights = [w + 0.1 * (a - b) for w, a, b in zip(weights, right, worst[1])]
                total = [t + w for t, w in zip(total, weights)]
                steps += 1
        if steps:
            self.weights = tuple(t / steps for t in total)

    def points(self, text: str, lang: str | None) -> list[str]:
        """What each code point of ``text`` becomes; joined, they are the consistent form."""
        if self.page_script(lang) == "Latin" and _PLAIN_LINE.fullmatch(text):
            return list(text)
        out = plain_points(text)
        # words of the plain text, with the places their characters come from
        start, n = 0, len(out)
        while start < n:
            if out[start] in ("", " "):
                start += 1
                continue
            end, places = start, []
            while end < n and out[end] != " ":
                places += [end] * len(out[end])
                end += 1
            word = "".join(out[start:end])
            settled = self._word(word, lang)
            if settled is not None and settled != word:
                fresh: dict[int, str] = {}
                for place, c in zip(places, settled):
                    fresh[place] = fresh.get(place, "") + c
                for place, c in fresh.items():
                    out[place] = c
            start = end
        return out

    def line(self, text: str, lang: str | None) -> str:
        """The consistent form of a line of words, with one space between them; each distinct word is read once."""
        if self.page_script(lang) == "Latin" and _PLAIN_LINE.fullmatch(text):
            return " ".join(text.split())
        return " ".join(" ".join([self._spelled(w, lang) for w in text.split(" ")]).split())

    def form(self, text: str, lang: str | None) -> str:
        return "".join(self.points(text, lang))


def char_pieces(word: str) -> list[tuple[int, int]]:
    """Where each char of a word begins and ends: a character with its marks, of at most three bytes."""
    out: list[tuple[int, int]] = []
    size = 0
    for i, c in enumerate(word):
        n = len(c.encode("utf-8", "surrogatepass"))
        if out and unicodedata.category(c) in ("Mn", "Me", "Mc") and size + n <= 3:
            out[-1] = (out[-1][0], i + 1)
            size += n
        else:
            out.append((i, i + 1))
            size = n
    return out


def read_lexicon(lexicon: DataFrame) -> list[tuple[str, str]]:
    """The rows of a lexicon table (word, lang); refuses one beyond MAX_LEXICON_WORDS."""
    rows = lexicon.select("word", "lang").filter("word IS NOT NULL AND lang IS NOT NULL").distinct().limit(MAX_LEXICON_WORDS + 1).collect()
    if len(rows) > MAX_LEXICON_WORDS:
        raise ValueError(f"a lexicon of more than {MAX_LEXICON_WORDS} words is no closed table")
    return sorted((r.word, r.lang) for r in rows)


_SPELLED = T.StructType(
    [
        T.StructField("word_str", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("form", T.StringType()),
        T.StructField("targets", T.ArrayType(T.StringType())),
    ]
)


def inconsistent_spellings(spellings: DataFrame, lexicon: DataFrame, consistent: Consistent | None = None) -> DataFrame:
    """Of distinct (word_str, lang) rows, those not in their consistent form.

    Adds ``form`` and ``targets``: what each char of the word becomes, empty for
    one that has no place in the form.
    """
    shared = lexicon.sparkSession.sparkContext.broadcast(consistent or Consistent(read_lexicon(lexicon)))

    def run(batches):
        consistent = shared.value
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for word, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                points = consistent.points(word, lang)
                form = "".join(points)
                if form != word:
                    for column, x in zip(out, (word, lang, form, ["".join(points[a:b]) for a, b in char_pieces(word)])):
                        column.append(x)
            types = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=_SPELLED.names)

    return spellings.select("word_str", "lang").mapInArrow(run, _SPELLED)


def changed_words(words: DataFrame, books: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words not in their consistent form: page_id, line_id, word_id, word_str, form, targets.

    ``words`` needs page_id, book_id, line_id, word_id and word_str. Each distinct
    spelling of a language is settled once, however often it occurs; null and
    empty words are no cases; repeated rows give one.
    """
    consistent = Consistent(read_lexicon(lexicon))
    langs = books.select(F.col("book_id").alias("_book"), "lang")
    rows = words.select("page_id", "book_id", "line_id", "word_id", "word_str").join(langs, F.col("book_id") == F.col("_book"), "left")
    # plain ASCII is consistent but on pages in another script; there, words of its letters and plain signs are
    letters = F.col("word_str").rlike("[^ -~]")
    needed = letters
    for lang, script in sorted(consistent._page.items()):
        if script in _BLOCKS:
            needed = F.when(F.col("lang") == lang, F.col("word_str").rlike(f"[A-Za-z0-9]|[^ -~{_BLOCKS[script]}]")).otherwise(needed)
    rows = rows.filter(needed).select("page_id", "line_id", "word_id", "word_str", F.coalesce("lang", F.lit("")).alias("lang"))
    spellings = rows.select("word_str", "lang").distinct()
    spellings = spellings.repartition(python_partitions(spellings), "word_str", "lang")
    spelled = inconsistent_spellings(spellings, lexicon, consistent)
    joined = rows.join(spelled, ["word_str", "lang"])
    return joined.select("page_id", "line_id", "word_id", "word_str", "form", "targets").dropDuplicates(["page_id", "line_id", "word_id"])


def changed_chars(changed: DataFrame, chars: DataFrame) -> DataFrame:
    """Chars of changed words that are not, as they stand, the char of the form at their place."""
    keys = ["page_id", "line_id", "word_id"]
    rows = chars.select(*keys, "char_id", "char_str").filter("char_str IS NOT NULL")
    # the changed words are the smaller side; a word has few chars, so no key is hot
    joined = rows.join(changed.select(*keys, "targets").hint("shuffle_hash"), keys)
    target = F.try_element_at("targets", F.col("char_id") + 1)
    return joined.filter(F.coalesce(target, F.lit("")) != F.col("char_str")).select(*keys, "char_id").distinct()
