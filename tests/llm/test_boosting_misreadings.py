"""The trees, the ranking of candidates, and its held-out accuracy."""

import random

import numpy as np

from glyphmill.llm import misreadings
from glyphmill.llm.boosting import Booster
from glyphmill.llm.lookalikes import bare, read_lexicon
from tests.conftest import SF_SMALL


def test_booster_learns_and_survives_degenerate_input():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    model = Booster(rounds=80).fit(x[:1500], y[:1500])
    assert ((model.predict(x[1500:]) > 0.5) == (y[1500:] > 0.5)).mean() > 0.93
    assert Booster(rounds=3).fit(np.ones((5, 2)), np.ones(5)).predict(np.zeros((0, 2))).shape == (0,)
    assert Booster(rounds=0).fit(np.zeros((0, 2)), np.zeros(0)).predict(np.ones((1, 2)))[0] < 0.5


def test_sight_distance():
    d = misreadings.sight_distance
    assert d("word", "word") == 0 and d("", "ab") == 2 and d("xxxxxxxxxx", "a") == 4
    assert d("darnp", "damp") == d("mvoice", "invoice") == d("besdrreibt", "beschreibt") == 0.3
    assert abs(d("oldcsf", "oldest") - 0.6) < 1e-9 and d("tachee", "tachée") == 0.3


def test_held_out_accuracy(spark):
    lexicon = [(w, lang) for w, lang in read_lexicon(spark.read.parquet(f"{SF_SMALL}/lexicon.parquet")) if lang in ("en", "de", "fr", "ru")]
    model = misreadings.train_ranker(lexicon[::2])
    rng = random.Random(99)
    right = wrong = total = false = 0
    known = {bare(w) for w, _ in lexicon}
    for word, lang in lexicon[1::2]:
        w = bare(word)
        words = [bare(x) for x, other in lexicon if other == lang]
        for seen, truth in ((misreadings.damaged(w, rng), w), (misreadings._foreign(words, rng), None)):
            if len(w) < 5 or seen in known:
                continue
            near = [x for x in words if abs(len(x) - len(seen)) <= 3 and misreadings.grams(x) & misreadings.grams(seen)]
            score = model.predict(np.array([misreadings.features(seen, x) for x in near])) if near else np.zeros(1)
            best = near[int(score.argmax())] if near and score.max() >= misreadings.ACCEPT else None
            if truth:
                total += 1
                right += best == truth
                wrong += best not in (truth, None)
            else:
                false += best is not None
    assert right / total > 0.9 and wrong / total < 0.03 and false / total < 0.08


def test_candidates_equal_brute_force(spark):
    tokens = ["borcler", "vvith", "xyzzy", "lt", "a", "c6rtificate", "каpтипка"]
    words = ["border", "with", "it", "certificate", "corridor", "in"]
    got = misreadings.candidates(
        spark.createDataFrame([("en", t) for t in tokens], "lang string, token string"),
        spark.createDataFrame([("en", w) for w in words] + [("de", "border")], "lang string, word string"),
        [(w, "en") for w in words] + [("border", "de")],
    )
    # no pair that shares enough is lost; the others are told apart by rank
    got = {tuple(r) for r in got.collect()}
    want = set()
    for t in tokens:
        for w in words:
            shared = len(misreadings.grams(t) & misreadings.grams(w))
            if shared and abs(len(t) - len(w)) <= 3 and shared >= max(1, max(len(t), len(w)) + 1 - 2 * (3 if len(w) >= 5 else 2)):
                want.add(("en", t, w))
    assert want <= got and all(len(misreadings.grams(t) & misreadings.grams(w)) for _, t, w in got)
