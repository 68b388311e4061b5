"""Many languages, rare ones, repeated texts, and long texts that are labelled in pieces."""

import random

import numpy as np
import pytest

from gaugeworks.llm import language


def words_of(rnd, letters):
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(3, 8))) for _ in range(12)]


def test_more_than_256_languages(spark):
    rnd = random.Random(1)
    known = {f"l{i:03d}": words_of(rnd, "abcdefghijklmnopqrstuvwxyz") for i in range(300)}
    rows = [(" ".join(rnd.choices(w, k=40)), x) for x, w in known.items() for _ in range(2)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string").repartition(4))
    assert model.languages == sorted(known)
    held = [(" ".join(rnd.choices(w, k=30)), x) for x, w in known.items()]
    got, scores = model.predict([t for t, _ in held])
    assert np.mean([g == x for g, (_, x) in zip(got, held, strict=True)]) > 0.99
    assert min(scores) > 0.5


def test_rare_language_and_hot_text(spark):
    rnd = random.Random(2)
    hot = "the same text again and again"
    rows = [(hot, "en")] * 3000 + [(" ".join(rnd.choices(words_of(rnd, "abcdefgh"), k=20)), "en") for _ in range(3000)]
    rows += [(" ".join(rnd.choices(words_of(rnd, "qwxyz"), k=20)), "zz") for _ in range(60)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string").repartition(4), sample=500, least=30)
    assert model.predict(["qwx zyx wqz xyzq yyzw", hot])[0] == ["zz", "en"]


@pytest.mark.parametrize("seed", range(3))
def test_pieces_of_a_long_text(spark, monkeypatch, seed):
    rnd = random.Random(seed)
    known = {"aa": words_of(rnd, "abcdefg"), "bb": words_of(rnd, "defghij"), "cc": words_of(rnd, "ghijklm")}
    model = language.fit(spark.createDataFrame([(" ".join(rnd.choices(w, k=60)), x) for x, w in known.items() for _ in range(3)], "text string, lang string"))
    texts = [" ".join(w for _ in range(rnd.randrange(1, 20)) for w in rnd.choices(rnd.choice([*known.values()]), k=rnd.randrange(1, 9))) for _ in range(20)] + ["", None, "123 !", "x"]
    want = model.predict(texts, 2.0)
    monkeypatch.setattr(language, "_LABELLED", 60)
    monkeypatch.setattr(language, "_LEAST_PIECE", 20)
    assert model.predict(texts, 2.0) == want
