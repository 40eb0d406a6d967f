"""Languages of few rows among many: each is in the model and is found again."""

import random

import pytest

from cloudloom.llm import language_id


def _texts(rnd, n_languages):
    """A maker of prose for each made-up language, each with its own syllables."""
    makers = {}
    for i in range(n_languages):
        syllables = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzäöüßéñ") for _ in range(3)) for _ in range(25)]
        makers[f"x{i:02d}"] = lambda n, s=syllables: " ".join(rnd.choice(s) + rnd.choice(s) for _ in range(n))
    return makers


def test_rare_languages_are_identified(spark):
    rnd = random.Random(21)
    makers = _texts(rnd, 40)
    train = [(lang, makers[lang](60)) for lang in makers for _ in range(900 if lang in ("x00", "x01") else 3)]
    train += [(None, "no label"), ("x02", None)]
    model = language_id.fit(spark.createDataFrame(train, "lang string, text string").repartition(3))
    assert model.names == sorted(makers) and abs(sum(model.shares) - 1) < 1e-9
    rows = [(i, lang, makers[lang](80), None, "a.example.com") for i, lang in enumerate(list(makers) * 5)]
    rows += [(900, None, None, None, None), (901, None, "x", None, "a.example.com")]
    got = language_id.language_id(spark.createDataFrame(rows, "id long, want string, text string, declared string, host string"), model).collect()
    assert len(got) == len(rows)
    assert all(r.lang == r.want and r.text_lang == r.want for r in got if r.want)
    assert all(0 < r.p <= 1 for r in got)


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MODEL_BYTES", 8 * language_id.BINS * 3)
    rows = [(f"x{i}", "some text") for i in range(4)]
    assert language_id.fit(spark.createDataFrame(rows[:3], "lang string, text string")).names == ["x0", "x1", "x2"]
    with pytest.raises(ValueError, match="MODEL_BYTES"):
        language_id.fit(spark.createDataFrame(rows, "lang string, text string"))
