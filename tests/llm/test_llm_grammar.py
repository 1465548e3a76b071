"""The composed grammar against its definition, and the sentences it is for."""

import numpy as np
import pyarrow as pa
import pytest

from glyphmill.llm import toxicity
from glyphmill.llm.tokens import NOT_LETTERS
from glyphmill.llm.tokens import words as tokens
from grammar_by_hand import sums as by_hand

LISTS = {"insult": toxicity.INSULTS, "threat": toxicity.THREATS, "target": toxicity.TARGETS, "negation": toxicity.NEGATIONS, "report": toxicity.REPORTS}


def classify(token):
    return next(((name, 1.0) for name, own in LISTS.items() if token.lower() in own), ("other", 0.0))


def grammar():
    return toxicity.Grammar({}, toxicity._PRIOR)


def sums(text):
    return grammar().sums(next(tokens(toxicity.flat(pa.array([text])), gaps=NOT_LETTERS))[1])[0].tolist()


@pytest.mark.parametrize(
    "text, expected",
    [
        ("what a stupid thing", "plain"),
        ("You are an IDIOT. you", "targeted"),
        ("this is not stupid", "negated"),
        ("you are not stupid", "negated"),
        ("it says that trash sells", "reported"),
        ('she said: "you are an idiot"', "reported"),
        ("she said: “you are an idiot”", "reported"),
        ("we will kill you; kill. you", "threat"),
        ("you, I will destroy", "threat"),
        ("I will not hurt you", "excused"),
        ("he said he will kill you", "excused"),
        ("kill the process before you restart", None),
        ("you beat, they said", None),
        ("", None),
    ],
)
def test_sentences(text, expected):
    assert sums(text) == [float(name == expected) for name in toxicity.SUMS]


def test_the_prior_ranks_them():
    score = lambda text: float(grammar().scores(np.array([sums(text)]))[0])
    assert score("you are an idiot") > 0.5 > score("an idiot") >= 0.3
    for text in ("you are not stupid", 'she said "you are an idiot"', "I will not hurt you", "he said he will kill you", "kill the process before you restart"):
        assert score(text) < 0.15


def test_composition_is_the_definition():
    rng = np.random.default_rng(6)
    pool = ["idiot", "trash", "kill", "hurt", "you", "they", "not", "never", "said", "told", "plain", "words", "here"]
    for _ in range(1500):
        text = "".join(str(rng.choice(pool)) + str(rng.choice([" ", " ", " ", " ", ", ", ": ", ' "', "” ", ". ", "; ", "\n"])) for _ in range(rng.integers(1, 25)))
        assert sums(text) == by_hand(text, classify), text


def test_composed_tables_hold_only_reachable_states():
    table, products = toxicity.compose([toxicity.target(), toxicity.negation(), toxicity.report()])
    assert len(table) == len(products) < 6 * (toxicity.SCOPE + 1) * 2 and products[0] == (0, 0, 0)
    assert all(len(row) == toxicity.SYMBOLS and 0 <= min(row) and max(row) < len(table) for row in table)


def test_long_texts_and_odd_rows(spark):
    long = "plain words " * 60_000 + "you idiot " + "other " * 1000
    rows = [(1, long, "x"), (2, None, "x"), (3, "", "x"), (None, "you idiot", "x"), (1, long, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = toxicity.scored(docs, grammar()).collect()
    assert len(got) == 5 and sorted(r.targeted for r in got) == [0, 0, 1, 1, 1]
    kept = toxicity.keep_clean(docs, grammar())
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
