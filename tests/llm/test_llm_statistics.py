"""Quality's statistics word by word; odd tables for quality and language."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import language, learning, quality
from glyphmill.llm.tokens import words as tokens

SYMBOLS = set("#$%&*@^~_<>{}[]\\")


def by_hand(text):
    """The numbers that quality.STATS names, from their definitions."""
    raw = (text or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, chars = len(w), max(1, len(raw))
    some = max(1, n)
    count = Counter(w)
    kinds = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "bang": b"!", "bar": b"|", "symbol": "".join(SYMBOLS).encode(), "stop": b".,;:?"}
    of = lambda x, kind: sum(c in kinds[kind] for c in x)
    shout = [(of(x, "upper") >= 2 and not of(x, "lower")) or of(x, "bang") >= 2 for x in w]
    bars = [len(x) > 0 and of(x, "bar") == len(x) for x in w]
    symbol = [of(x, "symbol") >= 2 for x in w]
    repeat = [i > 0 and w[i] == w[i - 1] for i in range(n)]
    same = [count[x] >= 3 and len(x) > 6 for x in w]

    def worst(marks):
        return max((sum(marks[i : i + 50]) / max(25, len(marks[i : i + 50])) for i in range(0, n, 50)), default=0.0)

    out = {"words": math.log1p(n), "bytes": math.log1p(len(raw)), "word_bytes": sum(map(len, w)) / some, "lines": raw.count(b"\n") / some}
    out |= {"distinct": math.log1p(len(count)) / math.log1p(n) if n else 0.0, "commonest": max(count.values(), default=0) / some, "repeats": sum(repeat) / some, "again": sum(same) / some}
    out |= {f"{k}_share": of(raw, k) / chars for k in kinds}
    out |= {"shout_words": sum(shout) / some, "bar_words": sum(bars) / some, "symbol_words": sum(symbol) / some}
    out |= {"worst_repeats": worst(repeat), "worst_shout": worst(shout), "worst_bar": worst(bars), "worst_symbol": worst(symbol), "worst_same": worst(same)}
    return [out[k] for k in quality.STATS]


def odd_texts():
    rng = np.random.default_rng(12)
    pool = ["plain", "words", "HERE", "NO!!", "|", "||", "x|y", "#a$", "a_b", "repeated", "repeated", "café", "日本語", "7", "12:30", "!", "."]
    texts = ["", " \n\t", "one", "ONE", "same same same", None]
    texts += [str(rng.choice([" ", "\n"])).join(str(rng.choice(pool)) for _ in range(n)) for n in (3, 24, 25, 49, 50, 51, 99, 100, 130, 301)]
    return texts + ["deadbeef7 " * 200 + "\n", " ".join(f"w{i}" for i in range(40_000)), "x" * 300_000]


def test_statistics_are_their_definitions():
    texts = odd_texts()
    got = np.concatenate([quality.statistics(w) for _, w in tokens(pa.array(texts, pa.string()), most=1 << 12)])
    assert got.shape == (len(texts), len(quality.STATS))
    for text, row in zip(texts, got, strict=True):
        assert row == pytest.approx(by_hand(text), abs=1e-9), (text or "")[:40]


def test_statistics_of_a_table(spark):
    rows = [(i, t, 0.5, "x") for i, t in enumerate(odd_texts())] + [(None, "one two", 0.5, "x"), (2, "one", 0.5, "x"), (2, "one", 0.5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, words string").repartition(3)
    got = quality.with_statistics(docs).collect()
    assert len(got) == len(rows)
    assert sorted(round(r.words, 9) for r in got) == sorted(round(by_hand(r[1])[0], 9) for r in rows)
    assert len({tuple(r) for r in got if r.doc_id == 2}) == 1


def letters(k):
    return "".join(chr(0x4E00 + 30 * k + i) for i in range(30))


def prose(seed, n, alphabet):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list(alphabet), rng.integers(2, 6))) for _ in range(n))


def test_small_samples_do_not_lose(spark):
    """A language of few texts against one with many, over the same letters in other orders."""
    rng = np.random.default_rng(5)
    lexicon = {k: ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(60)] for k in ("big", "few")}
    text = lambda k, seed, n: " ".join(np.random.default_rng(seed).choice(lexicon[k], n))
    samples = {"big": text("big", 1, 4000), "few": text("few", 2, 90)}
    parser = language.Parser(samples)
    fresh = [(k, text(k, 100 + i, 30)) for i in range(60) for k in ("big", "few")]
    said = parser.predict([t for _, t in fresh])[0]
    assert np.mean([a == k for a, (k, _) in zip(said, fresh, strict=True)]) > 0.95
    phrases, _ = parser.phrases([fresh[1][1]])
    assert parser.bits.tolist() == [np.log2(len(samples[k])) for k in ("big", "few")] and phrases.shape == (2, 1)


def test_long_texts_repeats_and_other_columns(spark):
    rows = [(i, prose(i, 40, letters(i % 3)), f"l{i % 3}", 9.0, "x") for i in range(90)]
    rows += [(200, prose(7, 60_000, letters(1)), None, 9.0, "x"), (201, prose(8, 30, letters(2)), None, 9.0, "x"), (201, prose(8, 30, letters(2)), None, 9.0, "x"), (None, prose(9, 30, letters(0)), None, 9.0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string").repartition(4)
    got = language.identified(docs, language.fit(docs)).where("doc_id is null or doc_id >= 200").collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == [("200", "l1"), ("201", "l2"), ("201", "l2"), ("None", "l0")]
    assert len({r.score for r in got if r.doc_id == 201}) == 1


def test_samples_are_bounded_in_bytes(spark, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("word "), 200), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    whole, *_ = learning.labelled_sample(docs, labels, "toxic")
    monkeypatch.setattr(learning, "MOST_BYTES", 100_000)
    texts, y, _ = learning.labelled_sample(docs, labels, "toxic")
    assert 20 < len(texts) < 180 < len(whole) and set(texts) <= set(whole) and set(y) == {0, 1} and all(t.startswith("word word") for t in texts)
