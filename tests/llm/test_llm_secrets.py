"""Novelty: random keys against ordinary identifiers; spans in odd and very long texts."""

import random
import re
import time

import numpy as np
import pytest

from glyphmill.llm import secrets

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {"hex": DIGITS + "ABCDEF", "base32": UPPER + "234567", "base62": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/", "base36": LOWER + DIGITS}
#: No word of the dictionary's.
OTHER = "market river garden winter summer village teacher student history science doctor hospital kitchen travel weather planet animal forest island mountain bridge engine metal paper pencil mirror ticket station airport".split()


def found(token, lead="Please use the authorization "):
    text = f"Some prose stands here, and more of it. {lead}{token} and go on with the next page, as before."
    return [text[s:e] for s, _, e, _ in secrets.novel_spans(text, [])] == [token]


def mixed(token):
    return re.search("[0-9]", token) and re.search("[A-Za-z]", token)


def test_precision_and_recall():
    keys = ["".join(random.Random(f"{name}{n}{i}").choices(a, k=n)) for name, a in ALPHABETS.items() for n in (20, 24, 32, 40, 64, 128) for i in range(40)]
    keys = [k for k in keys if mixed(k) and k.strip("+/") == k]
    recall = np.mean([found(k) for k in keys])
    rng, known, new = random.Random(9), [], []
    while len(known) < 500 or len(new) < 500:
        for words, out in ((secrets.WORDS, known), (OTHER, new)):
            token = secrets.identifier(rng, words)
            if len(token) >= secrets.LEAST and mixed(token) and not secrets._SENSITIVE.search(token):
                out.append(token)
    false = [np.mean([found(t) for t in group]) for group in (known, new)]
    print(f"recall {recall:.3f}, identifiers reported: {false[0]:.3f} of known words, {false[1]:.3f} of unknown words")
    assert recall >= 0.985 and false[0] <= 0.02 and false[1] <= 0.12


@pytest.mark.parametrize("token", ["customer-account-2024-summary-page", "chapter12section34page56", "how-to-reset-your-windows10-login", "configuration_version_1_" * 8, "client_secret_default_environment_localhost_number_2_" * 4, "0A" * 60])
def test_ordinary_tokens_are_not_reported(token):
    assert not secrets.novel_spans(f"private key {token} end", [])


@pytest.mark.parametrize("alphabet", ["hex", "base32"])
def test_long_random_keys_are_novel(alphabet):
    for size in (20, 64, 96, 128, 256, 512):
        for seed in range(20):
            token = "".join(np.random.default_rng(seed).choice(list(ALPHABETS[alphabet]), size))
            text = f"Authorization: Bearer {token} and more"
            assert [s[:3] for s in secrets.novel_spans(text, [])] == [(22, 3, 22 + size)], (size, seed)


def test_what_stands_around_counts():
    key = "zq8Xk1v9LmP3rT7w2Bc5"
    assert secrets.novelty(f"token {key} end", 6, 26) >= 15
    around = "thshed aeredwher to andanershea oninti thntin hest the clo. "
    token = "thshed-aeredwher7-andanershea"
    near, far = around * 6 + f"token {token} end", "x" * 360 + f"token {token} end"
    assert secrets.novelty(near, 366, 366 + len(token)) < 0.6 * secrets.novelty(far, 366, 366 + len(token))
    twice = f"token {key} and later on, after some more words, once again the token {key} end"
    assert [s for s, *_ in secrets.novel_spans(twice, [])] == [6, twice.rindex(key)]


def test_spans_beside_known_ones():
    keys = ["zq8Xk1v9LmP3rT7w2Bc5", "Hs63bQzp0XwEn4Yt8Jv1", "Kd5fWu2mRx9gTb7cNz3e"]
    text = f"secret {keys[0]} token {keys[1]} api-key-{keys[2]}"
    assert [text[s:e] for s, _, e, _ in secrets.novel_spans(text, [])] == keys
    assert [text[s:e] for s, _, e, _ in secrets.novel_spans(text, [(0, 0, 8), (40, 2, 45)])] == keys[2:]
    assert [text[s:e] for s, _, e, _ in secrets.novel_spans(text, [(0, 0, 40), (2, 2, 3), (62, 2, 64)])] == []


def test_long_and_repeated_texts_take_linear_time(spark):
    key = "zq8Xk1v9LmP3rT7w2Bc5"
    texts = ["token" * 200_000, "token 1a " * 100_000 + f"secret {key}", "password=abcdef " * 50_000, "a" * 2_000_000, f"secret {key} " * 3]
    begin = time.perf_counter()
    base, every = secrets.scan(texts[1])
    assert [e[1] for e in every if e[1] == 3] == [3]
    for t in texts:
        secrets.candidates(t)
        list(secrets.candidates(t))
    assert time.perf_counter() - begin < 20
    rows = [(1, texts[4], "x"), (1, texts[4], "x"), (None, texts[4], "x"), (2, None, "x"), (3, "", "x"), (4, texts[2], "x")]
    got = secrets.found_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(got) == 6 and len({(r.spans, tuple(r.novelties)) for r in got if r.doc_id in (1, None)}) == 1
    assert [r.n_assign for r in got if r.doc_id == 4] == [50_000] and all(r.spans == "" for r in got if r.doc_id in (2, 3))
