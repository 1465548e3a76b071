"""The greedy parse: factors tile, are as long as their diagonals allow, and decide which words go."""

import numpy as np

from glyphmill.llm import substring_dedup


def text(seed, n):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 10**9, n)]


def runs_of(i, docs, size):
    """Maximal runs of windows along the diagonal of each window's first place, word by word."""
    first = {}
    for j, w in docs:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, (j, k)), (j, k))
    own = dict(docs)[i]
    diagonals = {}
    for k in range(len(own) - size + 1):
        j, at = first[tuple(own[k : k + size])]
        if j < i:
            diagonals.setdefault((j, at - k), set()).update(range(k, k + size))
    return diagonals


def test_factors_tile_and_decide(spark):
    a, b, c = text(1, 160), text(2, 200), text(3, 40)
    docs = [(1, a), (2, a[100:] + b), (3, c + a[:100] + b[:30] + c), (4, a[20:] + b[:15] + c[:20]), (5, b[40:] + a[:60] + a[11:130]), (6, c[:10] + a[:60] + c[10:20]), (7, a), (8, text(9, 49)), (9, c + b[100:] * 2), (10, a[:100] + a[40:160])]
    rows = [(i, " ".join(w), "clash") for i, w in docs] + [(7, " ".join(a), "clash")] * 30 + [(11, None, "x"), (12, "", "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(4)
    got = substring_dedup.dedup_substrings(table).collect()
    assert len(got) == len(rows)
    some = 0
    for r in got:
        own = dict(docs).get(r.doc_id, [])
        edges = [0, *(f.hi for f in r.factors)]
        assert [f.lo for f in r.factors] == edges[:-1] and edges[-1] == len(own) == r.n_words
        assert all(f.lo < f.hi for f in r.factors)
        diagonals = runs_of(r.doc_id, docs, 50) if own else {}
        covered = set().union(*diagonals.values())
        gone = {k for f in r.factors if f.ref_doc is not None for k in range(f.lo, f.hi)}
        assert gone == covered and r.n_removed == len(gone)
        assert r.kept_text.split() == [w for k, w in enumerate(own) if k not in gone]
        for f in r.factors:
            if f.ref_doc is None:
                assert not covered & set(range(f.lo, f.hi))
                continue
            some += 1
            ref = dict(docs)[f.ref_doc]
            assert f.ref_doc < r.doc_id and own[f.since : f.hi] == ref[f.ref_lo - (f.lo - f.since) :][: f.hi - f.since] and f.hi - f.since >= 50
            for words in diagonals.values():  # no diagonal goes on for longer from here
                if f.lo in words:
                    end = f.lo
                    while end in words:
                        end += 1
                    assert end <= f.hi
    assert some > 10


def test_a_short_factor_counts_with_its_run():
    found = substring_dedup.parse(150, [(0, 100, 1, 5), (40, 120, 2, 0), (130, 150, 3, 0)])
    assert [(f["lo"], f["hi"], f["ref_doc"], f["since"]) for f in found] == [(0, 100, 1, 0), (100, 120, 2, 40), (120, 130, None, None), (130, 150, 3, 130)]
    assert substring_dedup.parse(0, []) == [] and substring_dedup.parse(3, [])[0]["ref_doc"] is None
