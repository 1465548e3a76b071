"""Quality by a sparse rule ensemble.

1. Statistics. One pass over whole texts gives each document's numbers (STATS): lengths, character classes,
   repetition, and the worst block of BLOCK words for each kind of junk.
2. Rules. Shallow trees are boosted on a bounded labelled sample (learning.SAMPLE of each class); every path from a root
   to a node is a conjunction of threshold tests on statistics.
3. Weights. A lasso logistic regression over all rules, by accelerated proximal gradient, leaves few of them.
4. Compilation. The rules left become one Spark column expression over the statistics; scoring is a projection.

Cases. Null and empty texts: all statistics 0, scored like any other. Null doc_id: held out. Repeated rows: scored
alike. No labels, or one class only: no rules, the score is the sample's share of good texts (0.5 for none).
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.learning import held_out, labelled_sample
from glyphmill.llm.shared import frugal, give_back, lean
from glyphmill.llm.tokens import Words, words

BLOCK = 50
_KINDS = ("upper", "lower", "digit", "bang", "bar", "symbol", "stop")
STATS = ("words", "bytes", "word_bytes", "lines", "distinct", "commonest", "repeats", "again", *(f"{k}_share" for k in _KINDS), "shout_words", "bar_words", "symbol_words", "worst_repeats", "worst_shout", "worst_bar", "worst_symbol", "worst_same")
_OF = np.zeros((len(_KINDS), 256), bool)
for _i, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!", "|", "#$%&*@^~_<>{}[]\\", ".,;:?")):
    _OF[_i, [ord(c) for c in _chars]] = True

TREES, DEPTH, CUTS = 40, 3, 32


def _per(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive edges."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return sums[edges[1:]] - sums[edges[:-1]]


def statistics(w: Words) -> np.ndarray:
    """A row of STATS for each text of a slice."""
    docs = len(w.first) - 1
    n = np.diff(w.first).astype(float)
    size = np.diff(w.offsets).astype(float)
    some, chars = np.maximum(n, 1), np.maximum(size, 1)
    hashes = w.hashes()
    inside = np.concatenate([[0], np.cumsum(w.raw == 10)])
    lines = (inside[w.offsets[1:]] - inside[w.offsets[:-1]]) / some
    by_word, shares = [], []
    for mask in _OF:
        sums = np.concatenate([[0], np.cumsum(mask[w.raw])])
        by_word.append(sums[w.ends] - sums[w.starts])
        shares.append((sums[w.offsets[1:]] - sums[w.offsets[:-1]]) / chars)
    upper, lower, _, bang, bar, symbol, _ = by_word
    length = w.ends - w.starts
    shout = ((upper >= 2) & (lower == 0)) | (bang >= 2)
    bars = (bar > 0) & (bar == length)
    symbols = symbol >= 2
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[w.first[:-1][n > 0]] = False
    distinct, commonest, again = np.zeros(docs), np.zeros(docs), np.zeros(docs)
    repeated = np.zeros(len(hashes), bool)
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        if b > a:
            _, place, counts = np.unique(hashes[a:b], return_inverse=True, return_counts=True)
            # On a logarithmic scale the variety of words hardly depends on a text's length.
            distinct[i], commonest[i] = np.log1p(len(counts)) / np.log1p(b - a), counts.max() / (b - a)
            # Words longer than six bytes that come three times or more.
            repeated[a:b] = (counts[place] >= 3) & (length[a:b] > 6)
    again = _per(repeated, w.first) / some
    block = np.unique(np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)] + [[len(hashes)]]).astype(np.int64)) if len(hashes) else np.zeros(1, np.int64)
    worst = np.zeros((5, docs))
    if len(block) > 1:
        owner = np.searchsorted(w.first, block[:-1], "right") - 1
        width = np.maximum(np.diff(block), BLOCK // 2)
        for row, mask in zip(worst, (same, shout, bars, symbols, repeated), strict=True):
            np.maximum.at(row, owner, _per(mask, block) / width)
    return np.column_stack([np.log1p(n), np.log1p(size), _per(length, w.first) / some, lines, distinct, commonest, _per(same, w.first) / some, again, *shares, *(_per(m, w.first) / some for m in (shout, bars, symbols)), *worst])


def with_statistics(documents: DataFrame) -> DataFrame:
    """doc_id and a double column for each of STATS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, w in words(batch.column(1)):
                stats = statistics(w)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(stats)), *(pa.array(c) for c in stats.T)], names=["doc_id", *STATS])

    return lean(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), ", ".join(["doc_id long", *(f"{s} double" for s in STATS)]))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold) for each test


def tree_rules(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> list[Rule]:
    """Paths of boosted trees: each tree fits the logistic gradient left by those before it."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, CUTS + 1)[1:-1])) for c in x.T]
    coded = [np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)]  # v <= cuts[k] where code <= k
    margin = np.zeros(len(y))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = weights * (y - p), weights * p * (1 - p) + 1e-6
        leaves: list[tuple[np.ndarray, Rule]] = [(np.arange(len(y)), ())]
        for _ in range(DEPTH):
            split = []
            for rows, rule in leaves:
                g, h = slope[rows], curve[rows]
                base, best = g.sum() ** 2 / (h.sum() + 1), (1e-3, None)
                for k, (code, cut) in enumerate(zip(coded, cuts, strict=True)):
                    if len(cut) == 0 or len(rows) < 10:
                        continue
                    gl = np.cumsum(np.bincount(code[rows], g, len(cut) + 1))[:-1]
                    hl = np.cumsum(np.bincount(code[rows], h, len(cut) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - base
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (gain[at], (k, at))
                if best[1] is None:
                    split.append((rows, rule))
                    continue
                k, at = best[1]
                low = coded[k][rows] <= at
                for above, part in ((False, rows[low]), (True, rows[~low])):
                    path = (*rule, (k, above, float(cuts[k][at])))
                    rules[path] = None
                    split.append((part, path))
            leaves = split
        for rows, rule in leaves:
            if rule:
                margin[rows] += 0.3 * slope[rows].sum() / (curve[rows].sum() + 1)
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, k] > cut) if above else (x[:, k] <= cut) for k, above, cut in rule])


def lasso(a: np.ndarray, y: np.ndarray, weights: np.ndarray, penalty: float, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic regression."""
    weights = weights / weights.sum()
    centre = weights @ a
    a = a - centre
    step = 4 / max(1e-9, float(np.linalg.norm(a * np.sqrt(weights)[:, None], 2) ** 2) + 1)
    w, b = np.zeros(a.shape[1]), 0.0
    v, c, t = w, b, 1.0
    for _ in range(rounds):
        r = weights * (1 / (1 + np.exp(-np.clip(a @ v + c, -30, 30))) - y)
        u = v - step * (a.T @ r)
        new, new_b = np.sign(u) * np.maximum(np.abs(u) - step * penalty, 0), c - step * r.sum()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / s * (new - w), new_b + (t - 1) / s * (new_b - b)
        w, b, t = new, new_b, s
    return w, b - float(centre @ w)


class Ensemble:
    def __init__(self, rules: list[tuple[Rule, float]], intercept: float) -> None:
        self.rules, self.intercept = rules, intercept

    def column(self) -> Column:
        """The score as an expression over the columns STATS."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            test = F.lit(True)
            for k, above, cut in rule:
                test = test & ((F.col(STATS[k]) > cut) if above else (F.col(STATS[k]) <= cut))
            total = total + F.when(test, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(documents: DataFrame, labels: DataFrame, penalty: float = 2e-3) -> Ensemble:
    texts, y, weights = labelled_sample(documents, labels, "quality")
    if len(set(y.tolist())) < 2:
        share = float(y[0]) if len(y) else 0.5
        share = min(0.99, max(0.01, share))
        return Ensemble([], float(np.log(share / (1 - share))))
    x = np.concatenate([statistics(w) for _, w in words(pa.array(texts, pa.string()))])
    rules = tree_rules(x, y, weights)
    a = np.column_stack([holds(r, x) for r in rules]).astype(float)
    w, b = lasso(a, y, weights, penalty)
    del texts, x, a
    give_back()
    return Ensemble([(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6], b)


def op2(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_statistics(documents).select("doc_id", held_out().alias("held_out"), model.column().alias("score")).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
