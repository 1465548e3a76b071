"""What the classifiers share: the held-out fold, bounded labelled samples and a logistic fit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import written

#: At most about so many labelled rows of each class, and so many bytes of text in all, are read to fit a model.
SAMPLE, MOST_BYTES = 2500, 96 << 20


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is in the fold that no model learns from; a null id is in it."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(True))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, most: dict[int, int] | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(texts, labels, weights) of about most[class] rows of each class (SAMPLE unless given) outside the held-out fold, chosen by a hash of doc_id.

    Only the chosen ids, bounded by `most`, are broadcast; their texts are read to the driver, fewer of them where all together pass MOST_BYTES. Weights give each
    class its share among all labelled rows. Copies of a text count once.
    """
    most = most or {0: SAMPLE, 1: SAMPLE}
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out())
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(F.coalesce(*(F.when(F.col("y") == y, part < most[y] / n) for y, n in counts.items()), F.lit(False))).groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").where("text is not null").groupBy("text").agg(F.max("y").alias("y"), F.min("doc_id").alias("doc_id"))
    rows = written(rows, "sample")
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if volume > MOST_BYTES:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("bytes")), F.lit(1 << 30)) < (1 << 30) * (MOST_BYTES / volume))
    table: pa.Table = rows.orderBy("doc_id").toArrow()
    texts, y = table.column("text").to_pylist(), np.array(table.column("y").to_pylist(), np.float64)
    got = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    total = max(1, sum(counts.values()))
    weights = np.array([counts.get(int(k), 0) / total / got[int(k)] for k in y])
    return texts, y, weights * len(y)


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, prior: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Coefficients, the intercept last, held to `prior` by a squared penalty; Newton steps."""
    a = np.column_stack([x, np.ones(len(x))]) if len(x) else np.zeros((0, len(prior)))
    beta = prior.astype(float).copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        slope = a.T @ (weights * (p - y)) + strength * (beta - prior)
        curve = (a * (weights * p * (1 - p))[:, None]).T @ a + strength * np.eye(len(prior))
        step = np.linalg.solve(curve, slope)
        beta -= step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return beta
