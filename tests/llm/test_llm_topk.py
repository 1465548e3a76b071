"""Exact search: values of any size, thresholds, pruning, odd columns."""

import numpy as np
from pyspark.sql import functions as F

from glyphmill.llm import topk

LOW, HIGH = -(2**63), 2**63 - 1


def clamp(x):
    return max(LOW, min(HIGH, x))


def test_products_are_exact_or_the_nearest_long():
    rng = np.random.default_rng(3)
    sizes = [1, 2**20, 2**31, 2**40, HIGH]
    a = np.array([[int(rng.integers(-s, s)) for _ in range(9)] for s in sizes for _ in range(6)], np.int64)
    b = np.array([[int(rng.integers(-s, s)) for _ in range(9)] for s in sizes for _ in range(5)] + [[LOW] * 9, [HIGH] * 9], np.int64)
    expected = [[clamp(sum(int(x) * int(y) for x, y in zip(p, q, strict=True))) for q in b] for p in a]
    assert topk._products(a, b).tolist() == expected


def brute(rows, k=5):
    whole = [(i, [clamp(int(np.floor(np.float64(x) * 256))) if abs(x) < 1e300 else (HIGH if x > 0 else LOW) for x in e]) for i, e in rows]
    out = []
    for q, a in whole:
        if q % 50 == 0:
            near = sorted((-clamp(sum(x * y for x, y in zip(a, b, strict=True))), i) for i, b in whole if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


def test_components_beyond_32_bits(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 8)]) for i in range(300)]
    rows += [(i, [float(x) * 2.0 ** int(rng.integers(20, 60)) for x in rng.normal(0, 1, 8)]) for i in range(300, 420)]
    rows += [(420, [2.0**31] * 8), (450, [1e299] * 8), (451, [-1e303] * 8), (452, [1e25, -1e25] * 4)]
    spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, tile string, block int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.op6(spark, str(tmp_path)).collect())
    assert got == brute(rows)


def test_blocks_below_every_threshold_are_not_moved(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 20)
    monkeypatch.setattr(topk, "TILE", 4)
    monkeypatch.setattr(topk, "PACK", 7)
    rng = np.random.default_rng(4)
    rows = [(i, [int(x) for x in rng.integers(0, 5, 6) + (100 if i // 20 % 10 == 3 else 0)]) for i in range(800)]
    v = spark.createDataFrame(rows, "vec_id long, q array<long>").coalesce(1)
    tiles, blocks, pairs = topk.surviving(v, v.where("vec_id % 50 = 0"))
    met = pairs.agg(F.sum("pairs")).first()[0]
    assert blocks.count() == 40 and 0 < met <= 16 * 8 and pairs.count() <= tiles.count() * 8
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(v, v.where("vec_id % 50 = 0")).collect())
    assert got == brute([(i, [x / 256 for x in e]) for i, e in rows])
