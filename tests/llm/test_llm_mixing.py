"""The mix: quotas through the tree, repeated rows, what is left over."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from glyphmill.llm import mixing

SCHEMA = "doc_id long, text string, source string, shards string, copies int, row string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 5, "clash") for r in rows], SCHEMA).repartition(3)


def test_the_tree_splits_quotas_exactly(spark, monkeypatch):
    quotas = {"a": 301, "b": 57, None: 30, "c": 1}
    frame = spark.createDataFrame(list(quotas.items()), "source string, quota long")
    monkeypatch.setattr(mixing, "RANGE", 40)
    got = {(r.node, r.source): r.quota for r in mixing.split(frame).collect()}
    monkeypatch.setattr(mixing, "RANGE", 10**6)
    assert got == {(r.node, r.source): r.quota for r in mixing.split(frame).collect()}
    draws = sorted(((hashlib.md5(f"{s or ''}|{i}".encode()).hexdigest()[:15], s is None, s or "", i, s) for s, q in quotas.items() for i in range(1, q + 1)), key=lambda d: d[:4])

    def walk(node, own, depth):
        if depth == 0:
            return {(node, s): n for s, n in Counter(d[4] for d in own).items()}
        half = (len(own) + 1) // 2
        return walk(node * 2, own[:half], depth - 1) | walk(node * 2 + 1, own[half:], depth - 1)

    assert got == walk(0, draws, mixing.LEVELS)


def test_equal_rows_never_overshoot(spark):
    rows = [(1, "w " * 30, "a")] * 50 + [(100 + i, "v " * 40, "b") for i in range(30)] + [(None, "", "b"), (None, None, None), (7, "x y", None), (7, "x y", None), (7, "other", None)]
    docs = table(spark, rows)
    plan = mixing.drawn(docs).collect()
    assert len(plan) == len(rows)
    for source in ("a", "b", None):
        mine = [r for r in plan if r.source == source]
        gap = mine[0].target - sum(r.taken for r in mine)
        free = [r.size for r in mine if r.size and r.times == min(x.times for x in mine)]
        assert gap > -1e-6 and (not free or min(free) > gap or all(r.times == 3 for r in mine if r.size))
        assert all(r.taken <= 3 * r.size and len(r.shards) == r.times for r in mine)
    times = defaultdict(int)
    for r in plan:
        times[r.doc_id, r.source, r.row_hash] += r.times
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = Counter((r.doc_id, r.source, r.h) for r in mixed.withColumn("h", F.xxhash64("text")).collect())
    assert got == {k: v for k, v in times.items() if v}


def test_single_documents_go_by_falling_size(spark):
    rng = np.random.default_rng(2)
    for seed in range(3):
        rows = [(1000 * seed + i, "w " * int(n), f"s{i % 3}") for i, n in enumerate([*rng.integers(0, 9, 200), *rng.integers(100, 900, 6)])]
        plan = mixing.planned(table(spark, rows)).collect()
        state = mixing.drawn(table(spark, rows)).collect()
        for source in ("s0", "s1", "s2"):
            mine = [r for r in plan if r.source == source]
            least = min(len(r.shards) for r in mine)
            front = [r for r in mine if len(r.shards) > least]
            gap = mine[0].target - least * mine[0].source_size - sum(r.size for r in front if least < 3)
            assert sum(r.taken for r in state if r.source == source) <= mine[0].target + 1e-6
            free = [r for r in mine if len(r.shards) == least and r.size and not r.singles]
            assert not free or gap - sum(r.size for r in mine if r.singles) < min(r.size for r in free)


def test_shards_hold_even_numbers_of_draws(spark):
    rows = [(i, "w " * (i % 7 + 1), f"s{i % 5}") for i in range(3000)]
    draws = mixing.block_draws(table(spark, rows).select("source", (F.col("doc_id") % 50).cast("int").alias("block")).distinct().withColumn("passes", F.lit(1)).withColumn("front", (F.col("block") < 20).cast("int")))
    shards = Counter(s for r in draws.collect() for s in r.shards)
    assert len(shards) == 8 and max(shards.values()) - min(shards.values()) <= 1
    assert all(len(r.shards) == 1 + (r.block < 20) for r in draws.collect())


def test_reruns_agree_and_empty_tables(spark):
    rows = [(i % 90, f"t{i % 100} x", f"s{i % 4}" if i % 4 else None) for i in range(400)]
    one, two = (sorted(map(str, mixing.drawn(table(spark, rows).repartition(n)).collect())) for n in (2, 9))
    assert one == two
    nothing = table(spark, rows).where("false")
    assert mixing.drawn(nothing).count() == mixing.mixed_documents(nothing).count() == 0
    blank = table(spark, [(1, None, "a"), (2, "", None)])
    assert [r.taken for r in mixing.drawn(blank).collect()] == [0, 0]
