"""Shards: balance, places, hot texts of little weight, maps that are edited."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from glyphmill.llm import sharding


def checked(got, n):
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(got) == n and all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_half_of_the_texts_are_null(spark):
    table = spark.range(20_000).select("id", F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("some text "), F.sha2(F.col("id").cast("string"), 256))).alias("text"), F.lit("x").alias("part"), F.lit(1).alias("rank")).repartition(5)
    frame, _ = sharding.sharded(table)
    sizes = checked(frame.collect(), 20_000)
    assert len(sizes) == 8 and max(sizes.values()) < 1.02 * min(sizes.values())
    plan = frame._jdf.queryExecution().toString()
    assert "virtual_slot" in plan
    parts = sharding.sharded(table, whole_rows=True)[0]
    assert parts.select("row.*").columns == table.columns
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.sharded(table.repartition(3))[0].collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in frame.collect()}
    out = sharding.sharded_documents(table)
    assert {"part", "rank", "id"} <= set(out.columns) and out.count() == 20_000


def test_no_part_of_a_hot_slot_holds_much(spark, monkeypatch):
    """Ranks are given part by part: the largest part is a small share even where one text has a third of all rows."""
    seen = []
    keep = spark.createDataFrame

    def spy(data, *rest, **more):
        if rest and rest[0] == "s int, p int, shard int, begin long":
            seen.extend(data)
        return keep(data, *rest, **more)

    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *rest, **more: spy(data, *rest, **more))
    table = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.repeat(F.sha2(F.col("id").cast("string"), 256), 3)).alias("text"))
    got = sharding.sharded(table)[0].collect()
    checked(got, 30_000)
    assert len({(s, p) for s, p, *_ in seen}) == len(seen) <= 2 * sharding.SLOTS
    assert len(Counter(r.virtual_slot for r in got if r.size == 1)) == 1  # equal texts stay together, being light
    assert sum(1 for s, *_ in seen if s == next(r.virtual_slot for r in got if r.size == 1)) > 500


def test_a_stored_map_is_edited(spark, tmp_path):
    folder = f"{tmp_path}/map"
    table = spark.range(5000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    one, where = sharding.sharded(table, folder=folder)
    first = sharding.load_map(spark, folder)
    assert where == folder and first["version"] == 1
    more = table.unionByName(spark.range(5000, 5600).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")))
    two = checked(sharding.sharded(more, folder=folder)[0].collect(), 5600)
    second = sharding.load_map(spark, folder)
    moved = sum(a != b for a, b in zip(first["shard_of_slot"], second["shard_of_slot"], strict=True))
    assert second["version"] == 2 and moved < sharding.SLOTS // 20 and max(two.values()) < 1.05 * min(two.values())
    three = checked(sharding.sharded(more, shards=9, folder=folder)[0].collect(), 5600)
    third = sharding.load_map(spark, folder)
    changed = {b for a, b in zip(second["shard_of_slot"], third["shard_of_slot"], strict=True) if a != b}
    assert third["version"] == 3 and changed == {8} and max(three.values()) < 1.05 * min(three.values())
    assert sharding.load_map(spark, folder, 1) == first and sharding.load_map(spark, f"{tmp_path}/none") is None


def test_slots_go_to_the_lightest_shard(spark):
    sizes = {k: (k * 7919) % 1000 for k in range(sharding.SLOTS)}
    load, expected = [0] * 8, [0] * sharding.SLOTS
    for k in sorted(sizes, key=lambda k: (-sizes[k], k)):
        expected[k] = load.index(min(load))
        load[expected[k]] += sizes[k]
    assert sharding.assign(sizes, 8) == expected and max(load) - min(load) < 1000


def test_empty_and_repeated_rows(spark):
    schema = "doc_id long, text string, shard string"
    assert sharding.sharded_documents(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "same", "x")] * 40 + [(None, None, "x")] * 40 + [(2, "ü" * 50_000, "x")]
    got = sharding.sharded_documents(spark.createDataFrame(rows, schema).repartition(4)).collect()
    checked(got, 81)
    assert {r.size for r in got} == {5, 1, 100_001} and len({r.shard for r in got if r.doc_id == 2}) == 1
