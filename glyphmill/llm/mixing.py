"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, with DataFrame functions alone.

Targets. Source weights 1, 2, 3 repeat by code point order (null last). Targets share out the words of all
sources by weight; a target stops at `most` times its source's words and the excess goes to the others by
weight. In closed form: with sources by most * words / weight, all before some place are full and the rest
share what is left.

Quotas. A source's documents are permuted by a hash and cut into BLOCKS blocks. Its quota of block draws is a number of
whole passes over its blocks and those blocks from the front that still fit into its target.

Tree. The sources' quotas are split among output shards from the root down: at every node a random half of its draws
goes left, so the left child's quotas follow the multivariate hypergeometric law, and both children's add up
to the node's. A leaf draws as many blocks of a source as its quota there says; leaves take disjoint stretches of the source's
sequence of block draws. How often a document is taken is the number of leaves' draws that its block is in. Draws are
ranked in ranges of RANGE, so no task ranks a whole node.

Rest. What the target still lacks goes to single documents: those of the block after the last whole one in permuted order
while they fit, then, over all documents of the source not taken there, by falling size, every one that fits. So
no document left would fit. Documents are never cut. The last step walks sizes with their counts, not documents.

Within a shard documents are shuffled by a hash. Only a few words a document are shuffled on the way, never the texts, and a
source of any share of the rows is spread over its blocks and sizes.

Cases. Null and empty texts: size 0, taken 0. Null source: a source, ordered last. Null doc_id: permuted as
one value. Repeated rows (same id, source and text): drawn together with their block; of the single documents as many
copies are taken as fit. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.shared import written

BLOCKS = 1024
LEVELS = 3
RANGE = 50_000
_BITS = 60


def word_count(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return (F.size(parts) - (parts[0] == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def _draw(*parts: Column) -> Column:
    """60 bits of an MD5, which any SQL engine can follow."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def source_targets(rows: DataFrame, most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, size)."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sums.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("full_at", most * F.col("source_size") / F.col("weight"))
    order, everything = Window.orderBy("full_at", F.col("source").asc_nulls_last()), Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rate = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("rate", rate).withColumn("place", F.row_number().over(order))
    level = F.min(F.when(F.col("rate") <= F.col("full_at"), F.struct("place", "rate"))).over(everything)
    return s.withColumn("level", level["rate"]).select("source", "source_size", F.least(most * F.col("source_size"), F.col("level") * F.col("weight")).alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def split(quotas: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(node, source, quota) of the tree's leaves. quotas: (source, quota) of its root.

    All draws are put in one random order. A node owns a stretch of it and leaves the first half to its left child, so
    each half is a random one of the node's draws, and a draw finds its way down by its place alone.
    """
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    width = (1 << _BITS) // max(1, -(-total // RANGE)) + 1
    draws = quotas.select("source", F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota"))).alias("i"))
    draws = draws.withColumn("at", _draw(F.coalesce("source", F.lit("")), F.col("i").cast("string"))).withColumn("range", F.floor(F.col("at") / F.lit(width)))
    counts = {r["range"]: r["n"] for r in draws.groupBy("range").agg(F.count("*").alias("n")).collect()}  # a row per RANGE draws
    begin, offsets = 0, []
    for k in sorted(counts):
        offsets.append((k, begin))
        begin += counts[k]
    offsets = quotas.sparkSession.createDataFrame(offsets, "r long, begin long")
    place = F.row_number().over(Window.partitionBy("range").orderBy("at", F.col("source").asc_nulls_last(), "i")) - 1
    rows = draws.withColumn("place", place).join(offsets, F.col("range") == F.col("r")).select("source", F.lit(0).alias("node"), (F.col("begin") + F.col("place")).alias("place"), F.lit(total).cast("long").alias("size"))
    for _ in range(levels):
        left = F.floor((F.col("size") + 1) / 2)
        right = F.col("place") >= left
        rows = rows.select("source", (F.col("node") * 2 + right.cast("int")).alias("node"), F.when(right, F.col("place") - left).otherwise(F.col("place")).alias("place"), F.when(right, F.col("size") - left).otherwise(left).alias("size"))
    return rows.groupBy("node", "source").agg(F.count("*").alias("quota"))


def block_draws(blocks: DataFrame) -> DataFrame:
    """(source, block, shards): the shard of each draw of a block. blocks: (source, block, passes, front) for every block."""
    here = Window.partitionBy("source")
    blocks = written(blocks.select("source", "block", (F.row_number().over(here.orderBy("block")) - 1).alias("place"), F.count("*").over(here).alias("blocks"), (F.col("passes") + F.col("front")).alias("draws")), "places")
    leaves = split(blocks.groupBy("source").agg(F.sum("draws").alias("quota")).where("quota > 0")).withColumn("end", F.sum("quota").over(here.orderBy("node")))
    leaves = leaves.select(F.col("source").alias("s"), F.col("node").alias("shard"), F.explode(F.sequence(F.col("end") - F.col("quota"), F.col("end") - 1)).alias("draw"))
    sizes = blocks.groupBy("source").agg(F.first("blocks").alias("blocks"))
    leaves = leaves.join(sizes, _same("s", "source")).select("s", "shard", (F.col("draw") % F.col("blocks")).alias("p")).groupBy("s", "p").agg(F.array_sort(F.collect_list("shard")).alias("shards"))
    return blocks.join(leaves, _same("source", "s") & (F.col("place") == F.col("p"))).select("source", "block", "shards")


def _fitting(free: DataFrame) -> DataFrame:
    """(source, size, take): by falling size as many documents as fit what is left of the gap. free: (source, gap, size, n)."""
    sizes = free.groupBy("source", "gap", "size").agg(F.sum("n").alias("n")).groupBy("source", "gap").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("size"), "n"))).alias("sizes"))

    def step(state: Column, entry: Column) -> Column:
        fits = F.least(F.floor(state["gap"] / -entry["size"]), entry["n"])
        taken = F.array(F.struct((-entry["size"]).alias("size"), fits.alias("take")))
        return F.struct((state["gap"] + fits * entry["size"]).alias("gap"), F.when(fits > 0, F.concat(state["taken"], taken)).otherwise(state["taken"]).alias("taken"))

    start = F.struct(F.col("gap").cast("double").alias("gap"), F.array().cast("array<struct<size:bigint,take:bigint>>").alias("taken"))
    return sizes.select("source", F.explode(F.aggregate("sizes", start, step)["taken"]).alias("t")).select(F.col("source").alias("s"), F.col("t.size").alias("z"), F.col("t.take").alias("take"))


def _filled(placed: DataFrame) -> DataFrame:
    """placed, with `more`: how many copies of each row the source's gap takes, largest documents first."""
    gaps = placed.groupBy("source").agg((F.first("rest") - F.sum(F.col("size") * F.when(F.col("state") == 1, F.col("copies")).otherwise(F.col("fit")))).alias("gap")).where("gap >= 1").select(F.col("source").alias("s"), "gap")
    free = placed.where("state <> 1 and size > 0 and fit < copies").withColumn("n", F.col("copies") - F.col("fit")).join(gaps, _same("source", "s")).drop("s").where("size <= gap")
    free = written(free.select("source", "gap", "size", "n", "key", "doc_id", "row_hash", F.shiftright("key", _BITS - 10).alias("range")), "free")
    takes = written(_fitting(free), "takes")
    # Of one size the documents with the largest keys go first: whole ranges of keys, then those of the range where the count ends.
    counts = free.groupBy("source", "size", "range").agg(F.sum("n").alias("c")).join(takes, _same("source", "s") & (F.col("size") == F.col("z")))
    counts = counts.withColumn("before", F.sum("c").over(Window.partitionBy("source", "size").orderBy(F.desc("range"))) - F.col("c")).where("before < take")
    counts = counts.select("s", "z", F.col("range").alias("r"), (F.col("take") - F.col("before")).alias("left"), (F.col("before") + F.col("c") <= F.col("take")).alias("whole"))
    near = free.join(counts, _same("source", "s") & (F.col("size") == F.col("z")) & (F.col("range") == F.col("r")))
    order = Window.partitionBy("source", "size", "range").orderBy(F.desc("key"), F.desc("doc_id"), F.desc("row_hash"))
    edge = near.where("not whole").withColumn("more", F.greatest(F.least(F.col("left") - (F.sum("n").over(order) - F.col("n")), F.col("n")), F.lit(0)))
    more = near.where("whole").withColumn("more", F.col("n")).unionByName(edge).where("more > 0")
    more = more.select(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("row_hash").alias("h"), "more")
    return placed.join(more, _same("source", "s") & _same("doc_id", "d") & (F.col("row_hash") == F.col("h")), "left").drop("s", "d", "h").withColumn("more", F.coalesce("more", F.lit(0)))


def planned(documents: DataFrame, most: float = 3.0) -> DataFrame:
    """One row per distinct (doc_id, row_hash, source): copies, size, source_size, target, key, shards (of each draw of all copies), singles (copies taken once more)."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "source", word_count(F.col("text")).alias("size"))
    rows = rows.groupBy("doc_id", "row_hash", "source", "size").agg(F.count("*").alias("copies"))
    rows = written(rows.withColumn("key", _draw(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("source", F.lit("")))).withColumn("block", (F.col("key") % BLOCKS).cast("int")), "sized")
    targets = source_targets(rows.select("source", (F.col("size") * F.col("copies")).alias("size")), most)
    targets = targets.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    targets = written(targets.withColumnRenamed("source", "s"), "targets")
    in_order = Window.partitionBy("source").orderBy("block")
    blocks = rows.groupBy("source", "block").agg(F.sum(F.col("size") * F.col("copies")).alias("words")).withColumn("upto", F.sum("words").over(in_order)).join(targets, _same("source", "s")).drop("s")
    blocks = written(blocks.withColumn("state", F.when(F.col("upto") <= F.col("rest"), 1).when(F.col("upto") - F.col("words") < F.col("rest"), 2).otherwise(0)), "blocks")
    draws = block_draws(blocks.select("source", "block", "passes", (F.col("state") == 1).cast("int").alias("front")))
    blocks = blocks.join(draws.withColumnsRenamed({"source": "s", "block": "b"}), _same("source", "s") & (F.col("block") == F.col("b")), "left")
    blocks = blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), "source_size", "target", "rest", "state", (F.col("upto") - F.col("words")).alias("begin"), F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))
    placed = rows.join(blocks, _same("source", "s") & (F.col("block") == F.col("b"))).drop("s", "b")
    words = F.col("size") * F.col("copies")
    before = F.col("begin") + F.sum(words).over(Window.partitionBy("source").orderBy("key", "doc_id", "size", "row_hash").rowsBetween(Window.unboundedPreceding, 0)) - words
    fit = F.when(F.col("size") > 0, F.greatest(F.least(F.floor((F.col("rest") - before) / F.col("size")), F.col("copies")), F.lit(0))).otherwise(0)
    # Documents in order while they fit: behind the first that does not, none is taken here.
    edge = placed.where("state = 2").withColumn("fit", fit)
    placed = written(placed.where("state <> 2").withColumn("fit", F.lit(0).cast("long")).unionByName(edge), "placed")
    return _filled(placed).select("doc_id", "row_hash", "source", "copies", "size", "source_size", F.round("target", 6).alias("target"), "key", "shards", (F.col("fit") + F.col("more")).alias("singles"))


def _single_home() -> Column:
    """The shard of a document that is taken by itself."""
    return F.expr(f"key div {BLOCKS} % {1 << LEVELS}").cast("int")


def drawn(documents: DataFrame, most: float = 3.0) -> DataFrame:
    """One row per document: doc_id, row_hash, source, size, source_size, target, times, taken, shards (of each draw)."""
    rows = planned(documents, most).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    single = F.when(F.col("copy") <= F.col("singles"), F.array(_single_home())).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("shards", F.array_sort(F.concat("shards", single)))
    return rows.select("doc_id", "row_hash", "source", "size", "source_size", "target", F.size("shards").alias("times"), (F.size("shards") * F.col("size")).cast("long").alias("taken"), "shards")


def mixed_documents(documents: DataFrame, salts: int = 64) -> DataFrame:
    """The mix itself: each document as often as it is drawn, dealt by output shard and shuffled there, with the input's columns.

    Rows go to tasks by shard and one of `salts` parts, so no task holds a shard; a task's rows are in order of shard.
    """
    plan = planned(documents).where("size(shards) > 0 or singles > 0").select(F.col("doc_id").alias("d"), F.col("row_hash").alias("h"), F.col("source").alias("s"), "copies", "key", "shards", "singles")
    plan = written(plan, "plan")
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "source")
    same = _same("doc_id", "d") & (F.col("row_hash") == F.col("h")) & _same("source", "s")
    every = plan.withColumn("shards", F.when(F.col("singles") == F.col("copies"), F.concat("shards", F.array(_single_home()))).otherwise(F.col("shards"))).where("size(shards) > 0")
    dealt = rows.join(every, same).select("row", "key", "shards")
    some = plan.where("singles > 0 and singles < copies")
    if not some.isEmpty():  # equal rows of which only some are taken: one stands for those, at most a few a source
        one = rows.join(some, same).groupBy("d", "h", "s", "key", "singles").agg(F.first("row").alias("row"))
        dealt = dealt.unionByName(one.select("row", "key", F.transform(F.sequence(F.lit(1).cast("long"), F.col("singles")), lambda _: _single_home()).alias("shards")))
    dealt = dealt.select("row", "key", F.posexplode("shards").alias("draw", "home")).withColumn("at", F.xxhash64("key", "draw"))
    dealt = dealt.repartition("home", F.pmod("at", F.lit(salts))).sortWithinPartitions("home", "at")
    return dealt.select(*(F.col("row").getField(c).alias(c) for c in documents.columns))


def op7(spark, sf_dir: str) -> DataFrame:
    return drawn(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"))


_SPLIT = "\n".join(f"n{i + 1} AS (SELECT source, node * 2 + CASE WHEN place >= (size + 1) // 2 THEN 1 ELSE 0 END AS node, CASE WHEN place >= (size + 1) // 2 THEN place - (size + 1) // 2 ELSE place END AS place, CASE WHEN place >= (size + 1) // 2 THEN size // 2 ELSE (size + 1) // 2 END AS size FROM n{i})," for i in range(LEVELS))
SQL = rf"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(doc_id || '|' || coalesce(source, '')), 1, 15) AS BIGINT) AS key FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM r GROUP BY source),
f AS (SELECT *, 3.0::DOUBLE * source_size / weight AS full_at FROM s),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER w, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS rate
  FROM f WINDOW w AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, (SELECT arg_min(rate, full_at) FROM l WHERE rate <= full_at) * weight) AS target FROM l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t),
d AS (
  SELECT r.*, key % {BLOCKS} AS block, source_size, target, passes, target - passes * source_size AS rest FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source
), o AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY block, key, doc_id ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY source ORDER BY block) AS block_upto, sum(size) OVER (PARTITION BY source, block) AS words FROM d),
b AS (SELECT source, block, row_number() OVER (PARTITION BY source ORDER BY block) - 1 AS place, count(*) OVER (PARTITION BY source) AS blocks, CAST(any_value(passes) + max(CASE WHEN block_upto <= rest THEN 1 ELSE 0 END) AS BIGINT) AS draws FROM o GROUP BY source, block),
n0 AS (
  SELECT source, 0 AS node, row_number() OVER (ORDER BY '0x' || substr(md5(coalesce(source, '') || '|' || i), 1, 15), source NULLS LAST, i) - 1 AS place, count(*) OVER () AS size
  FROM (SELECT source, unnest(range(1, quota + 1)) AS i FROM (SELECT source, CAST(sum(draws) AS BIGINT) AS quota FROM b GROUP BY source))
),
{_SPLIT}
e AS (SELECT node, source, unnest(range(stop - quota, stop)) AS draw FROM (SELECT node, source, quota, CAST(sum(quota) OVER (PARTITION BY source ORDER BY node) AS BIGINT) AS stop FROM (SELECT node, source, count(*) AS quota FROM n{LEVELS} GROUP BY 1, 2))),
h AS (SELECT b.source, b.block, list(e.node) AS shards FROM b JOIN e ON b.source IS NOT DISTINCT FROM e.source AND e.draw % b.blocks = b.place GROUP BY 1, 2),
p AS (SELECT *, block_upto <= rest AS whole, block_upto > rest AND block_upto - words < rest AND upto <= rest AND size > 0 AS single FROM o),
g AS (
  SELECT source, rest - sum(CASE WHEN whole OR single THEN size ELSE 0 END) AS gap, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS BIGINT) AS size, CAST(NULL AS BIGINT) AS key FROM p GROUP BY source, rest
  UNION ALL
  SELECT source, gap - best.size AS gap, best.doc_id, best.size, best.key FROM (
    SELECT g.source, g.gap, max({{'size': p.size, 'key': p.key, 'doc_id': p.doc_id}}) AS best FROM g JOIN p ON g.source IS NOT DISTINCT FROM p.source
    WHERE NOT p.whole AND NOT p.single AND p.size > 0 AND p.size <= g.gap AND (g.size IS NULL OR (p.size, p.key, p.doc_id) < (g.size, g.key, g.doc_id)) GROUP BY g.source, g.gap)
), k AS (
  SELECT p.doc_id, p.size, p.source_size, p.target, list_sort(list_concat(coalesce(h.shards, []), CASE WHEN single OR g.doc_id IS NOT NULL THEN [CAST((p.key // {BLOCKS}) % {1 << LEVELS} AS INTEGER)] ELSE [] END)) AS shards
  FROM p LEFT JOIN h ON p.source IS NOT DISTINCT FROM h.source AND p.block = h.block LEFT JOIN g ON p.source IS NOT DISTINCT FROM g.source AND p.doc_id = g.doc_id
)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(len(shards) * size AS BIGINT) AS taken, array_to_string(shards, ',') AS shards FROM k
"""
