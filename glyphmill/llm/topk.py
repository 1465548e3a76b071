"""Exact top-k search by block-at-a-time pruning.

Vectors are cut into range blocks of BLOCK rows in vec_id order. A block keeps its forward index (the rows' integer
components) and the largest and smallest value of each component. For a query, the sum over its components of
the larger product with those two bounds every score in the block. Queries are a stated set, packed in tiles of TILE.

1. Bounds. Summaries of blocks (their two vectors of bounds) travel in packs of PACK to the tiles, 1/BLOCK of the index;
   each tile names the SEEDS blocks with the highest bounds for its queries.
2. Seeds. Those blocks are scored. The kth score of a query there, its threshold, can only rise.
3. Survivors. Tiles meet the summaries once more, with thresholds; a block goes to a tile only if its bound reaches the
   threshold of one of the tile's queries. Blocks below every threshold are not moved at all.
4. Cells of one tile and about GROUP blocks visit blocks by falling bound from the thresholds on, and stop
   when bounds fall below the kth score (equal bounds are visited: a tie may have a smaller id). A window with a
   partial limit merges cells' k rows a query.

No cell's memory depends on the input. Products are exact: in double precision while 2**53 cannot be passed, beyond that
in limbs of 16 bits.

Cases. Null vectors and those with null or non-finite components: take no part. Shorter vectors: as if ended with
zeros. Null vec_id: takes no part. Repeated vec_id: one query (the least vector in array order), each row a
candidate; all rows with the query's id are its own. Components and scores that no 64-bit integer holds are the nearest
one that it does; such scores are ties. Empty tables, or fewer rows than k: what there is. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.shared import frugal, lean, written

BLOCK, GROUP, TILE, PACK, SEEDS = 1024, 8, 2048, 512, 4
_PACKED = "part int, ids binary, dim int, rows binary, bounds binary"
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _narrow(rows: np.ndarray) -> bytes:
    """The integers in as few bytes each as hold them all."""
    low, high = rows.min(initial=0), rows.max(initial=0)
    return rows.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)).tobytes()


def _packed(size: int):
    """Batches of (vec_id, q) in id order to packed rows of up to `size` vectors; bounds: least and largest components."""

    def pack(ids: np.ndarray, vectors: list, part: int) -> pa.RecordBatch:
        dim = max((len(v) for v in vectors), default=0)
        rows = np.zeros((len(vectors), dim), np.int64)
        for row, v in zip(rows, vectors, strict=True):
            row[: len(v)] = v
        bounds = np.concatenate([rows.min(axis=0), rows.max(axis=0)])
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([dim], pa.int32()), *(pa.array([b], pa.binary()) for b in (_narrow(rows), _narrow(bounds)))], names=["part", "ids", "dim", "rows", "bounds"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, part = np.zeros(0, np.int64), [], 0
        for batch in batches:
            ids = np.concatenate([ids, batch.column(0).to_numpy()])
            vectors += list(batch.column(1).to_numpy(zero_copy_only=False))
            while len(ids) >= size:
                yield pack(ids[:size], vectors[:size], part)
                ids, vectors, part = ids[size:], vectors[size:], part + 1
        if len(ids):
            yield pack(ids, vectors, part)

    return run


def _matrix(rows: bytes, n: int, dim: int, width: int) -> np.ndarray:
    out = np.zeros((n, width), np.int64)
    if dim:
        out[:, :dim] = np.frombuffer(rows, f"i{len(rows) // (n * dim)}").reshape(n, dim)
    return out


def _limbs(rows: np.ndarray) -> list[np.ndarray]:
    """Four limbs of 16 bits, the last with the sign."""
    return [((rows >> (16 * i)) & 0xFFFF if i < 3 else rows >> 48).astype(np.float64) for i in range(4)]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, in integers; what passes 64 bits is the nearest integer that does not."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    if np.abs(a.astype(np.float64)).max(initial=0) * np.abs(b.astype(np.float64)).max(initial=0) * max(1, a.shape[1]) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    left, right = _limbs(a), _limbs(b)
    carry, digits = np.zeros((len(a), len(b)), np.int64), []
    for place in range(7):  # sums of limb products of one place, with the carry of the place before
        for i in range(max(0, place - 3), min(4, place + 1)):
            carry = carry + (left[i] @ right[place - i].T).astype(np.int64)
        digits.append(carry & 0xFFFF)
        carry = carry >> 16
    low = digits[0] | digits[1] << 16 | digits[2] << 32 | digits[3] << 48  # the last 64 bits, as two's complement
    above = digits[4] | digits[5] << 16 | digits[6] << 32
    fits = ((carry == 0) & (above == 0) & (low >= 0)) | ((carry == -1) & (above == (1 << 48) - 1) & (low < 0))
    return np.where(fits, low, np.where(carry < 0, _LEAST, _MOST))


def _upper(queries: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """A bound of every query's scores in each block, with room for rounding."""
    q = queries.astype(np.float64)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    bounds = up @ highs.T + down @ lows.T
    return bounds + 1e-9 * (up @ np.abs(highs).T - down @ np.abs(lows).T)


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k first of each row, by falling score, then id."""
    order = np.lexsort((ids, ~scores, rows))
    r = rows[order]
    start = np.concatenate([[0], np.flatnonzero(r[1:] != r[:-1]) + 1]) if len(r) else np.zeros(0, np.int64)
    rank = np.arange(len(r)) - np.repeat(start, np.diff(np.append(start, len(r))))
    return order[rank < k]


def search(queries: np.ndarray, query_ids: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query row, vec_id, score) of each query's k best, and how many pairs of query and block were scored.

    blocks: (ids, vectors); least: scores under a query's entry are not wanted.
    """
    highs, lows = (np.array([f(v, axis=0) for _, v in blocks], np.float64).reshape(len(blocks), queries.shape[1]) for f in (np.max, np.min))
    bounds = _upper(queries, lows, highs)
    order = np.argsort(-bounds, axis=1, kind="stable")
    rows, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    kth = np.full(len(queries), _LEAST) if least is None else least.copy()
    active, visited = np.arange(len(queries)), 0
    for turn in range(len(blocks)):
        near = order[active, turn]
        active = active[bounds[active, near] >= kth[active]]
        if not len(active):
            break
        near = order[active, turn]
        for b in np.unique(near).tolist():
            mine = active[near == b]
            block_ids, vectors = blocks[b]
            got = _products(queries[mine], vectors)
            visited += len(mine)
            other = block_ids[None, :] != query_ids[mine][:, None]
            other &= got >= kth[mine][:, None]
            if got.shape[1] > k:
                cut = np.partition(np.where(other, got, _LEAST), got.shape[1] - k, axis=1)[:, -k]
                other &= got >= cut[:, None]
            r, c = np.nonzero(other)
            rows, ids, scores = np.concatenate([rows, mine[r]]), np.concatenate([ids, block_ids[c]]), np.concatenate([scores, got[r, c]])
        keep = _best(rows, scores, ids, k)
        rows, ids, scores = rows[keep], ids[keep], scores[keep]
        counts = np.bincount(rows, minlength=len(queries))
        full = np.flatnonzero(counts == k)
        kth[full] = np.maximum(kth[full], scores[np.cumsum(counts)[full] - 1])
    return rows, ids, scores, visited


def _thresholds(n: int, at: list[dict] | None) -> np.ndarray:
    out = np.full(n, _LEAST)
    for entry in at or ():
        out[entry["place"]] = entry["kth"]
    return out


def _bounded(survivors: bool):
    """A pack of summaries and a tile to (tile, block, pairs, bound): survivors with their pairs, or the SEEDS highest bounds."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        packs, tiles = [r for r in rows if r["tile"] is None], [r for r in rows if r["tile"] is not None]
        width = max(r["dim"] for r in rows)
        sides = [_matrix(p["rows"], 2, p["dim"], width) for p in packs]
        lows, highs = (np.array([s[i] for s in sides], np.float64).reshape(len(packs), width) for i in (0, 1))
        blocks = np.array([p["block"] for p in packs], np.int64)
        out: list[tuple] = []
        for t in tiles:
            n = len(t["ids"]) // 8
            bounds = _upper(_matrix(t["rows"], n, t["dim"], width), lows, highs)
            if survivors:
                pairs = (bounds >= _thresholds(n, t["kths"])[:, None]).sum(axis=0)
                out += [(t["tile"], int(blocks[b]), int(pairs[b]), 0.0) for b in np.flatnonzero(pairs).tolist()]
            else:
                mean = bounds.mean(axis=0)
                out += [(t["tile"], int(blocks[b]), n, float(mean[b])) for b in np.argsort(-mean, kind="stable")[:SEEDS].tolist()]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["tile", "block", "pairs", "bound"])

    return run


def _cell(k: int):
    """A tile and some blocks to the k best of each query."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        width = max(r["dim"] for r in rows)
        vectors = [(np.frombuffer(r["ids"], np.int64), _matrix(r["rows"], len(r["ids"]) // 8, r["dim"], width)) for r in rows]
        blocks = [v for r, v in zip(rows, vectors, strict=True) if not r["is_query"]]
        found = []
        for r, (ids, v) in zip(rows, vectors, strict=True):
            if r["is_query"] and blocks:
                place, near, scores, _ = search(v, ids, blocks, k, _thresholds(len(ids), r["kths"]))
                found.append((ids[place], near, scores, place, np.full(len(place), r["tile"])))
        columns = [np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(5)]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score", "place", "tile"])

    return run


def quantised(embedding: Column) -> Column:
    """floor(256 * x) of each component; null where the vector takes no part."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, F.transform(embedding, lambda x: F.floor(x.cast("double") * 256)))


_KTHS = "array<struct<place:long,kth:long>>"


def _near(tiles: DataFrame, blocks: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Each query's k best in the blocks of its tile that `pairs` (tile, block) names; thresholds come with the tiles."""
    cells = pairs.select(F.col("tile").alias("t"), F.col("block").alias("b"))
    # About GROUP blocks a cell: enough for one to raise the others' threshold, few enough to deal out.
    groups = cells.groupBy("t").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    cells = written(cells.join(groups, "t").withColumn("r", F.pmod(F.xxhash64("b"), F.col("groups"))).drop("groups"), "cells")
    columns = ["is_query", "tile", "r", "ids", "dim", "rows", "kths"]
    some = cells.join(blocks.withColumnRenamed("block", "b"), "b").select(F.lit(False).alias("is_query"), F.col("t").alias("tile"), "r", "ids", "dim", "rows", F.lit(None).cast(_KTHS).alias("kths"))
    own = cells.select(F.col("t").alias("tile"), "r").distinct().join(tiles, "tile").withColumn("is_query", F.lit(True)).select(columns)
    near = some.unionByName(own).groupBy("tile", "r").applyInArrow(_cell(k), "query_id long, vec_id long, score long, place long, tile long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def surviving(vectors: DataFrame, queries: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tiles with thresholds, blocks, and the (tile, block, pairs) whose bound reaches the threshold of `pairs` queries of the tile."""
    packed = lambda df, size: df.sortWithinPartitions("vec_id").mapInArrow(frugal(_packed(size)), _PACKED)
    blocks = written(packed(lean(vectors), BLOCK).withColumn("block", F.monotonically_increasing_id()), "blocks")
    one_each = queries.groupBy("vec_id").agg(F.min("q").alias("q"))
    tiles = written(packed(one_each, TILE).withColumn("tile", F.monotonically_increasing_id()), "tiles")
    packs, columns = max(1, -(-blocks.count() // PACK)), max(1, tiles.count())

    def bounded(tiles: DataFrame, survivors: bool) -> DataFrame:
        """Summaries go to every column of tiles, tiles to every pack."""
        sides = blocks.select(F.lit(None).cast("long").alias("tile"), "block", "ids", "dim", F.col("bounds").alias("rows"), F.lit(None).cast(_KTHS).alias("kths"), F.pmod(F.xxhash64("block"), F.lit(packs)).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("c"))
        own = tiles.select("tile", F.lit(None).cast("long").alias("block"), "ids", "dim", "rows", "kths", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))).alias("p"), F.pmod(F.xxhash64("tile"), F.lit(columns)).cast("int").alias("c"))
        return sides.withColumn("ids", F.lit(None).cast("binary")).unionByName(own).groupBy("p", "c").applyInArrow(_bounded(survivors), "tile long, block long, pairs long, bound double")

    tiles = tiles.withColumn("kths", F.lit(None).cast(_KTHS))
    place = F.row_number().over(Window.partitionBy("tile").orderBy(F.desc("bound"), "block"))
    seeds = bounded(tiles, False).withColumn("n", place).where(F.col("n") <= SEEDS)
    kths = _near(tiles, blocks, seeds, k).where(F.col("rank") == k).groupBy("tile").agg(F.collect_list(F.struct("place", F.col("score").alias("kth"))).alias("kths"))
    tiles = written(tiles.drop("kths").join(kths, "tile", "left"), "tiles")
    return tiles, blocks, written(bounded(tiles, True), "survivors")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score). vectors, queries: (vec_id long, q array<long>), without nulls."""
    tiles, blocks, pairs = surviving(vectors, queries, k)
    return _near(tiles, blocks, pairs, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("q")).where("vec_id is not null and q is not null")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
