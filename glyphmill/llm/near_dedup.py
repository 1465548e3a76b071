"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

1. Sketch. Every distinct shingle set is thrown into COORDINATES bins, round after round with fresh hashes;
   a bin keeps the least hash of the first round that reached it. After COORDINATES rounds each further
   round feeds one fixed bin, so every bin fills after at most twice as many rounds, whatever the set's
   size. Two sets agree in a bin with a probability equal to their similarity, and the agreements
   concentrate around it.
2. Banding. BANDS bands of ROWS bins: two sets of similarity 0.75 share no band with a probability of
   (1 - 0.75**5)**50 = 1.3e-6. Equal sets are one node. In a bucket every node is tied to its least node,
   so a bucket of n nodes gives n - 1 candidate edges; their components are families.
3. Exact verification. A family's full shingle sets are compared with each other in blocks (at most BLOCK
   sets and BLOCK_SHINGLES shingles, dealt over many tasks), as one matrix product a pair of blocks, and each pair of
   blocks returns a spanning forest of its links. No link between members of a family is left out, and no
   group is gathered in one task. Components of these links are the groups.

A document's set: its distinct shingles of `size` words, A-Z lower-cased; the whole sequence if it has fewer
words. Sets are compared as 64-bit hashes of their shingles.

Cases. Null and empty texts: no shingles, linked with nothing, their own group. Null doc_id: takes no part;
component_id null, kept. Repeated rows: members of one group; every row that bears the group's least id is
kept. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import components, frugal, lean, written
from glyphmill.llm.tokens import BASES, mix, span_hashes, words

BANDS, ROWS = 50, 5
COORDINATES = BANDS * ROWS
BLOCK, BLOCK_SHINGLES = 256, 250_000
_EMPTY = np.uint64(2**64 - 1)
_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * BASES[0])
_ODD = mix(np.arange(1, ROWS + 1, dtype=np.uint64) * BASES[1]) | np.uint64(1)
_OF_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * BASES[2])


def shingle_sets(texts: pa.Array, size: int, most: int = 1 << 20) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each text) slice by slice."""
    for row, w in words(texts, most):
        hashes = w.hashes(fold=True)
        n = len(hashes)
        at = np.arange(max(0, n - size + 1))
        rolling = span_hashes(hashes, at, at + size, BASES[1])
        sets = []
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= size:
                sets.append(np.unique(rolling[a : b - size + 1]))
            elif b > a:
                sets.append(span_hashes(hashes[a:b], np.array([0]), np.array([b - a]), BASES[1]))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield row, sets


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COORDINATES values per non-empty set."""
    out = np.full((len(sets), COORDINATES), _EMPTY)
    open_sets = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets])
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    for k in range(2 * COORDINATES):
        thrown = mix(items ^ _SEEDS[k])
        if k < COORDINATES:
            bins = ((thrown >> np.uint64(32)) * np.uint64(COORDINATES) >> np.uint64(32)).astype(np.int64)
        else:
            bins = np.full(len(items), k - COORDINATES)
        found = np.full(len(open_sets) * COORDINATES, _EMPTY)
        np.minimum.at(found, owner * COORDINATES + bins, thrown)
        now = out[open_sets]
        now = np.where(now == _EMPTY, found.reshape(-1, COORDINATES), now)
        out[open_sets] = now
        still = (now == _EMPTY).any(axis=1)
        if not still.any():
            break
        if not still.all():
            keep = still[owner]
            items, owner = items[keep], (np.cumsum(still) - 1)[owner[keep]]
            open_sets = open_sets[still]
    return out


def _sketched(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), batch.column(1)
            for row, sets in shingle_sets(batch.column(2), size):
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                node = np.zeros(len(sets), np.int64)
                bands = pa.nulls(len(sets), pa.list_(pa.int64()))
                if len(full):
                    chosen = [sets[i] for i in full]
                    starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    node[full] = mix(np.add.reduceat(mix(np.concatenate(chosen) ^ _SEEDS[0]), starts) + n[full].astype(np.uint64)).view(np.int64)
                    keys = mix((sketches(chosen).reshape(-1, BANDS, ROWS) * _ODD).sum(axis=2, dtype=np.uint64) ^ _OF_BAND).view(np.int64)
                    at = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                    bands = pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(row, len(sets)), rows.slice(row, len(sets)), pa.array(n), pa.array(node, mask=n == 0), bands], names=["doc_id", "row_hash", "n_shingles", "node", "bands"])

    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column(4), size):
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, len(sets)) for i in range(4)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "family", "blocks", "block", "items"])

    return run


def _links(least: int):
    """Rows sorted by cell to links (a, b) that span the linked sets of each cell."""

    def forest(cell: tuple, nodes: list[int], blocks: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        sides = np.array(blocks)
        left, right = np.flatnonzero(sides == cell[1]), np.flatnonzero(sides == cell[2])
        sizes = np.array([len(s) for s in sets], np.int64)
        _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = np.cumsum(counts > 1) - 1
        owner = np.repeat(np.arange(len(sets)), sizes)
        both = counts[inverse] > 1  # a shingle of one set alone is in no intersection
        owner, place = owner[both], column[inverse[both]]
        common = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            part = (place >= lo) & (place < lo + 4096)
            has = np.zeros((len(sets), min(4096, int(column[-1]) + 1 - lo)), np.float32)
            has[owner[part], place[part] - lo] = 1
            common += has[left] @ has[right].T
        linked = 100 * common >= least * (sizes[left][:, None] + sizes[right][None, :] - common)
        near = np.zeros((len(sets), len(sets)), bool)
        near[np.ix_(left, right)] = linked
        near |= near.T
        todo = near.any(axis=1)
        while todo.any():
            root = int(np.flatnonzero(todo)[0])
            front, seen = np.array([root]), np.zeros(len(sets), bool)
            seen[root] = True
            while len(front):
                front = np.flatnonzero(near[front].any(axis=0) & ~seen)
                seen[front] = True
            todo &= ~seen
            yield from ((nodes[root], nodes[i]) for i in np.flatnonzero(seen).tolist() if i != root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, nodes, blocks, sets = None, [], [], []

        def emit(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

        found: list[tuple[int, int]] = []
        for batch in batches:
            for node, family, lo, hi, block, items in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (family, lo, hi) != cell:
                    if len(sets) > 1:
                        found += forest(cell, nodes, blocks, sets)
                    cell, nodes, blocks, sets = (family, lo, hi), [], [], []
                nodes.append(node)
                blocks.append(block)
                sets.append(np.frombuffer(items, np.uint64))
            if found:
                yield emit(found)
                found = []
        if len(sets) > 1:
            found += forest(cell, nodes, blocks, sets)
        if found:
            yield emit(found)

    return run


def near_groups(documents: DataFrame, size: int = 5, similarity: int = 75) -> DataFrame:
    """One row per document: doc_id, row_hash, n_shingles, component_id, kept. similarity: percent, 75 or more."""
    if similarity < 75:
        raise ValueError("the bands are laid out for similarities of 75 percent or more")
    docs = lean(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")
    all_rows = written(docs.mapInArrow(frugal(_sketched(size)), "doc_id long, row_hash long, n_shingles long, node long, bands array<long>"), "sketches")
    rows = all_rows.where("doc_id is not null and node is not null")
    # Copies leave before bands are dealt out; buckets are written, so that their join can split one that many near copies share.
    entries = written(rows.select("node", "bands").dropDuplicates(["node"]), "nodes").select("node", F.explode("bands").alias("bucket"))
    buckets = written(entries.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub < other").drop("other"), "buckets")
    families = components(entries.join(buckets, "bucket").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    one = rows.groupBy("node").agg(F.min(F.struct("doc_id", "row_hash", "n_shingles")).alias("one"))
    members = written(families.join(one, "node").select("node", F.col("root").alias("family"), "one.*"), "members")
    sizes = members.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = members.join(sizes, "family").select("doc_id", "row_hash", "node", "family", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"))
    sets = placed.join(docs.hint("merge"), ["doc_id", "row_hash"]).select("node", "family", "blocks", "block", "text").mapInArrow(frugal(_full_sets(size)), "node long, family long, blocks int, block int, items binary")
    cells = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "family", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "items")
    links = cells.repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi").mapInArrow(frugal(_links(similarity)), "a long, b long")
    groups = components(links)
    rooted = all_rows.drop("bands").join(groups, "node", "left").select("doc_id", "row_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "node")).alias("root"))
    least = written(rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least")  # written, so that the join can split a hot group
    return rooted.join(least, "root", "left").select("doc_id", "row_hash", "n_shingles", F.coalesce("least", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def first_of_groups(documents: DataFrame) -> DataFrame:
    """The rows that near_groups keeps, with all their columns: of each group those with its least doc_id.

    Rows of one id and text go or stay together; another text of the same id is judged by itself; rows with a null id stay.
    """
    gone = near_groups(documents).where("not kept").select("doc_id", "row_hash").distinct()
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("r"))
    kept = rows.join(gone, (F.col("d") == F.col("doc_id")) & (F.col("r") == F.col("row_hash")), "left_anti")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in documents.columns))


def op10(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_hash")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(words[i:i+4], ' ')) AS x FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
