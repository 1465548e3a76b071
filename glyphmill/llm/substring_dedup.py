"""Substring dedup by relative Lempel-Ziv parsing against an index of the whole corpus.

The reference of the parse is every document with a smaller id, cut into blocks: a block is the stretch of
text around one content-defined phrase of PHRASE words. Of the phrases of each window of `min_words` words
the one with the least hash is indexed, so a window and its copies meet at the same phrase, and only about
one position in twenty is indexed. A phrase's block holds every window that chose it.

1. Blocks are compared by fingerprint. A block that stands whole in an earlier document is one long factor.
2. Factor boundaries: where blocks of one phrase differ, their windows are compared one by one (first
   occurrence by a map-side combined minimum), so a factor ends at the exact word where its copy ends.
3. Matches of one diagonal (one earlier document, one shift) that touch are one run, and each document is parsed
   greedily from its first word on: where a run is under way, the one that goes on longest gives the next factor, up to
   the run's end; where none is, a literal factor goes up to the next run. So factors tile the document.
4. Factor boundaries are checked: a factor that begins inside its run counts with what the run holds before the
   boundary, and is a duplicate span if that makes `min_words` or more. The words of duplicate spans go.

The index keeps the first place of each block and window, so a factor is the longest one along the diagonals of first
places; a longer match that only a later copy would give shows as two factors, with the same words removed.

Fingerprints of a window have 128 bits (two independent 64-bit hashes, or phrase and block hash together).

Cases. Null and empty texts: no words, an empty kept text. Null doc_id: kept whole, refers to nothing and
nothing refers to it. Repeated ids: judged row by row, against smaller ids only, so rows of one id never
remove each other. Texts under `min_words` words: kept whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import frugal, lean, written
from glyphmill.llm.tokens import BASES, Words, span_hashes, words

PHRASE = 12
_LOW = np.uint64((1 << 24) - 1)


def _chosen(w: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window start, phrase start, phrase hash) for each window of `size` words within one text."""
    n = len(hashes)
    if n < size:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    at = np.arange(n - PHRASE + 1)
    phrases = span_hashes(hashes, at, at + PHRASE, BASES[1])
    least = (phrases & ~_LOW) | at.astype(np.uint64)  # ties go to the leftmost
    width, have = size - PHRASE + 1, 1
    while have < width:  # minimum of `have` neighbours, doubled until it is `width`
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    last = np.repeat(w.first[1:], np.diff(w.first))  # end of the text of each word
    starts = np.arange(n - size + 1)
    starts = starts[starts + size <= last[: n - size + 1]]
    at = (least[starts] & _LOW).astype(np.int64)
    return starts, at, phrases[at]


def _blocks(size: int):
    """Batches of (doc_id, row_hash, text) to one row per indexed phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), batch.column(1)
            for row, w in words(batch.column(2)):
                hashes = w.hashes()
                starts, at, phrase = _chosen(w, hashes, size)
                if not len(starts):
                    continue
                new = np.ones(len(starts), bool)
                new[1:] = (at[1:] != at[:-1]) | (np.diff(starts) > 1)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(starts)) - 1
                lo, hi, key = starts[first], starts[last] + size, phrase[first]
                block = span_hashes(hashes, lo, hi, BASES[2]) ^ (at[first] - lo).astype(np.uint64)
                doc = np.searchsorted(w.first, lo, "right") - 1
                base = w.first[doc]
                take = pa.array(row + doc)
                yield pa.RecordBatch.from_arrays([ids.take(take), rows.take(take), pa.array(key.view(np.int64)), pa.array(block.view(np.int64)), pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32))], names=["doc_id", "row_hash", "phrase", "block", "lo", "hi"])

    return run


def _lists(column: pa.Array, *fields: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each row's items begin and end, and the items' fields, without a Python object per item."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    items = column.flatten()
    return at, [items.field(f).to_numpy(zero_copy_only=False) for f in fields]


def _windows(size: int):
    """Batches of (doc_id, row_hash, spans, text) to the fingerprints of the windows within the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), batch.column(1)
            at, (lows, highs) = _lists(batch.column(2), "lo", "hi")
            for row, w in words(batch.column(3)):
                hashes = w.hashes()
                texts = len(w.first) - 1
                a, b = at[row], at[row + texts]
                lo, counts = lows[a:b].astype(np.int64), (highs[a:b] - lows[a:b] - size + 1).astype(np.int64)
                owner = np.repeat(np.repeat(np.arange(texts), np.diff(at[row : row + texts + 1])), counts)
                starts = np.repeat(lo - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
                place = starts + w.first[owner]
                one, two = (span_hashes(hashes, place, place + size, b).view(np.int64) for b in BASES[1:])
                take = pa.array(row + owner)
                yield pa.RecordBatch.from_arrays([ids.take(take), rows.take(take), pa.array(one), pa.array(two), pa.array(starts.astype(np.int32))], names=["doc_id", "row_hash", "one", "two", "lo"])

    return run


def _runs(row: np.ndarray, lo: np.ndarray, hi: np.ndarray, ref: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, ...]:
    """Matched spans to runs, by row and lo: spans of one diagonal of one reference that overlap or touch are one."""
    order = np.lexsort((lo, shift, ref, row))
    row, lo, hi, ref, shift = (x[order] for x in (row, lo, hi, ref, shift))
    other = np.ones(len(lo), bool)
    other[1:] = (row[1:] != row[:-1]) | (ref[1:] != ref[:-1]) | (shift[1:] != shift[:-1])
    lift = np.cumsum(other) * (int(hi.max(initial=0)) + 1)  # keeps a diagonal's ends above those of the diagonal before
    reach = np.maximum.accumulate(hi + lift) - lift
    new = other.copy()
    new[1:] |= lo[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1 if len(first) else first
    runs = (row[first], lo[first], reach[last], ref[first], shift[first])
    order = np.lexsort((runs[4], runs[3], runs[1], runs[0]))
    return tuple(x[order] for x in runs)


def parse(n: int, runs: list[tuple[int, int, int, int]]) -> list[dict]:
    """Greedy factors of a document of n words. runs: (lo, hi, ref, shift) by lo.

    since: where the factor's run begins, at or before lo; ref_doc, ref_lo and since of literal factors are null.
    """
    found, at, best, i = [], 0, (0, 0, 0, 0), 0
    while at < n:
        while i < len(runs) and runs[i][0] <= at:
            best = max(best, runs[i], key=lambda r: r[1])
            i += 1
        since, hi, ref, shift = best
        if hi > at:
            found.append({"lo": at, "hi": hi, "ref_doc": ref, "ref_lo": at + shift, "since": since})
        else:
            hi = runs[i][0] if i < len(runs) else n
            found.append({"lo": at, "hi": hi, "ref_doc": None, "ref_lo": None, "since": None})
        at = hi
    return found


_FACTORS = "array<struct<lo:int,hi:int,ref_doc:long,ref_lo:int,since:int>>"


def _kept(min_words: int, with_text: bool):
    """Batches of (doc_id, spans, text) to what the parse leaves of each text; without texts, factors are not listed either."""
    factor = pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("ref_doc", pa.int64()), ("ref_lo", pa.int32()), ("since", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield left(batch.slice(at, 256))

    def left(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [], [])
        at, (lo, hi, ref, ref_lo) = _lists(batch.column(1), "lo", "hi", "ref", "ref_lo")
        row = np.repeat(np.arange(batch.num_rows), np.diff(at))
        row, *runs = _runs(row, lo.astype(np.int64), hi.astype(np.int64), ref, ref_lo.astype(np.int64) - lo)
        at = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
        runs = list(zip(*(x.tolist() for x in runs), strict=True))
        for i, text in enumerate(batch.column(2)):
            all_words = (text.as_py() or "").encode().split()
            n = len(all_words)
            factors = parse(n, runs[at[i] : at[i + 1]]) if with_text or at[i] < at[i + 1] else []
            for f in reversed(factors):
                if f["since"] is not None and f["hi"] - f["since"] >= min_words:
                    del all_words[f["lo"] : f["hi"]]
            kept = b" ".join(all_words)
            for column, value in zip(out, (n, n - len(all_words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None, factors if with_text else None), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.large_string(), pa.list_(factor))
        arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
        arrays[3] = arrays[3].cast(pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "factors"])

    return run


def duplicate_spans(documents: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, row_hash, lo, hi, ref, ref_lo): stretches of words that stand in an earlier document, maybe overlapping."""
    docs = lean(documents).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")
    blocks = written(docs.mapInArrow(frugal(_blocks(min_words)), "doc_id long, row_hash long, phrase long, block long, lo int, hi int"), "blocks")
    # Sums are written before they are joined back: a join of two plain exchanges can split a phrase that fills a task.
    seen = written(blocks.groupBy("phrase").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), (F.min("block") != F.max("block")).alias("several")).where("first < last").drop("last"), "seen")
    shared = written(blocks.join(seen, "phrase"), "shared")
    where_first = written(shared.groupBy("phrase", "block").agg(F.min(F.struct("doc_id", "lo")).alias("at")), "first")
    placed = shared.join(where_first, ["phrase", "block"])
    whole = placed.where("doc_id > at.doc_id").select("doc_id", "row_hash", "lo", "hi", F.col("at.doc_id").alias("ref"), F.col("at.lo").alias("ref_lo"))
    # Blocks met for the first time: their windows may still stand in another block of the same phrase.
    edge = placed.where("several and doc_id = at.doc_id").groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    loose = edge.join(docs, ["doc_id", "row_hash"]).select("doc_id", "row_hash", "spans", "text")
    windows = written(loose.mapInArrow(frugal(_windows(min_words)), "doc_id long, row_hash long, one long, two long, lo int"), "windows")
    least = written(windows.groupBy("one", "two").agg(F.min(F.struct("doc_id", "lo")).alias("at"), F.max("doc_id").alias("last")).where("at.doc_id < last").drop("last"), "least")
    parts = windows.join(least, ["one", "two"]).where("doc_id > at.doc_id").select("doc_id", "row_hash", "lo", (F.col("lo") + min_words).alias("hi"), F.col("at.doc_id").alias("ref"), F.col("at.lo").alias("ref_lo"))
    return whole.unionByName(parts)


def dedup_substrings(documents: DataFrame, min_words: int = 50, with_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if with_text, kept_text and factors (lo, hi, ref_doc, ref_lo, since)."""
    # Rows of one id and text find the same spans: a set holds them once.
    spans = duplicate_spans(documents, min_words).groupBy("doc_id", "row_hash").agg(F.collect_set(F.struct("lo", "hi", "ref", "ref_lo")).alias("spans"))
    docs = lean(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text")
    return docs.join(spans, ["doc_id", "row_hash"], "left").select("doc_id", "spans", "text").mapInArrow(frugal(_kept(min_words, with_text)), f"doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, factors {_FACTORS}")


def op1(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(documents, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), n AS (SELECT doc_id, words, len(words) AS n FROM w),
s AS (SELECT doc_id, unnest(range(1, n - 48)) AS lo, words FROM n WHERE n >= 50),
h AS (SELECT doc_id, lo, md5(array_to_string(words[lo:lo+49], ' ')) AS x FROM s),
d AS (SELECT doc_id, lo FROM (SELECT doc_id, lo, min(doc_id) OVER (PARTITION BY x) AS m FROM h) WHERE m < doc_id),
c AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(lo, lo + 50)) AS k FROM d) GROUP BY doc_id),
k AS (
  SELECT n.doc_id, n.n, coalesce(len(c.ks), 0) AS gone,
         CASE WHEN c.ks IS NULL THEN n.words ELSE list_transform(list_filter(range(1, n.n + 1), lambda i: NOT list_contains(c.ks, i)), lambda i: n.words[i]) END AS kept
  FROM n LEFT JOIN c USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(gone AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
