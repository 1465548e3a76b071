"""Benchmark decontamination with DataFrame functions alone.

Test texts are normalised (A-Z lower-cased, words are runs of 0-9, a-z and everything beyond ASCII) and cut
into windows of `size` words; a shorter text is one window. The windows form a hash set that is broadcast
while it has at most `most_broadcast` members of `most_bytes` in all; a larger set is joined by a shuffle instead, with the same rows.
Training tokens are scanned once: each window has an anchor, its longest word, so only tokens that are some
window's anchor are looked at; the token window around such a token is hashed, looked up in the set, and the
hit is verified word by word.

Cases. Null and empty texts on either side: no words, no windows. Null doc_id: scanned like any other.
Null item_id: its windows mark words but name no item. Repeated rows of either table: each document row is
judged by its own text, an item counts once. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    """The normalised words of a text, an empty array for null."""
    text = F.coalesce(text, F.lit(""))
    folded = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    parts = F.split(folded, _GAP)
    head = (parts[0] == "").cast("int")
    tail = ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return F.slice(parts, head + 1, F.size(parts) - head - tail)


def test_windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(gram, item): the items that have each window; a window of an item without an id has a null item too."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), normal_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    grams = words.select("item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))).alias("at"))
    return grams.select(F.expr(f"slice(w, at, {size})").alias("gram"), "item").distinct()


def _row() -> list[Column]:
    """What a document row is known by: its id and text. Rows that agree in all of these are one."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), F.octet_length("text").alias("row_bytes")]


_ROW = ("doc_id", "row_hash", "row_bytes")


def _renamed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: f"of_{c}" for c in _ROW})


def _same() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("of_doc_id")) & (F.col("row_hash") == F.col("of_row_hash")) & F.col("row_bytes").eqNullSafe(F.col("of_row_bytes"))


def hits(documents: DataFrame, windows: DataFrame, most_broadcast: int = 1_000_000, most_bytes: int = 64 << 20) -> DataFrame:
    """(doc_id, row_hash, row_bytes, at, n, gram): each occurrence of a window; `at` counts words from 0. windows: (gram, ...)."""
    lengths = F.transform("gram", F.length)
    grams = windows.select("gram").distinct().select("gram", F.size("gram").alias("n"), (F.array_position(lengths, F.array_max(lengths)) - 1).cast("int").alias("offset")).withColumn("anchor", F.element_at("gram", F.col("offset") + 1))
    grams = written(grams, "windows")
    count, volume = grams.agg(F.count("*"), F.sum(F.aggregate("gram", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w) + 8))).first()
    small = count <= most_broadcast and (volume or 0) <= most_bytes
    sent = F.broadcast if small else (lambda df: df)
    anchors = grams.select(F.xxhash64("anchor").alias("token"), "offset", "n").distinct()
    keyed = grams.select(F.xxhash64("gram").alias("key"), "gram")
    docs = documents.select(*_row(), normal_words(F.col("text")).alias("w"))
    if small:  # one fused stage: the words of a text are at hand at each of its tokens
        tokens = docs.select(*_ROW, "w", F.posexplode_outer("w").alias("pos", "word"))
        places = tokens.withColumn("token", F.xxhash64("word")).join(sent(anchors), "token").withColumn("at", F.col("pos") - F.col("offset"))
    else:  # tokens travel alone, and a text's places come back to it
        tokens = docs.select(*_ROW, F.posexplode_outer("w").alias("pos", "word"))
        places = tokens.select(*_ROW, "pos", F.xxhash64("word").alias("token")).join(anchors, "token").groupBy(*_ROW).agg(F.collect_set(F.struct((F.col("pos") - F.col("offset")).alias("at"), "n")).alias("places"))
        places = docs.join(_renamed(places), _same()).select(*_ROW, "w", F.explode("places").alias("p")).select(*_ROW, "w", "p.*")
    seen = places.where("at >= 0 and at + n <= size(w)").select(*_ROW, "at", "n", F.expr("slice(w, greatest(at + 1, 1), n)").alias("seen")).withColumn("key", F.xxhash64("seen"))
    return seen.join(sent(keyed), "key").where("seen = gram").select(*_ROW, "at", "n", "gram")


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = 10, most_broadcast: int = 1_000_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = written(test_windows(benchmark, size), "items")
    found = written(hits(documents, windows, most_broadcast), "hits")
    words = found.groupBy(*_ROW).agg(F.collect_set(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("runs")).select(*_ROW, F.size(F.array_distinct(F.flatten("runs"))).alias("hit"))
    # The items of a window travel by themselves: one that stands in very many items is no part of a broadcast.
    items = found.select(*_ROW, "gram").distinct().join(windows.where("item is not null"), "gram").groupBy(*_ROW).agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = _renamed(words).join(items, _same(), "left").select(*(f"of_{c}" for c in _ROW), "hit", "items")
    rows = documents.select(*_row(), F.size(normal_words(F.col("text"))).cast("long").alias("n_words"))
    n_hit, items = F.coalesce("hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(found, _same(), "left").select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean_documents(documents: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The documents in which no test window occurs, with all their columns; copies of one row go or stay together."""
    bad = _renamed(hits(documents, test_windows(benchmark, size)).select(*_ROW).distinct())
    rows = documents.select(F.struct("*").alias("row"), *_row()).join(bad, _same(), "left_anti")
    return rows.select(*(F.col("row").getField(c).alias(c) for c in documents.columns))


def op4(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), w AS (
  SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM t
), g AS (
  SELECT DISTINCT id AS item, len(x) AS n, md5(array_to_string(x, ' ')) AS h FROM (SELECT id, w[i:i+9] AS x FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM w WHERE kind = 'b' AND len(w) > 0))
), n AS (SELECT DISTINCT n FROM g),
s AS (
  SELECT id, n, i, md5(array_to_string(w[i:i+n-1], ' ')) AS h FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, n WHERE kind = 'd' AND len(w) >= n)
), o AS (SELECT s.id, s.i, s.n, g.item FROM s JOIN g USING (h, n)),
c AS (SELECT id, count(DISTINCT k) AS hit FROM (SELECT id, unnest(range(i, i + n)) AS k FROM o) GROUP BY id),
m AS (SELECT id, count(*) AS items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS item FROM o) GROUP BY id)
SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(c.hit, 0) AS n_hit, coalesce(m.items, 0) AS n_items, sha256(coalesce(m.list, '')) AS items_sha256, coalesce(c.hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c ON c.id = w.id LEFT JOIN m ON m.id = w.id WHERE w.kind = 'd'
"""
