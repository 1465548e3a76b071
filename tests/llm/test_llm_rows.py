"""Rows without ids and rows that share one are judged by their texts."""

from pyspark.sql import functions as F

from glyphmill.llm import decontamination, near_dedup


def test_null_ids_do_not_mix_up_texts(spark):
    item = " ".join(f"item{i}" for i in range(12))
    n = 60_000
    docs = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit(item + " "), "id")).otherwise(F.concat(F.lit("clean "), "id")).alias("text"), F.lit(1).alias("row"), F.lit(2).alias("gram"))
    benchmark = spark.createDataFrame([(1, item, 1), (2, item, 1), (None, "clean words only", 1)], "item_id long, text string, gram int")
    clean = decontamination.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == n // 2 and clean.where("text like 'item%'").isEmpty()
    got = decontamination.contamination(docs, benchmark).groupBy("contaminated").agg(F.count("*").alias("n"), F.min("n_hit"), F.max("n_hit"), F.min("n_items"), F.max("n_items")).collect()
    assert sorted(map(tuple, got)) == [(False, n // 2, 0, 0, 0, 0), (True, n // 2, 12, 12, 2, 2)]


def test_an_item_in_many_rows_is_counted_once(spark):
    items = [(i, "one two three four five six seven eight nine ten") for i in range(300)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + items[0][1] + " y " + items[0][1]), (2, "")], "doc_id long, text string")
    for most in (1000, 0):
        got = {r.doc_id: (r.n_hit, r.n_items) for r in decontamination.contamination(docs, benchmark, most_broadcast=most).collect()}
        assert got == {1: (20, 300), 2: (0, 0)}


def test_first_of_groups_keeps_other_texts_of_an_id(spark):
    copy, other = (" ".join(f"{w}{i}" for i in range(80)) for w in ("a", "b"))
    rows = [(1, copy, 1), (3, copy, 1), (3, other, 1), (None, copy, 1), (4, None, 1), (5, "", 1), (1, copy, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_hash int")
    kept = near_dedup.first_of_groups(docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.where("not (doc_id <=> 3 and coalesce(text, '') like 'a%')").collect()))
