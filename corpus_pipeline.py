"""A corpus pipeline of five stages, each one of the operators at work on what its predecessor kept.

toxicity          rows whose text scores 0.3 or more go
near duplicates   of each group the rows with its smallest doc_id stay
decontamination   rows in which a benchmark window occurs go
mixing            each row stays as often as the mix draws it
sharding          each row gets its shard and its place there; the last stage, so it adds columns

Models and targets are fitted on what each stage is given; labels and benchmark are read beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import decontamination, mixing, near_dedup, sharding, toxicity
from glyphmill.llm.shared import forget, tables_written, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores under 0.3; the model is fitted on the labelled rows of docs, or is the prior where there are none.

    Null and empty texts: the intercept's score, so they stay under any model with more clean than toxic rows. Null id: scored, held out
    of the fit. Repeated rows, ties: each by its own text. Empty table: empty. Other columns pass through.
    """
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the rows that bear its smallest doc_id.

    Null and empty texts, null ids: in no group, kept. Repeated rows: of one id and text all stay or go; another text of the same
    id is judged by itself. Empty table: empty. Other columns pass through.
    """
    return near_dedup.first_of_groups(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark window occurs.

    Null and empty texts: no window, kept. Null id: judged by its text. Repeated rows: go or stay together. Empty tables on
    either side: nothing goes. Other columns pass through.
    """
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix draws it, so some not at all.

    Null and empty texts: weigh nothing, stand in the mix as often as their block is drawn. Null source: a source, the last. Null id: permuted
    as one value. Repeated rows: as many as fit, none cut. Empty table: empty. Other columns pass through.
    """
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its place there; sharding's columns replace columns of the same names.

    Null and empty texts: size 1. Null id, repeated rows, ties: each row has a place of its own. Empty table: empty.
    """
    return sharding.sharded_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Toxicity is learned, so no SQL gives these rows; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, written; what the stages wrote on the way is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = tables_written()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        forget(spark, before, keep_last=1)
    return docs
