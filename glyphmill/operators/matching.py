"""Best candidate for a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions import text as T

#: Candidate lists of up to so many rows and characters are broadcast; longer ones are dealt into blocks of BLOCK, and each text goes to every block.
MOST_BROADCAST, MOST_CHARS, BLOCK = 10_000, 8_000_000, 2_000


def best_in(text: Column, candidates: Column, min_score: float = 0.0) -> Column:
    """struct(match, score) of the best string in an array column: strictly over min_score, the first of equals, else ('', min_score).

    An empty text or list gives ('', 0).
    """
    scored = F.transform(candidates, lambda c, i: F.struct(T.combined_similarity(text, c).alias("s"), (-i).alias("i"), c.alias("c")))
    best = F.array_max(scored)
    none = F.struct(F.lit("").alias("match"), F.lit(float(min_score)).alias("score"))
    empty = F.struct(F.lit("").alias("match"), F.lit(0.0).alias("score"))
    found = T.bound(lambda b: F.when(b["s"] > min_score, F.struct(b["c"].alias("match"), b["s"].alias("score"))).otherwise(none), best)
    return F.when((F.coalesce(text, F.lit("")) == "") | (F.coalesce(F.size(candidates), F.lit(0)) == 0), empty).otherwise(found)


def best_match(texts: DataFrame, candidates: DataFrame, text: str, candidate: str, order: str, min_score: float = 0.0) -> DataFrame:
    """(text, match, score) of each distinct text against all candidates, ordered by `order`.

    Each distinct pair is scored once, and a partial aggregate keeps the best per text, so pairs are never shuffled. The texts are
    a query set against all candidates, in blocks: the task of a block meets the texts one by one.
    """
    distinct = texts.select(F.coalesce(text, F.lit("")).alias("text")).distinct()
    names = candidates.select(F.col(candidate).alias("candidate"), F.col(order).alias("position"))
    rows, chars = names.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.char_length("candidate")), F.lit(0))).first()
    if rows <= MOST_BROADCAST and chars <= MOST_CHARS:
        pairs = distinct.where("text <> ''").join(F.broadcast(names))
    else:
        blocks = -(-rows // BLOCK)
        dealt = names.withColumn("block", F.pmod(F.xxhash64("candidate", "position"), F.lit(blocks)))
        asked = distinct.where("text <> ''").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        pairs = asked.join(dealt.hint("shuffle_hash"), "block").drop("block")
    score = T.combined_similarity(F.col("text"), F.col("candidate"))
    best = pairs.select("text", F.struct(score.alias("s"), (-F.col("position")).alias("p"), "candidate").alias("b")).groupBy("text").agg(F.max("b").alias("b"))
    hit = F.col("b.s") > min_score
    scored = distinct.join(best, "text", "left").select("text", F.when(hit, F.col("b.candidate")).otherwise("").alias("match"), F.when(hit, F.col("b.s")).when(F.col("b").isNull(), 0.0).otherwise(float(min_score)).alias("score"))
    return scored


def scored_pairs(pairs: DataFrame, a: str, b: str, score) -> DataFrame:
    """pairs with column `score` = score(a, b), each distinct pair scored once and joined back."""
    left, right = F.col(a), F.col(b)
    once = pairs.select(left.alias("__a"), right.alias("__b")).distinct().withColumn("score", score(F.col("__a"), F.col("__b")))
    return pairs.join(once, left.eqNullSafe(F.col("__a")) & right.eqNullSafe(F.col("__b"))).drop("__a", "__b")


def above(pairs: DataFrame, a: str, b: str, threshold: float) -> DataFrame:
    """Pairs whose combined similarity reaches the threshold.

    For 0.9 and more, pairs of lengths under one to two are left out unscored: with m matches Jaro is at most
    (2 + shorter / longer) / 3, and Jaro-Winkler reaches 0.9 only from a Jaro of 5/6.
    """
    if threshold >= 0.9:
        n, m = (F.char_length(F.upper(T.strip(F.col(c)))) for c in (a, b))
        pairs = pairs.where((F.least(n, m) * 2 >= F.greatest(n, m)) | (F.greatest(n, m) == 0))
    return pairs.where(T.is_match(F.col(a), F.col(b), threshold))


def ranked(pairs: DataFrame, by: str, score: str, *ties: str) -> DataFrame:
    """The best row of each group: greatest score, then the least of ties."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), *ties))
    return pairs.withColumn("rank", rank).where("rank = 1").drop("rank")
