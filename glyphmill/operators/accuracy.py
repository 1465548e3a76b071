"""Accuracy of recognised texts against expected fields.

An image is one row: four expected values and its texts. All field-text similarities are computed once into a matrix; two
folds over it assign texts to fields, so evaluation needs no shuffle beyond the join of both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as T

#: In order of assignment, with the weight of each in the score.
FIELDS = {"color": 0.25, "productCode": 0.25, "size": 0.25, "positionQuantity": 0.25}

# First fold: fields in order; the best free text, the first of equals, is taken if it is acceptable.
_CONFIDENT = f"""aggregate(sequence(1, {len(FIELDS)}), cast(array() as array<int>), (taken, f) ->
  transform(array(array_max(transform(filter(places, t -> not array_contains(taken, t)), t -> struct(sims[f - 1][t - 1] as s, -t as t)))),
    best -> array_append(taken, if(expected[f - 1] <> '' and best.s >= {T.ACCEPTABLE}, -best.t, 0)))[0])"""
# Second fold: as often as there are fields, the best free pair, the first of equals by field, then text.
_REST = f"""aggregate(sequence(1, {len(FIELDS)}), sure, (taken, k) ->
  transform(array(array_max(flatten(transform(filter(sequence(1, {len(FIELDS)}), f -> expected[f - 1] <> '' and taken[f - 1] = 0), f ->
      transform(filter(places, t -> not array_contains(taken, t)), t -> struct(sims[f - 1][t - 1] as s, -f as f, -t as t)))))),
    best -> if(best is null, taken, transform(taken, (t, i) -> if(i + 1 = -best.f, -best.t, t))))[0])"""


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that the optimizer cannot copy into the expressions that use it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def paired_images(expected: DataFrame, results: DataFrame, expected_name: str = "file_name", result_name: str = "file_name") -> DataFrame:
    """Expected values joined with the result of the same image: key, the fields, texts. Images that lack either side drop out."""
    left = expected.select(T.filename_base(F.col(expected_name)).alias("base"), *FIELDS)
    right = results.select(T.filename_base(F.col(result_name)).alias("base"), F.transform(F.col("text_regions"), lambda r: F.coalesce(r["text"], F.lit(""))).alias("texts"))
    return left.join(right, "base").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))


def evaluate(images: DataFrame, pipeline: str | Column, extension: str = ".png") -> DataFrame:
    """One row per image with base, the FIELDS and texts: filename, pipeline, gt_/ocr_/score_/match_type_ of each field, and the overall columns."""
    tag = F.lit(pipeline) if isinstance(pipeline, str) else pipeline
    rows = images.select("base", tag.alias("pipeline"), F.array(*(F.coalesce(f, F.lit("")) for f in FIELDS)).alias("expected"), "texts")
    rows = rows.withColumn("places", F.when(F.size("texts") > 0, F.sequence(F.lit(1), F.size("texts"))).otherwise(F.array().cast("array<int>")))
    sims = F.transform("expected", lambda e: F.transform("texts", lambda t: F.when(e != "", T.field_similarity(e, t)).otherwise(0.0)))
    rows = once(rows, "sims", sims)
    rows = once(rows, "sure", F.expr(_CONFIDENT))
    rows = once(rows, "taken", F.expr(_REST))
    columns, total, exact, fine = [], F.lit(0.0), F.lit(True), F.lit(True)
    for i, (field, weight) in enumerate(FIELDS.items()):
        place = F.col("taken")[i]
        has = place > 0
        score = F.when(has, F.expr(f"try_element_at(sims[{i}], nullif(taken[{i}], 0))")).otherwise(0.0)
        kind = T.match_class(score, has)
        columns += [F.col("expected")[i].alias(f"gt_{field}"), F.when(has, F.expr(f"try_element_at(texts, nullif(taken[{i}], 0))")).otherwise("").alias(f"ocr_{field}"), score.alias(f"score_{field}"), kind.alias(f"match_type_{field}")]
        total = total + score * weight
        exact, fine = exact & (kind == "exact"), fine & kind.isin("exact", "acceptable")
    return rows.select(F.concat("base", F.lit(extension)).alias("filename"), "pipeline", *columns, total.alias("avg_accuracy_score"), exact.alias("all_exact"), fine.alias("all_acceptable"))


def long_form(accuracy: DataFrame) -> DataFrame:
    """(filename, pipeline, field, gt_value, ocr_value, similarity, match_type): a row per field."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"gt_{f}").alias("gt_value"), F.col(f"ocr_{f}").alias("ocr_value"), F.col(f"score_{f}").alias("similarity"), F.col(f"match_type_{f}").alias("match_type")) for f in FIELDS))
    return accuracy.select("filename", "pipeline", F.inline(fields))


def field_statistics(accuracy: DataFrame) -> DataFrame:
    """Per pipeline and field: mean score, counts and percentages; acceptable includes exact."""
    kind = F.col("match_type")
    fine = kind.isin("exact", "acceptable")
    return long_form(accuracy).groupBy("pipeline", "field").agg(
        F.count(F.lit(1)).alias("num_images"),
        F.avg("similarity").alias("avg_score"),
        F.count_if(kind == "exact").alias("exact_count"),
        F.count_if(fine).alias("acceptable_count"),
        F.count_if(kind == "rejected").alias("rejected_count"),
        F.count_if(kind == "missing").alias("missing_count"),
        (F.avg((kind == "exact").cast("double")) * 100).alias("exact_pct"),
        (F.avg(fine.cast("double")) * 100).alias("acceptable_pct"),
    )


def both_statistics(accuracy: DataFrame) -> DataFrame:
    """(pipeline, field, exact_pct, acceptable_pct, avg_score) of each field and of `overall`, in one pass over the images."""
    kind = lambda f: F.col(f"match_type_{f}")
    rows = [F.struct(F.lit(f).alias("field"), F.col(f"score_{f}").alias("score"), (kind(f) == "exact").alias("exact"), kind(f).isin("exact", "acceptable").alias("fine")) for f in FIELDS]
    rows.append(F.struct(F.lit("overall").alias("field"), F.col("avg_accuracy_score").alias("score"), F.col("all_exact").alias("exact"), F.col("all_acceptable").alias("fine")))
    share = lambda c: F.avg(F.col(c).cast("double")) * 100
    return accuracy.select("pipeline", F.inline(F.array(*rows))).groupBy("pipeline", "field").agg(share("exact").alias("exact_pct"), share("fine").alias("acceptable_pct"), F.avg("score").alias("avg_score"))


def overall_statistics(accuracy: DataFrame) -> DataFrame:
    return accuracy.groupBy("pipeline").agg(
        F.count(F.lit(1)).alias("num_images"),
        F.avg("avg_accuracy_score").alias("avg_score"),
        F.count_if("all_exact").alias("all_exact_count"),
        F.count_if("all_acceptable").alias("all_acceptable_count"),
        (F.avg(F.col("all_exact").cast("double")) * 100).alias("all_exact_pct"),
        (F.avg(F.col("all_acceptable").cast("double")) * 100).alias("all_acceptable_pct"),
    )
