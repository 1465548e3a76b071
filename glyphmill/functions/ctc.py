"""Greedy CTC decoding as column expressions over (time, class) scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.text import bound


def best_classes(scores: Column) -> Column:
    """array<struct<c, s>>: the class (from 0, the first of equals) and score of each time step."""
    return F.transform(scores, lambda row: F.struct((F.array_position(row, F.array_max(row)) - 1).cast("int").alias("c"), F.array_max(row).cast("double").alias("s")))


def decode(scores: Column, alphabet: Column) -> Column:
    """struct(text, score). Class 0 is blank; a class counts where it differs from the step before.

    A class beyond the alphabet adds no character, but its score counts in the mean. No step left: '', 0.
    """

    def collapse(steps: Column) -> Column:
        return F.filter(steps, lambda x, i: (x["c"] != 0) & (F.when(i == 0, 0).otherwise(F.coalesce(F.try_element_at(steps, F.greatest(i, F.lit(1)))["c"], F.lit(0))) != x["c"]))

    def read(kept: Column) -> Column:
        text = F.array_join(F.transform(kept, lambda x: F.coalesce(F.try_element_at(alphabet, x["c"] + 1), F.lit(""))), "")
        mean = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x["s"]) / F.size(kept)
        return F.struct(text.alias("text"), F.when(F.size(kept) > 0, mean).otherwise(0.0).alias("score"))

    return bound(lambda steps: bound(read, collapse(steps)), best_classes(scores))
