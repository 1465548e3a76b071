"""Latency statistics and comparisons of runs tagged by pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.ordering import ROWS_PER_RANGE, hot_apart, numbered, sliding


def number(text: Column) -> Column:
    """A double, or null where the text is none or NaN."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def tagged(details: DataFrame, pipeline: str, metrics: tuple[str, ...] = ("detection_ms", "recognition_ms", "total_ms")) -> DataFrame:
    """A run's details with its name as column `pipeline` and the metrics it has as numbers."""
    return details.withColumns({m: number(F.col(m)) for m in metrics if m in details.columns} | {"pipeline": F.lit(pipeline)})


def _safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def statistics(details: DataFrame, metric: str = "total_ms", by: str = "pipeline", population: bool = False) -> DataFrame:
    """One row per pipeline, in one pass: counts include rows without the metric, the rest skips them.

    Percentiles are exact and interpolated; spread is that of a sample, or of a population. A pipeline without any value has null
    statistics, throughput 0 and total 0.
    """
    x = F.col(metric)
    spread = F.stddev_pop(x) if population else F.stddev_samp(x)
    aggregates = [F.count(F.lit(1)).alias("num_images"), F.avg(x).alias("avg_ms"), F.min(x).alias("min_ms"), F.max(x).alias("max_ms"), spread.alias("std_ms"), F.percentile(x, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("p"), F.sum(x).alias("s")]
    split = [m for m in ("detection_ms", "recognition_ms") if m in details.columns]
    if len(split) == 2:
        aggregates += [F.avg(m).alias(f"avg_{m}") for m in split]
    rows = details.groupBy(by).agg(*aggregates)
    return rows.select(by, "num_images", "avg_ms", "min_ms", "max_ms", "std_ms", F.col("p")[0].alias("median_ms"), F.col("p")[1].alias("p95_ms"), F.col("p")[2].alias("p99_ms"), _safe_ratio(F.lit(1000.0), F.col("avg_ms")).alias("throughput_fps"), (F.coalesce("s", F.lit(0.0)) / 1000).alias("total_time_s"), *([f"avg_{m}" for m in split] if len(split) == 2 else []))


def side_by_side(stats: DataFrame, first: str, second: str, by: str = "pipeline") -> DataFrame:
    """One row: every statistic of two pipelines as first_* and second_*; one conditional aggregate each, no join."""
    names = [c for c in stats.columns if c != by]
    return stats.agg(*(F.max(F.when(F.col(by) == side, F.col(c))).alias(f"{tag}_{c}") for tag, side in (("first", first), ("second", second)) for c in names))


def winner(a: Column, b: Column, first: str, second: str, lower_wins: bool = False) -> Column:
    """The name of the better side, or Tie; missing and NaN count as 0, so two missing values tie."""
    a, b = (F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0)) for x in (a.cast("double"), b.cast("double")))
    if lower_wins:
        a, b = b, a
    return F.when(a > b, first).when(b > a, second).otherwise("Tie")


def speedup(stats: DataFrame, first: str, second: str) -> DataFrame:
    """avg_ms of the second over that of the first, 0 where the first has none, and who is faster."""
    pair = side_by_side(stats, first, second)
    return pair.select("first_num_images", "second_num_images", "first_avg_ms", "second_avg_ms", _safe_ratio(F.col("second_avg_ms"), F.col("first_avg_ms")).alias("speedup"), winner(F.col("first_avg_ms"), F.col("second_avg_ms"), first, second, lower_wins=True).alias("faster"))


def paired(first: DataFrame, second: DataFrame, key: str = "filename", metric: str = "total_ms") -> DataFrame:
    """(filename, first_ms, second_ms) of images in both runs; repeats multiply and null names meet."""
    a = first.select(F.col(key).alias("filename"), F.col(metric).alias("first_ms"))
    b = second.select(F.col(key).alias("other"), F.col(metric).alias("second_ms"))
    return a.join(b, F.col("filename").eqNullSafe(F.col("other"))).drop("other")


def sampled(pairs: DataFrame, most: int = 50) -> DataFrame:
    """Over `most` rows, every (rows // most)th by filename, from the first; else all. position: rank by filename from 0."""
    rows, count = numbered(pairs, ("filename", "first_ms", "second_ms"))
    return rows.where(F.col("position") % max(1, count // most) == 0) if count > most else rows


def with_accuracy(details: DataFrame, accuracy: DataFrame | None, key: str = "filename") -> DataFrame:
    """Details with all columns of the accuracy table but its keys; without one, the details as they are."""
    if accuracy is None:
        return details
    wanted = [c for c in accuracy.columns if c not in (key, "pipeline")]
    other = accuracy.select(F.col(key).alias("__key"), *wanted)
    return details.join(other, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left that have no partner in right: the report of missing results."""
    return left.join(right.select(key), key, "left_anti")


def rolling_mean(samples: DataFrame, order: tuple[str, ...] = ("ts", "event_id"), value: str = "seconds", size: int = 200, by: str | None = None, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Mean of each row and the size - 1 before it, in ms, and the frame rate it means. Groups of over rows_per_range rows are cut into ranges."""
    mean = lambda window: F.avg(value).over(window) * 1000
    if by:
        usual, hot = hot_apart(samples, by, rows_per_range)
        rows = usual.withColumn("mean_ms", mean(Window.partitionBy(by).orderBy(*order).rowsBetween(-(size - 1), 0)))
        if hot is not None:
            rows = rows.unionByName(sliding(hot, order, size, mean, "mean_ms", rows_per_range, by))
    else:
        rows = sliding(samples, order, size, mean, "mean_ms", rows_per_range)
    return rows.withColumn("fps", F.when(F.col("mean_ms") > 0, 1000 / F.col("mean_ms")))


def batched(rows: DataFrame, order: tuple[str, ...], by: str, size: int = 6, rows_per_range: int = ROWS_PER_RANGE, keys: DataFrame | None = None) -> DataFrame:
    """Batch number by rank within each group, and the greatest ratio of each batch. Groups of over rows_per_range rows are ranked in ranges.

    keys: the groups of the rows, in a frame that is cheaper to count.
    """
    usual, hot = hot_apart(rows, by, rows_per_range, keys)
    ranked = usual.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
    if hot is not None:
        placed, _ = numbered(hot, (by, *order), "rank", rows_per_range)
        begin = placed.groupBy(F.col(by).alias("__of")).agg(F.min("rank").alias("__begin"))  # a row a hot group
        placed = placed.join(F.broadcast(begin), F.col(by).eqNullSafe(F.col("__of"))).withColumn("rank", (F.col("rank") - F.col("__begin")).cast("int"))
        ranked = ranked.unionByName(placed.drop("__of", "__begin"))
    done = ranked.withColumn("batch", F.floor(F.col("rank") / size).cast("int")).drop("rank")
    return done.withColumn("max_ratio", F.max("ratio").over(Window.partitionBy(by, "batch")))
