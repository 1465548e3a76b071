"""Positions and sliding frames in one global order, without one task that holds all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A range for every so many rows; the driver holds PER_RANGE sampled keys for each of at most MOST_RANGES.
ROWS_PER_RANGE, MOST_RANGES, PER_RANGE = 1_000_000, 65_536, 40


def cumulated(df: DataFrame, order: tuple[str, ...], weight: str | None = None, name: str = "before", rows_per_range: int = ROWS_PER_RANGE) -> tuple[DataFrame, int]:
    """df with the sum of `weight` (of ones, if None) over all rows that precede each in the order of `order`, and the number of rows.

    Rows are dealt into ranges, bounded by a sample of about PER_RANGE keys a range that decides only how even the ranges are; a range
    is summed up by itself and begins where those before it end. A row finds its range by halving. `order` should be unique; ties fall anyhow.
    """
    one = F.col(weight) if weight else F.lit(1)
    rows = df.count()
    ranges = min(MOST_RANGES, -(-rows // rows_per_range))
    key = F.struct(*order)
    place = F.lit(0)
    if ranges > 1:
        share = min(1.0, PER_RANGE * ranges / rows)
        bounds = df.select(key.alias("k")).sample(share, seed=1).groupBy(F.spark_partition_id()).agg(F.collect_list("k").alias("ks")).select(F.array_sort("ks").alias("ks"))
        cuts = bounds.agg(F.array_sort(F.flatten(F.collect_list("ks"))).alias("ks")).select(F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda i: F.try_element_at("ks", F.greatest(F.ceil(i * F.size("ks") / ranges).cast("int"), F.lit(1)))).alias("cuts"))
        cuts = df.sparkSession.createDataFrame(cuts.collect(), cuts.schema)  # fixed here: a second sample could differ
        df = df.join(F.broadcast(cuts))  # one row of fewer than MOST_RANGES keys
        steps = F.array(*(F.lit(1 << i) for i in reversed(range((ranges - 1).bit_length()))))
        # The number of cuts before the key: steps of falling powers of two as long as the cut they reach is before it.
        place = F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= F.size("cuts")) & (F.try_element_at("cuts", n + step) < key), n + step).otherwise(n))
    df = df.withColumn("__range", F.coalesce(place, F.lit(0)))
    begin, offsets = 0, []
    sums = df.groupBy("__range").agg(F.sum(one).alias("s")).collect()  # at most MOST_RANGES rows
    for r in sorted(sums, key=lambda r: r["__range"]):
        offsets.append((r["__range"], begin))
        begin += r["s"]
    start = F.lit(0)
    if len(offsets) > 1:
        starts = df.sparkSession.createDataFrame(offsets, f"__of int, __start {dict(df.agg(F.sum(one).alias('s')).dtypes)['s']}")
        df, start = df.join(F.broadcast(starts), F.col("__range") == F.col("__of")).drop("__of"), F.col("__start")
    window = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn(name, (start + F.coalesce(F.sum(one).over(window), F.lit(0))).cast("long"))
    return out.drop("__range", "cuts", "__start"), rows


def numbered(df: DataFrame, order: tuple[str, ...], name: str = "position", rows_per_range: int = ROWS_PER_RANGE) -> tuple[DataFrame, int]:
    """df with each row's place from 0 in the order of `order`, and the number of rows."""
    return cumulated(df, order, None, name, rows_per_range)


def exact_percentiles(df: DataFrame, by: str, value: str, percents: tuple[float, ...], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(by, percent, value): interpolated percentiles of each group, however many distinct values it has.

    The aggregate `percentile` keeps every distinct value of a group in one state; here distinct values are counted,
    put in one order with `by` and cumulated in ranges, and only the values at the ranks in question are kept.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    running, _ = cumulated(counts, ("g", "v"), "n", "before", rows_per_range)
    groups = running.groupBy("g").agg(F.min("before").alias("start"), F.sum("n").alias("rows"))
    ranks = groups.select(F.col("g").alias("h"), "start", F.explode(F.array(*(F.struct(F.lit(p).alias("percent"), (F.lit(p) * (F.col("rows") - 1)).alias("rank")) for p in percents))).alias("p"))
    ranks = ranks.select("h", "start", "p.*")
    lower, upper = F.col("start") + F.floor("rank"), F.col("start") + F.ceil("rank")
    inside = lambda at: (F.col("before") <= at) & (at < F.col("before") + F.col("n"))
    found = running.join(ranks, F.col("g").eqNullSafe(F.col("h")) & (inside(lower) | inside(upper)))
    ends = found.groupBy("g", "percent", "rank").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return ends.select(F.col("g").alias(by), "percent", (F.col("lo") + (F.col("rank") - F.floor("rank")) * (F.col("hi") - F.col("lo"))).alias(value))


def hot_apart(df: DataFrame, by: str, rows_per_range: int = ROWS_PER_RANGE, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """df without, and with only, the rows of groups of over rows_per_range rows; None where there is no such group.

    keys: the same groups in a frame that is cheaper to count, where df is dear.
    """
    large = (df if keys is None else keys).groupBy(F.col(by).alias("__of")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_per_range).select("__of").collect()  # at most rows / rows_per_range
    if not large:
        return df, None
    keys = df.sparkSession.createDataFrame(large, df.select(F.col(by).alias("__of")).schema)
    same = F.col(by).eqNullSafe(F.col("__of"))
    return df.join(F.broadcast(keys), same, "left_anti"), df.join(F.broadcast(keys), same, "left_semi")


def sliding(df: DataFrame, order: tuple[str, ...], size: int, value: Callable[[object], Column], name: str, rows_per_range: int = ROWS_PER_RANGE, by: str | None = None) -> DataFrame:
    """df with value(window) over each row and the size - 1 before it in a global order, of the same group if `by` is given.

    Rows are cut by position into tiles; the last size - 1 rows of a tile also stand, as a lead, before the next.
    """
    rows, _ = numbered(df, (by, *order) if by else order, "__at", rows_per_range)
    tile = max(rows_per_range, 4 * size)
    own = F.floor(F.col("__at") / tile)
    lead = (F.col("__at") % tile) >= tile - (size - 1)
    tiles = F.when(lead, F.array(own, own + 1)).otherwise(F.array(own))
    window = Window.partitionBy("__tile", *([by] if by else [])).orderBy("__at").rowsBetween(-(size - 1), 0)
    out = rows.withColumn("__tile", F.explode(tiles)).withColumn(name, value(window))
    return out.where(F.col("__tile") == own).drop("__tile", "__at")
