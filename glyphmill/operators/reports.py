"""Report tables with their row order: speed, accuracy, chart data and console text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.accuracy import FIELDS
from glyphmill.operators.latency import side_by_side, winner

#: The rows of the speed report, and how each is shown.
_SPEED = (("Number of Images", "num_images", "%.0f"), ("Average Time (ms)", "avg_ms", "%.2f"), ("Median Time (ms)", "median_ms", "%.2f"), ("Min Time (ms)", "min_ms", "%.2f"), ("Max Time (ms)", "max_ms", "%.2f"), ("Std Dev (ms)", "std_ms", "%.2f"), ("P95 Time (ms)", "p95_ms", "%.2f"), ("P99 Time (ms)", "p99_ms", "%.2f"), ("Throughput (FPS)", "throughput_fps", "%.2f"), ("Total Time (s)", "total_time_s", "%.2f"), ("Avg Detection (ms)", "avg_detection_ms", "%.2f"), ("Avg Recognition (ms)", "avg_recognition_ms", "%.2f"))
#: Heads of the field blocks of the accuracy report.
_HEADS = {"color": "COLOR", "productCode": "PRODUCT CODE", "size": "SIZE", "positionQuantity": "POSITION/QUANTITY"}


def speed_values(stats: DataFrame, first: str, second: str) -> DataFrame:
    """(row_no, metric, first, second, speedup) as numbers; speedup only of mean and throughput, 0 where the first has no mean."""
    pair = side_by_side(stats, first, second)
    a, b = F.col("first_avg_ms"), F.col("second_avg_ms")
    ratio = F.when(a > 0, b / a).otherwise(0.0)
    rows = [F.struct(F.lit(i).alias("row_no"), F.lit(name).alias("metric"), F.col(f"first_{c}").cast("double").alias("first"), F.col(f"second_{c}").cast("double").alias("second"), (ratio if c in ("avg_ms", "throughput_fps") else F.lit(None).cast("double")).alias("speedup")) for i, (name, c, _) in enumerate(_SPEED, 1) if c in stats.columns]
    return pair.select(F.inline(F.array(*rows)))


def speed_report(stats: DataFrame, first: str, second: str) -> DataFrame:
    """The values as text, with - for what does not apply."""
    shown = F.lit(None).cast("string")
    rows = speed_values(stats, first, second)
    for name, _, pattern in _SPEED:
        shown = F.when(F.col("metric") == name, F.lit(pattern)).otherwise(shown)
    text = lambda c: F.coalesce(F.when(shown == "%.0f", F.format_string("%.0f", F.col(c))).when(F.col(c).isNotNull(), F.format_string("%.2f", F.col(c))), F.lit("-"))
    return rows.select("row_no", "metric", text("first").alias(first), text("second").alias(second), F.coalesce(F.when(F.col("speedup").isNotNull(), F.format_string("%.2fx", "speedup")), F.lit("-")).alias("Speedup"))


def accuracy_values(field_stats: DataFrame, overall: DataFrame, first: str, second: str) -> DataFrame:
    """Two runs' statistics side by side, see `compared`."""
    return compared(field_stats.select("pipeline", "field", "exact_pct", "acceptable_pct", "avg_score").unionByName(overall.select("pipeline", F.lit("overall").alias("field"), F.col("all_exact_pct").alias("exact_pct"), F.col("all_acceptable_pct").alias("acceptable_pct"), "avg_score")), first, second)


def compared(both: DataFrame, first: str, second: str) -> DataFrame:
    """(row_no, field, metric, first, second, winner, delta) as numbers, missing ones 0; fields in order, then overall. both: as accuracy.both_statistics."""
    zero = lambda c: F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0))
    metrics = ("exact_pct", "acceptable_pct", "avg_score")
    sides = both.groupBy("field").agg(*(zero(F.max(F.when(F.col("pipeline") == side, F.col(m)))).alias(f"{tag}_{m}") for tag, side in (("first", first), ("second", second)) for m in metrics))
    places = {f: i for i, f in enumerate([*FIELDS, "overall"])}
    place: Column = F.create_map(*(F.lit(x) for kv in places.items() for x in kv))[F.col("field")]

    def row(k: int, metric: str) -> Column:
        a, b = F.col(f"first_{metric}"), F.col(f"second_{metric}")
        return F.struct((place * 3 + k + 1).cast("int").alias("row_no"), F.lit(metric).alias("metric"), a.alias("first"), b.alias("second"), winner(a, b, first, second).alias("winner"), (a - b).alias("delta"))

    return sides.select("field", F.inline(F.array(*(row(k, m) for k, m in enumerate(metrics))))).select("row_no", "field", "metric", "first", "second", "winner", "delta")


def accuracy_report(values: DataFrame, first: str, second: str) -> DataFrame:
    """The values as text lines in order, with the heads of their blocks."""
    #: The names of the lines.
    names = {"exact_pct": "  Exact Match (%)", "acceptable_pct": "  Acceptable (>=0.90) (%)", "avg_score": "  Avg Score"}
    name = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("metric")]
    text = lambda c: F.when(F.col("metric") == "avg_score", F.format_string("%.3f", c)).otherwise(F.format_string("%.1f%%", c))
    lines = values.select((F.col("row_no") * 2).alias("row_no"), name.alias("Metric"), text("first").alias(first), text("second").alias(second), F.col("winner").alias("Winner"))
    head = F.create_map(*(F.lit(x) for kv in (_HEADS | {"overall": "OVERALL"}).items() for x in kv))[F.col("field")]
    heads = values.where("metric = 'exact_pct'").select((F.col("row_no") * 2 - 1).alias("row_no"), F.concat(F.lit("=== "), head, F.lit(" ===")).alias("Metric"), F.lit("").alias(first), F.lit("").alias(second), F.lit("").alias("Winner"))
    return heads.unionByName(lines)


def bar_chart(stats: DataFrame, first: str, second: str) -> DataFrame:
    """(metric, pipeline, value, axis_max): the bars of the latency chart, the axis a fifth over the highest."""
    rows = stats.where(F.col("pipeline").isin(first, second)).select("pipeline", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("avg_ms", "median_ms", "p95_ms", "p99_ms")))))
    highest = rows.agg((F.max("value") * 1.2).alias("axis_max"))
    return rows.join(F.broadcast(highest)).select("metric", "pipeline", "value", "axis_max")  # highest is one row


def text_table(report: DataFrame, widths: tuple[int, ...] = (30, 15, 15, 15)) -> DataFrame:
    """(row_no, line): the first column to the left, the others to the right; cells that are too long are not cut."""
    columns = [c for c in report.columns if c != "row_no"]
    padded = lambda pad, c, w: F.when(F.char_length(F.col(c)) < w, pad(F.col(c), w, " ")).otherwise(F.col(c))
    cells = [padded(F.rpad, columns[0], widths[0])] + [padded(F.lpad, c, w) for c, w in zip(columns[1:], widths[1:], strict=False)]
    return report.select("row_no", F.concat(*cells).alias("line"))


#: Heads of the two panels of the accuracy chart.
_PANELS = ("Accuracy by Field", "Overall Accuracy Metrics")


def accuracy_chart(field_stats: DataFrame, overall: DataFrame, first: str, second: str) -> DataFrame:
    """(panel, place, metric, pipeline, value, shown, axis_max): the bars of both accuracy panels, percentages as shares."""
    names = F.col("pipeline").isin(first, second)
    places = F.create_map(*(F.lit(x) for kv in {f: i for i, f in enumerate(FIELDS)}.items() for x in kv))
    fields = field_stats.where(names).select(F.lit(_PANELS[0]).alias("panel"), places[F.col("field")].alias("place"), F.col("field").alias("metric"), "pipeline", F.coalesce("avg_score", F.lit(0.0)).alias("value"), F.format_string("%.2f", F.coalesce("avg_score", F.lit(0.0))).alias("shown"))
    bars = [("Avg Score", F.col("avg_score"), "%.2f", 1.0), ("All Exact (%)", F.col("all_exact_pct"), "%.1f%%", 100.0), ("All Acceptable (%)", F.col("all_acceptable_pct"), "%.1f%%", 100.0)]
    rows = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(name).alias("metric"), (F.coalesce(v, F.lit(0.0)) / scale).alias("value"), F.format_string(pattern, F.coalesce(v, F.lit(0.0))).alias("shown")) for i, (name, v, pattern, scale) in enumerate(bars)))
    whole = overall.where(names).select(F.lit(_PANELS[1]).alias("panel"), "pipeline", F.inline(rows)).select("panel", "place", "metric", "pipeline", "value", "shown")
    return fields.unionByName(whole).withColumn("axis_max", F.lit(1.2))


def run_summary(details: DataFrame, metric: str = "total_ms") -> DataFrame:
    """(row_no, line): what one run says of itself at its end; spread is that of a population. No lines for no images."""
    x = F.col(metric)
    sums = details.where(x.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("avg"), F.min(x).alias("min"), F.max(x).alias("max"), F.stddev_pop(x).alias("std")).where("n > 0")
    bar = F.lit("=" * 60)
    ms = lambda head, c: F.concat(F.lit(f"  {head:<24}"), F.format_string("%.2f ms", F.col(c)))
    lines = [bar, F.lit("BENCHMARK SUMMARY"), bar, F.concat(F.lit(f"  {'Total images processed:':<24}"), F.col("n").cast("string")), ms("Average time:", "avg"), ms("Minimum time:", "min"), ms("Maximum time:", "max"), ms("Std deviation:", "std"), F.concat(F.lit(f"  {'Throughput:':<24}"), F.when(F.col("avg") > 0, F.format_string("%.2f images/sec", 1000 / F.col("avg"))).otherwise("-")), bar]
    return sums.select(F.posexplode(F.array(*lines)).alias("row_no", "line"))


def accuracy_summary(field_stats: DataFrame, overall: DataFrame, first: str, second: str) -> DataFrame:
    """(row_no, line): the accuracy of two runs for a console, block by block, and who is ahead by how much."""
    values = accuracy_values(field_stats, overall, first, second)
    cell = lambda c, w: F.when(F.char_length(c) < w, F.lpad(c, w, " ")).otherwise(c)
    line = lambda head, *cells: F.concat(F.rpad(F.lit(head) if isinstance(head, str) else head, 35, " "), *(F.concat(F.lit(" "), cell(c, 12)) for c in cells))
    thick, thin = F.lit("=" * 75), F.lit("-" * 75)
    metric, block = F.col("metric"), F.col("field")
    whole = block == "overall"
    # The overall block starts with its score.
    order = F.when(whole, F.create_map(*(F.lit(x) for x in ("avg_score", 0, "exact_pct", 1, "acceptable_pct", 2)))[metric]).otherwise((F.col("row_no") - 1) % 3)
    head = F.when(metric == "avg_score", "  - Average Score").when(whole & (metric == "exact_pct"), "  - All Fields Exact").when(whole, "  - All Fields Acceptable").when(metric == "exact_pct", "  - Exact Match (%)").otherwise("  - Acceptable (>=0.90)")
    shown = lambda c: F.when(metric == "avg_score", F.format_string("%.3f", F.col(c))).otherwise(F.format_string("%.1f%%", F.col(c)))
    blocks = F.floor((F.col("row_no") - 1) / 3)
    body = values.select((blocks * 10 + order + 10).alias("row_no"), line(head, shown("first"), shown("second"), F.col("winner")).alias("line"))
    names = F.create_map(*(F.lit(x) for kv in (_HEADS | {"overall": "OVERALL"}).items() for x in kv))
    heads = values.where("metric = 'exact_pct'").select((blocks * 10 + 9).alias("row_no"), F.concat(names[block], F.lit(":")).alias("line"))
    ends = values.where("metric = 'exact_pct'").select((blocks * 10 + 15).alias("row_no"), F.when(whole, thick).otherwise(thin).alias("line"))
    side = lambda name: F.coalesce(F.max(F.when(F.col("pipeline") == name, F.col("num_images"))), F.lit(0)).cast("string")
    top = overall.agg(side(first).alias("a"), side(second).alias("b")).select(F.posexplode(F.array(thick, F.lit(" ACCURACY COMPARISON SUMMARY ".center(75, "=")), thick, line("Metric", F.lit(first), F.lit(second), F.lit("Winner")), thin, line("Images Evaluated", F.col("a"), F.col("b"), F.lit("-")), thick)).alias("row_no", "line"))
    ahead = F.concat(F.lit(">>> "), F.col("winner"), F.lit(" has "), F.format_string("%.1f%%", F.abs(F.col("delta")) * 100), F.lit(" higher accuracy than "), F.when(F.col("winner") == first, second).otherwise(first), F.lit(" <<<"))
    last = values.where(whole & (metric == "avg_score")).select((blocks * 10 + 16).alias("row_no"), F.when(F.col("winner") == "Tie", ">>> Both pipelines have equal accuracy <<<").otherwise(ahead).alias("line"))
    out = top
    for part in (heads, body, ends, last):
        out = out.unionByName(part.withColumn("row_no", F.col("row_no").cast("int")))
    return out
