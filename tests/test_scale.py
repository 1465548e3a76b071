"""Groups and lists that outgrow a task, and the reports."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphmill.operators import accuracy as E
from glyphmill.operators import latency as L
from glyphmill.operators import matching as M
from glyphmill.operators import reports


def rows(spark):
    """A group with two thirds of the rows, a null group, small ones."""
    key = F.when(F.col("id") % 3 > 0, F.lit(7)).when(F.col("id") % 9 == 0, F.col("id") % 5)
    return spark.range(400).select(key.alias("by"), "id", (F.pmod(F.xxhash64("id"), F.lit(40)) / 8.0).alias("ratio")).repartition(5)


@pytest.mark.parametrize("per_range", [11, 150, 10_000])
def test_hot_groups_are_ranked_in_ranges(spark, per_range):
    table = rows(spark)
    got = L.batched(table, ("ratio", "id"), "by", 6, per_range).collect()
    ranks = Window.partitionBy("by").orderBy("ratio", "id")
    twin = table.withColumn("batch", F.floor((F.row_number().over(ranks) - 1) / 6).cast("int")).withColumn("max_ratio", F.max("ratio").over(Window.partitionBy("by", "batch")))
    assert sorted(map(str, got)) == sorted(str(r) for r in twin.select("by", "id", "ratio", "batch", "max_ratio").collect())


@pytest.mark.parametrize("per_range", [11, 150, 10_000])
def test_hot_groups_slide_in_ranges(spark, per_range):
    table = rows(spark).withColumnRenamed("ratio", "seconds")
    got = L.rolling_mean(table, ("id",), "seconds", 5, "by", per_range).select("id", "mean_ms").collect()
    twin = table.withColumn("m", F.avg("seconds").over(Window.partitionBy("by").orderBy("id").rowsBetween(-4, 0)) * 1000)
    assert {r.id: r.mean_ms for r in got} == pytest.approx({r.id: r.m for r in twin.collect()}) and len(got) == 400


def test_best_match_in_blocks(spark, monkeypatch):
    names = spark.createDataFrame([(i, f"{'abc'[i % 3]}{i * 37 % 101}x{i % 7}") for i in range(60)], "position long, name string")
    texts = spark.createDataFrame([(t,) for t in ("a37x1", "b74", "", None, "c", "zzz", "a37x1")], "text string")
    one = sorted(map(str, M.best_match(texts, names, "text", "name", "position", 0.3).collect()))
    monkeypatch.setattr(M, "MOST_BROADCAST", 10)
    monkeypatch.setattr(M, "BLOCK", 7)
    blocked = M.best_match(texts, names, "text", "name", "position", 0.3)
    assert "Cartesian" not in blocked._jdf.queryExecution().toString()
    assert sorted(map(str, blocked.collect())) == one


def tables(spark):
    fields = ("color", "productCode", "size", "positionQuantity")
    images = [("i1", *("SAND", "1800", "XL", "1/2"), ["sand", "1800", "xl", "1/2"], "first"), ("i1", *("SAND", "1800", "XL", "1/2"), ["sond"], "second")]
    table = E.evaluate(spark.createDataFrame(images, "base string, " + ", ".join(f"{f} string" for f in fields) + ", texts array<string>, pipeline string"), F.col("pipeline"))
    return E.field_statistics(table), E.overall_statistics(table), E.both_statistics(table)


def test_one_pass_gives_both_statistics(spark):
    fields, overall, both = tables(spark)
    two = reports.accuracy_values(fields, overall, "first", "second").orderBy("row_no").collect()
    assert two == reports.compared(both, "first", "second").orderBy("row_no").collect() and len(two) == 15


def test_accuracy_for_consoles_and_charts(spark):
    fields, overall, _ = tables(spark)
    lines = [r.line for r in reports.accuracy_summary(fields, overall, "first", "second").orderBy("row_no").collect()]
    assert lines[1].strip("=") == " ACCURACY COMPARISON SUMMARY " and len(lines[1]) == 75 and lines[5].split() == ["Images", "Evaluated", "1", "1", "-"]
    assert lines[7] == "COLOR:" and lines[8].split() == ["-", "Exact", "Match", "(%)", "100.0%", "0.0%", "first"] and lines[11] == "-" * 75
    at = lines.index("OVERALL:")
    assert [x.split()[1] for x in lines[at + 1 : at + 4]] == ["Average", "All", "All"] and lines[at + 4] == "=" * 75
    assert lines[-1].startswith(">>> first has ") and lines[-1].endswith("% higher accuracy than second <<<") and len(lines) == at + 6
    bars = {(r.panel, r.place, r.pipeline): (r.metric, round(r.value, 3), r.shown) for r in reports.accuracy_chart(fields, overall, "first", "second").collect()}
    assert len(bars) == 14 and bars["Accuracy by Field", 1, "first"] == ("productCode", 1.0, "1.00")
    assert bars["Overall Accuracy Metrics", 1, "first"] == ("All Exact (%)", 1.0, "100.0%") and bars["Overall Accuracy Metrics", 2, "second"][2] == "0.0%"


def test_summary_of_one_run(spark):
    details = spark.createDataFrame([(10.0,), (20.0,), (None,)], "total_ms double")
    lines = [r.line for r in reports.run_summary(details).orderBy("row_no").collect()]
    assert lines[3:9] == ["  Total images processed: 2", "  Average time:           15.00 ms", "  Minimum time:           10.00 ms", "  Maximum time:           20.00 ms", "  Std deviation:          5.00 ms", "  Throughput:             66.67 images/sec"]
    assert reports.run_summary(details.where("false")).count() == 0


def test_long_cells_are_not_cut(spark):
    report = spark.createDataFrame([(1, "m" * 40, "v" * 20, "x", "y")], "row_no int, Metric string, a string, b string, Speedup string")
    assert reports.text_table(report).first().line == "m" * 40 + "v" * 20 + "x".rjust(15) + "y".rjust(15)
