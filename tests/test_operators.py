"""Statistics, assignment, reports, sources, sinks, inference and streams."""

import json

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import accuracy as E
from glyphmill.operators import latency as L
from glyphmill.operators import recognition as R
from glyphmill.operators import reports
from glyphmill.sources import config, readers, sinks
from glyphmill.streaming import frames


def image(spark, texts, **expected):
    fields = {f: expected.get(f) for f in E.FIELDS}
    return spark.createDataFrame([("i", *fields.values(), texts)], "base string, " + ", ".join(f"{f} string" for f in E.FIELDS) + ", texts array<string>")


def judged(spark, texts, **expected):
    r = E.evaluate(image(spark, texts, **expected), "p").first()
    return {f: (r[f"ocr_{f}"], r[f"match_type_{f}"]) for f in E.FIELDS}, r


FULL = {"color": "SAND", "productCode": "18000", "size": "XL", "positionQuantity": "1/2"}


def test_all_exact_in_any_order(spark):
    got, r = judged(spark, ["1/2", "xl", "18 000", "sand"], **FULL)
    assert [k for _, k in got.values()] == ["exact"] * 4 and r.all_exact and r.avg_accuracy_score == 1 and r.filename == "i.png"


def test_rest_is_assigned_by_best_pair(spark):
    got, r = judged(spark, ["1/2", "18000", "SBQD", "Z"], **FULL)
    assert got["color"] == ("SBQD", "rejected") and got["size"] == ("Z", "rejected") and r.score_size == 0 and not r.all_acceptable


def test_missing_texts_and_values(spark):
    got, r = judged(spark, ["SAND"], color="SAND", productCode="", size="XL")
    assert got["color"] == ("SAND", "exact") and [got[f] for f in ("productCode", "size", "positionQuantity")] == [("", "missing")] * 3
    assert judged(spark, [], **FULL)[0]["color"] == ("", "missing")
    assert judged(spark, ["<None>"], **FULL)[0]["color"][0] in ("<None>", "")


def test_ties_go_to_the_first(spark):
    got, _ = judged(spark, ["sand", "SAND"], color="SAND", size="SAND")
    assert got["color"][0] == "sand" and got["size"][0] == "SAND"


def details(spark, values, pipeline="a"):
    return spark.createDataFrame([(str(i), pipeline, v) for i, v in enumerate(values)], "filename string, pipeline string, total_ms double")


def test_statistics_edges(spark):
    r = L.statistics(details(spark, [None, 10.0])).first()
    assert (r.num_images, r.avg_ms, r.std_ms, r.throughput_fps, r.total_time_s) == (2, 10.0, None, 100.0, 0.01)
    r = L.statistics(details(spark, [None, None])).first()
    assert (r.avg_ms, r.median_ms, r.throughput_fps, r.total_time_s) == (None, None, 0.0, 0.0)
    assert L.statistics(details(spark, [5.0]), population=True).first().std_ms == 0
    assert L.statistics(details(spark, [1.0, 2.0, 4.0, 10.0])).first().p95_ms == pytest.approx(9.1)


def test_winner_and_speedup(spark):
    stats = L.statistics(details(spark, [10.0, 10.0]).unionByName(details(spark, [25.0], "b")))
    r = L.speedup(stats, "a", "b").first()
    assert r.speedup == 2.5 and r.faster == "a"
    assert L.speedup(stats, "none", "b").first().speedup == 0
    assert spark.range(1).select(L.winner(F.lit(float("nan")), F.lit(None), "a", "b").alias("w")).first().w == "Tie"


def test_joins(spark):
    a = spark.createDataFrame([("x", 1.0), ("x", 2.0), (None, 3.0)], "filename string, total_ms double")
    b = spark.createDataFrame([("x", 5.0), (None, 6.0)], "filename string, total_ms double")
    assert L.paired(a, b).count() == 3
    assert L.with_accuracy(a, None) is a
    assert L.unmatched(a, b.where("filename = 'y'"), "filename").count() == 3
    pairs = spark.range(120).select(F.format_string("%03d", "id").alias("filename"), F.lit(1.0).alias("first_ms"), F.lit(1.0).alias("second_ms"))
    assert [r.filename for r in L.sampled(pairs).orderBy("filename").collect()] == [f"{i:03d}" for i in range(0, 120, 2)]
    assert L.sampled(pairs.limit(99)).count() == 99


def test_reports(spark):
    stats = L.statistics(details(spark, [10.0, 20.0]).unionByName(details(spark, [30.0], "b")))
    lines = {r.metric: r for r in reports.speed_report(stats, "a", "b").collect()}
    assert lines["Average Time (ms)"].Speedup == "2.00x" and lines["Std Dev (ms)"].b == "-" and lines["Number of Images"].a == "2"
    rows = E.evaluate(image(spark, ["SAND"], color="SAND"), "a")
    values = reports.accuracy_values(E.field_statistics(rows), E.overall_statistics(rows), "a", "b")
    assert values.where("field = 'color' and metric = 'exact_pct'").first().winner == "a"
    text = reports.accuracy_report(values, "a", "b").orderBy("row_no").collect()
    assert text[0].Metric == "=== COLOR ===" and len(text) == 20
    assert reports.text_table(reports.speed_report(stats, "a", "b")).count() == 10


def test_details_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a.png", 4, 3, 1, 1.0, 2.0, 3.005, [([[0.0, 1.0]], 'say "x", y', 0.95, None)])], "filename string, image_width int, image_height int, num_regions int, detection_ms double, recognition_ms double, total_ms double, text_regions " + readers.REGIONS)
    sinks.write_details(rows, f"{tmp_path}/d")
    r = readers.details(spark, f"{tmp_path}/d", "first").first()
    assert r.results == 'say "x", y (0.9500)' and r.pipeline == "first" and r.detection_ms == 1.0
    (tmp_path / "bad.csv").write_text("filename,image_width,image_height,num_regions,total_ms,results\nx,1,1,0,oops,\ny,1,1,0,NaN,\n")
    assert [r.total_ms for r in readers.details(spark, f"{tmp_path}/bad.csv", "p").collect()] == [None, None]


def test_documents(spark, tmp_path):
    (tmp_path / "result_a.json").write_text(json.dumps({"color": "SAND", "size": 5, "extra": 1}, indent=2))
    (tmp_path / "result_b.json").write_text("{broken")
    (tmp_path / "a_result.json").write_text(json.dumps({"source_image": "a.png", "text_regions": [{"bbox": [[0, 1]], "text": "sand", "score": 0.5}], "total_regions": 1}, indent=2))
    expected, found = readers.expected_values(spark, str(tmp_path)), readers.results(spark, str(tmp_path))
    assert [r.color for r in expected.collect()] == ["SAND"]
    assert found.where("text_regions[0].source = 'detected'").count() == 1
    assert E.evaluate(E.paired_images(expected, found), "p").first().match_type_color == "exact"
    sinks.write_result_files(found.select("source_image", "text_regions"), str(tmp_path))
    assert json.loads((tmp_path / "a_result.json").read_text())["total_regions"] == 1
    sinks.write_results(found, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 1


def test_images_and_alphabet(spark, tmp_path):
    for name in ("a.PNG", "b.tif", "c.webp", "d.txt"):
        (tmp_path / name).write_bytes(b"8 4\none\ntwo" if name != "c.webp" else b"\xff")
    listed = readers.images(spark, str(tmp_path), with_content=False)
    assert listed.count() == 2 and "content" not in listed.columns
    out = R.recognise(readers.images(spark, str(tmp_path)), R.EchoBackend, [b"1 1\nx"]).orderBy("path").collect()
    assert [len(r.text_regions) for r in out] == [2, 0] and out[0].error is None and "UnicodeDecodeError" in out[1].error
    assert R.to_details(R.recognise(readers.images(spark, str(tmp_path)), R.EchoBackend), "echo").count() == 1
    (tmp_path / "dict.txt").write_text("a\n b\nç\n", encoding="utf-8")
    assert spark.range(1).select(readers.alphabet(spark, str(tmp_path / "dict.txt")).alias("x")).first().x == ["blank", "a", "b", "ç"]


def test_config(tmp_path):
    (tmp_path / "config").mkdir()
    path = tmp_path / "config" / "x.json"
    path.write_text(json.dumps({"_description": "no", "models": {"detectionModelPath": "m/d.onnx", "characterDictPath": "/abs.txt"}, "detection": {"limitSideLen": 320, "_comment_x": 1}, "engine": {"numThreads": 7}, "debug": {"enabled": True}}))
    s = config.load(str(path), "engine")
    assert s.detection.limitSideLen == 320 and s.detection.unclipRatio == 2.0 and s.runtime.numThreads == 7 and s.debug.enabled
    assert s.models.detectionModelPath == str(tmp_path / "m/d.onnx") and s.models.characterDictPath == "/abs.txt"
    path.write_text(json.dumps({"detection": {"textDetThresh": 0.4}, "recognition": {"textRecScoreThresh": 0.1}, "runtime": {"cpuThreads": 3}, "warmup": {"count": 5}}))
    s = config.load(str(path))
    assert (s.detection.thresh, s.recognition.scoreThresh, s.runtime.numThreads, s.warmup.count) == (0.4, 0.1, 3, 5)
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "none.json"))


def test_stream_equals_its_batch_twin(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").alias("frame_id"), F.timestamp_seconds(F.col("id")).alias("ts"), F.concat(F.lit("c"), F.col("id") % 2).alias("camera"), ((F.col("id") * 7 % 11) / 100).alias("seconds"), F.lit("t").alias("text"), (F.col("id") % 10 / 10).alias("score"))
    for lo in range(0, 60, 20):
        rows.where(F.col("frame_id").between(lo, lo + 19)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = frames.skip_first(frames.frames(spark, f"{tmp_path}/in"), 5)
    frames.to_memory(frames.rolling_latency(stream, 8), "rolled", f"{tmp_path}/check")
    twin = L.rolling_mean(rows.where("frame_id >= 5"), order=("ts", "frame_id"), size=8, by="camera")
    got = {r.frame_id: r.mean_ms for r in spark.table("rolled").collect()}
    assert got == pytest.approx({r.frame_id: r.mean_ms for r in twin.collect()}) and len(got) == 55
    assert frames.drop_low(rows).count() == 30


@pytest.mark.parametrize("per_range", [7, 100, 10_000])
def test_global_order_in_ranges(spark, per_range):
    from pyspark.sql import Window

    from glyphmill.operators.ordering import numbered, sliding

    rows = spark.range(500).select((F.xxhash64("id") % 97).alias("a"), F.when(F.col("id") % 9 != 0, F.col("id")).alias("b"), F.col("id").alias("c")).repartition(5)
    got, count = numbered(rows, ("a", "b", "c"), rows_per_range=per_range)
    expected = sorted(rows.collect(), key=lambda r: (r.a, r.b is not None, r.b or 0, r.c))
    assert count == 500 and [r.c for r in got.orderBy("position").collect()] == [r.c for r in expected]
    means = sliding(rows, ("a", "b", "c"), 5, lambda w: F.sum("c").over(w), "s", per_range)
    twin = rows.withColumn("s", F.sum("c").over(Window.partitionBy().orderBy("a", "b", "c").rowsBetween(-4, 0)))
    assert sorted((r.c, r.s) for r in means.collect()) == sorted((r.c, r.s) for r in twin.collect())
    assert numbered(rows.where("false"), ("a",))[0].count() == 0


@pytest.mark.parametrize("per_range", [5, 10_000])
def test_percentiles_in_ranges(spark, per_range):
    from glyphmill.operators.ordering import exact_percentiles

    rows = spark.range(400).select(F.when(F.col("id") % 10 != 3, F.col("id") % 3).alias("g"), F.when(F.col("id") % 11 != 0, F.pmod(F.xxhash64("id"), F.lit(50)) / 4.0).alias("v")).unionByName(spark.createDataFrame([(9, 5.0), (8, None)], "g long, v double"))
    got = {(r.g, r.percent): r.v for r in exact_percentiles(rows, "g", "v", (0.0, 0.5, 0.95, 1.0), per_range).collect()}
    twin = rows.where("v is not null").groupBy("g").agg(F.percentile("v", F.array(*(F.lit(p) for p in (0.0, 0.5, 0.95, 1.0)))).alias("p")).collect()
    assert got == pytest.approx({(r.g, p): x for r in twin for p, x in zip((0.0, 0.5, 0.95, 1.0), r.p, strict=True)})
