"""Command line.

`python -m glyphmill recognise` reads images with a backend and writes details, result documents and, if asked, crops and pictures.
`python -m glyphmill compare` reads two runs, and their expected values if there are any, and writes the reports.
"""

from __future__ import annotations

import argparse
import importlib
import sys
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import accuracy, latency, onnx, recognition, reports
from glyphmill.sources import config, readers, sinks


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="glyphmill")
    commands = parser.add_subparsers(dest="command", required=True)
    compare = commands.add_parser("compare", help="compare two runs over the same images")
    for side in ("first", "second"):
        compare.add_argument(f"--{side}-details", required=True, help="details CSV")
        compare.add_argument(f"--{side}-results", help="folder of result documents")
        compare.add_argument(f"--{side}-name", default=side)
    compare.add_argument("--samples", help="folder of expected values")
    compare.add_argument("--output", required=True)
    compare.add_argument("--skip-accuracy", action="store_true")
    read = commands.add_parser("recognise", help="read the texts of images")
    which = read.add_mutually_exclusive_group(required=True)
    which.add_argument("--images", help="folder of images; one that fails is left out")
    which.add_argument("--image", help="one image; if it fails the command does")
    read.add_argument("--config", help="settings; without them the defaults hold")
    read.add_argument("--backend", help="module:factory of a backend; without one the settings' ONNX models run")
    read.add_argument("--name", default="run")
    read.add_argument("--output", required=True)
    read.add_argument("--visualize", action="store_true", help="write pictures with outlines and labels")
    read.add_argument("--crops", action="store_true", help="write the crops that were read")
    return parser.parse_args(argv)


def recognise(spark: SparkSession, options: argparse.Namespace) -> int:
    """Writes recognised (Parquet, once), details, results and what else is asked for. 1 if a single image failed, else 0."""
    settings = config.load(options.config) if options.config else config.Settings.defaults()
    source, target = options.image or options.images, options.output
    decode = recognition.PackedPixels().decode
    if options.backend:
        module, _, factory = options.backend.partition(":")
        images = readers.images(spark, source)
        found = recognition.recognise(images, getattr(importlib.import_module(module), factory))
    else:
        images = readers.decoded_images(spark, source)
        models = partial(onnx.OnnxDetector, settings), partial(onnx.OnnxRecogniser, settings)
        found = recognition.read_images(images, *models, readers.alphabet(spark, settings.models.characterDictPath), settings)
    found.write.mode("overwrite").parquet(f"{target}/recognised")
    found = spark.read.parquet(f"{target}/recognised")
    failed = found.where("error is not null").select("path", "error")
    for row in failed.limit(20).collect():
        print(f"{row.path}: {row.error}", file=sys.stderr)
    details = recognition.to_details(found, options.name)
    sinks.write_details(details, f"{target}/details")
    named = found.where("error is null").select(F.regexp_extract("path", r"([^/]*)$", 1).alias("source_image"), "text_regions")
    sinks.write_result_files(named, f"{target}/results")
    if not options.backend and options.visualize:
        sinks.write_files(recognition.drawn(images, found, decode).select(F.concat(T.file_stem(F.col("path")), F.lit("_vis.png")).alias("name"), F.col("png").alias("body")), f"{target}/pictures")
    if not options.backend and options.crops:
        # What was read is cut out again: regions come with the texts.
        boxes = F.transform("text_regions", lambda r: F.struct(F.transform(r["bbox"], lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("box")))
        again = images.join(found.select(F.col("path").alias("of"), boxes.alias("boxes"), "error"), F.col("path") == F.col("of")).select("path", "content", "boxes", "error")
        sinks.write_crops(again, decode, f"{target}/crops")
    for row in reports.run_summary(details).orderBy("row_no").collect():  # ten lines
        print(row.line)
    return int(bool(options.image) and not failed.isEmpty())


def evaluated(spark: SparkSession, samples: str, results: dict[str, str]) -> DataFrame:
    """The accuracy table of several runs, each pipeline's rows under its name."""
    expected = readers.expected_values(spark, samples)
    tables = [accuracy.evaluate(accuracy.paired_images(expected, readers.results(spark, folder)), name) for name, folder in results.items()]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def compare(spark: SparkSession, options: argparse.Namespace) -> dict[str, DataFrame]:
    """Writes speed_summary, chart data and pairs, and, with samples, merged details and accuracy_summary; returns the reports."""
    a, b = options.first_name, options.second_name
    first, second = readers.details(spark, options.first_details, a), readers.details(spark, options.second_details, b)
    stats = latency.statistics(first.unionByName(second, allowMissingColumns=True))
    out = {"speed_summary": reports.speed_report(stats, a, b).orderBy("row_no"), "bar_chart": reports.bar_chart(stats, a, b), "paired": latency.sampled(latency.paired(first, second)).orderBy("filename")}
    if options.samples and not options.skip_accuracy:
        # Written once: four reports read it.
        evaluated(spark, options.samples, {a: options.first_results, b: options.second_results}).write.mode("overwrite").parquet(f"{options.output}/accuracy")
        table = spark.read.parquet(f"{options.output}/accuracy")
        for name, details in ((a, first), (b, second)):
            own = table.where(F.col("pipeline") == name)
            out[f"details_{name}"] = latency.with_accuracy(details, own)
        fields, overall = accuracy.field_statistics(table), accuracy.overall_statistics(table)
        values = reports.accuracy_values(fields, overall, a, b)
        out["accuracy_chart"] = reports.accuracy_chart(fields, overall, a, b).orderBy("panel", "place", "pipeline")
        out["accuracy_console"] = reports.accuracy_summary(fields, overall, a, b).orderBy("row_no")
        out["accuracy_summary"] = reports.accuracy_report(values, a, b).orderBy("row_no")
    for name, df in out.items():
        sinks.write_csv(df, f"{options.output}/{name}", one_file=not name.startswith("details_"))
    return out


def main(argv: list[str] | None = None) -> int:
    options = arguments(argv)
    spark = SparkSession.builder.appName("glyphmill").getOrCreate()
    if options.command == "recognise":
        return recognise(spark, options)
    out = compare(spark, options)
    for table in (reports.text_table(out["speed_summary"]), out.get("accuracy_console")):
        for row in table.orderBy("row_no").collect() if table is not None else ():  # a line a metric
            print(row.line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
