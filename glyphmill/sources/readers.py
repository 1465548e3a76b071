"""Scans. Every schema is explicit; nothing is inferred and no file is listed on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators.latency import tagged

#: The columns of a details table; a run that does not time its parts lacks two of them.
_DETAILS = {"filename": "string", "image_width": "int", "image_height": "int", "num_regions": "int", "detection_ms": "string", "recognition_ms": "string", "total_ms": "string", "results": "string"}
_REGION = "struct<bbox:array<array<double>>,text:string,score:double,source:string>"
REGIONS = f"array<{_REGION}>"
RESULT = "source_image string, text_regions array<string>, total_regions int, _corrupt_record string"
EXPECTED = "color string, productCode string, size string, positionQuantity string, _corrupt_record string"
#: The image suffixes that are read.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".webp")
#: The same as a glob, in either case.
_IMAGE_NAMES = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in s[1:]) for s in IMAGE_SUFFIXES) + "}"


def details(spark: SparkSession, path: str, pipeline: str, multi_line: bool = True) -> DataFrame:
    """A run's details CSV with its pipeline's name, columns found by their heads in whatever order; values that are no numbers are null.

    Known columns that the file lacks and columns that are not known are left out. Files of one run must have the same head; else
    reading them fails. multi_line: texts may hold line ends; without it many tasks read a large file.
    """
    rows = spark.read.csv(path, header=True, escape='"', multiLine=multi_line, enforceSchema=False)
    known = [F.col(f"`{c}`").try_cast(kind).alias(c) for c, kind in _DETAILS.items() if c in rows.columns]
    return tagged(rows.select(*known), pipeline)


def _documents(spark: SparkSession, path: str, schema: str, pattern: str) -> DataFrame:
    rows = spark.read.schema(schema).json(path, multiLine=True, encoding="UTF-8", pathGlobFilter=pattern)
    named = rows.select("*", F.col("_metadata.file_name").alias("file_name"))
    return named.where("_corrupt_record is null").drop("_corrupt_record")


def expected_values(spark: SparkSession, path: str) -> DataFrame:
    """Expected fields by file `result_<base>.json`; invalid files drop out, missing values are null."""
    return _documents(spark, path, EXPECTED, "result_*.json")


def results(spark: SparkSession, path: str) -> DataFrame:
    """Recognition results by file `<stem>_result.json`; invalid files and regions that are no records drop out, a missing source is `detected`."""
    rows = _documents(spark, path, RESULT, "*_result.json")
    records = F.transform(F.filter("text_regions", lambda r: r.startswith("{")), lambda r: F.from_json(r, _REGION))
    regions = F.transform(records, lambda r: F.struct(r["bbox"].alias("bbox"), F.coalesce(r["text"], F.lit("")).alias("text"), F.coalesce(r["score"], F.lit(0.0)).alias("score"), F.coalesce(r["source"], F.lit("detected")).alias("source")))
    return rows.withColumn("text_regions", F.coalesce(regions, F.array().cast(REGIONS)))


def is_image(path: Column) -> Column:
    return T.file_suffix(path).isin(*IMAGE_SUFFIXES)


def images(spark: SparkSession, folder: str, with_content: bool = True) -> DataFrame:
    """path, length, content of the images of a folder, not of its subfolders. Other files are not opened; without content none is."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", _IMAGE_NAMES).load(folder).where(is_image(F.col("path")))
    return rows.select("path", "length", *(["content"] if with_content else []))


def decoded_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of the images of a folder, decoded by the JVM's codecs and packed for operators.recognition.PackedPixels.

    JPEG, PNG, BMP and GIF, and TIFF where the JVM has it. An image that cannot be decoded has no content; a missing folder is an error.
    """
    rows = spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", _IMAGE_NAMES).load(folder)
    sides = [F.lpad(F.hex(F.col(f"image.{c}")), 8, "0") for c in ("height", "width", "nChannels")]
    packed = F.concat(F.unhex(F.concat(*sides)), F.col("image.data"))
    return rows.select(F.col("image.origin").alias("path"), F.when(F.col("image.height") > 0, packed).alias("content"))


def alphabet(spark: SparkSession, path: str) -> Column:
    """The class alphabet as an array literal: blank, then the file's stripped lines in order."""
    rows = spark.read.text(path, wholetext=True)
    body = F.regexp_replace("value", r"\r?\n$", "")
    lines = rows.select(F.transform(F.split(body, r"\r?\n"), T.strip).alias("lines")).first()
    return F.array(F.lit("blank"), *(F.lit(c) for c in lines.lines))


def regions_of(texts: Column, scores: Column, polygons: Column, fallback: Column) -> Column:
    """Parallel arrays of a backend as regions: by place, with short scores 0 and short polygons empty; polygons fall back to the detected ones."""
    shapes = F.coalesce(F.when(F.size(polygons) > 0, polygons), fallback, F.array().cast("array<array<array<double>>>"))
    none = F.array().cast("array<array<double>>")

    def one(text: Column, i: Column) -> Column:
        score = F.coalesce(F.try_element_at(scores, i + 1), F.lit(0.0))
        return F.struct(F.coalesce(F.try_element_at(shapes, i + 1), none).alias("bbox"), T.blank_marker(T.strip(F.coalesce(text, F.lit("")))).alias("text"), score.alias("score"))

    return F.transform(F.coalesce(texts, F.array().cast("array<string>")), one)


def gradient_images(spark: SparkSession, count: int = 2, width: int = 640, height: int = 480) -> DataFrame:
    """Images for a warm-up: (image, y, grey), a row per line, from black at the top."""
    rows = spark.range(count).select(F.col("id").cast("int").alias("image"), F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    return rows.select("image", "y", F.lit(width).alias("width"), F.floor(F.lit(255) * F.col("y") / height).cast("int").alias("grey"))
