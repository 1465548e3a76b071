"""Sinks: details CSV, result documents, reports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import pixels
from glyphmill.functions import text as T
from glyphmill.workers import ship


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header and doubled quotes. one_file: for reports, whose size is fixed."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True, escape='"')


def write_details(details: DataFrame, path: str) -> None:
    """Details with times to two decimals and regions as one string."""
    times = {c: F.format_string("%.2f", F.col(c)) for c in ("detection_ms", "recognition_ms", "total_ms") if c in details.columns}
    rows = details.withColumns(times | ({"results": T.region_list(F.col("text_regions"))} if "text_regions" in details.columns else {}))
    write_csv(rows.drop("text_regions", "pipeline"), path)


def write_results(results: DataFrame, path: str) -> None:
    """One JSON document a row."""
    results.select("source_image", "text_regions", F.size("text_regions").alias("total_regions")).write.mode("overwrite").json(path)


def shared_uri(spark: SparkSession, folder: str) -> str:
    """The folder as a URI of the file system that Spark finds it in, created. One machine's folder is an error off a local master."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = files.makeQualified(place).toString()
    if uri.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"executors do not share {folder}; name a folder in a store that they do")
    files.mkdirs(place)
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def put(uri: str, name: str, body: bytes) -> None:
    """Write one file into a folder of any file system that Arrow knows. It appears whole, and a retry makes the same file."""
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(uri)
    path = f"{base}/{name}"
    part = f"{path}.{uuid.uuid4().hex}"
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(part) as f:
        f.write(body)
    files.move(part, path)


def _write_each(rows: DataFrame, folder: str, files: Callable[[Row], Iterator[tuple[str, bytes]]]) -> None:
    """The files of each row, written by the executors into a folder that they share."""
    uri = shared_uri(rows.sparkSession, folder)

    def write(part: Iterator[Row]) -> None:
        for row in part:
            for name, body in files(row):
                put(uri, name, body)

    ship(rows.sparkSession)
    rows.foreachPartition(write)


def write_files(files: DataFrame, folder: str) -> None:
    """One file a row of (name, body)."""
    _write_each(files.select("name", "body"), folder, lambda row: [(row.name, bytes(row.body))])


def write_result_files(results: DataFrame, folder: str) -> None:
    """One file `<stem>_result.json` a row."""
    rows = results.select(T.file_stem(F.col("source_image")).alias("stem"), F.to_json(F.struct("source_image", "text_regions", F.size("text_regions").alias("total_regions"))).alias("body"))
    _write_each(rows, folder, lambda row: [(f"{row.stem}_result.json", json.dumps(json.loads(row.body), ensure_ascii=False, indent=2).encode())])


def write_crops(regions: DataFrame, decode: Callable[[bytes], object], folder: str) -> None:
    """Each box of recognition.label_regions as `<stem>/crop_001.png` and so on; boxes without pixels are skipped."""
    rows = regions.where("error is null").select(T.file_stem(F.col("path")).alias("stem"), "content", "boxes")

    def crops(row: Row) -> Iterator[tuple[str, bytes]]:
        image = decode(bytes(row.content))
        for i, box in enumerate(row.boxes, 1):
            cut = pixels.upright(image, [(p.x, p.y) for p in box.box])
            if cut.size:
                yield f"{row.stem}/crop_{i:03d}.png", pixels.png(cut)

    _write_each(rows, folder, crops)
