"""Model inference behind one interface: images in, regions and times out, no failure ends a task.

A backend is built once per Python worker by a factory. Everything after the model is column expressions
(functions.boxes, functions.ctc). No weights come with this repository: EchoBackend stands in for a model, and
operators.onnx runs ONNX files of your own.
"""

from __future__ import annotations

import hashlib
import struct
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.sources.config import Settings
from glyphmill.workers import ship

SCHEMA = "path string, image_width int, image_height int, text_regions array<struct<bbox:array<array<double>>,text:string,score:double,source:string>>, detection_ms double, recognition_ms double, total_ms double, error string"


@dataclass
class Recognised:
    width: int
    height: int
    regions: list[dict]
    detection_ms: float | None
    recognition_ms: float | None


class Backend(Protocol):
    def decode(self, content: bytes): ...

    def recognise(self, image) -> Recognised: ...


class EchoBackend:
    """Reads "width height" and one text a line; boxes are stacked lines. For tests and warm-ups."""

    def decode(self, content: bytes):
        head, *lines = content.decode().splitlines()
        width, height = map(int, head.split())
        return width, height, lines

    def recognise(self, image) -> Recognised:
        width, height, lines = image
        step = height / max(1, len(lines))
        box = lambda i: [[0.0, i * step], [float(width), i * step], [float(width), (i + 1) * step], [0.0, (i + 1) * step]]
        return Recognised(width, height, [{"bbox": box(i), "text": t, "score": 1.0, "source": "detected"} for i, t in enumerate(lines)], 0.0, 0.0)


class PackedPixels:
    """Decodes what sources.readers.decoded_images packs: height, width and channels, then the pixels row by row. Grey becomes three channels."""

    def decode(self, content: bytes | None) -> np.ndarray:
        if content is None:
            raise ValueError("not an image")
        h, w, c = struct.unpack(">III", content[:12])
        image = np.frombuffer(content, np.uint8, h * w * c, 12).reshape(h, w, c)
        return image[:, :, :3] if c >= 3 else image[:, :, :1].repeat(3, 2)


_backends: dict[str, Backend] = {}


def _known_as(factory: Callable[[], Backend], warm_up: list[bytes] | None = None) -> str:
    """What a factory with its settings and warm-up is known as in a worker, so that reused workers keep backends apart."""
    return hashlib.sha256(cloudpickle.dumps((factory, warm_up))).hexdigest()


def _backend(name: str, factory: Callable[[], Backend], warm_up: Callable[[Backend], object] | None = None) -> Backend:
    if name not in _backends:
        made = factory()
        if warm_up:
            warm_up(made)
        _backends[name] = made
    return _backends[name]


def recognise(images: DataFrame, factory: Callable[[], Backend], warm_up: list[bytes] | None = None) -> DataFrame:
    """path, content to one row an image. Decoding is not in the times. An image that fails has its error and no regions."""
    name = _known_as(factory, warm_up)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = _backend(name, factory, lambda b: [b.recognise(b.decode(content)) for content in warm_up or ()])
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    image = backend.decode(content)
                    begin = time.perf_counter()
                    found = backend.recognise(image)
                    total = (time.perf_counter() - begin) * 1000
                    rows.append((path, found.width, found.height, found.regions, found.detection_ms, found.recognition_ms, total, None))
                except Exception as error:  # noqa: BLE001  one bad image must not end the task
                    rows.append((path, None, None, [], None, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "image_width", "image_height", "text_regions", "detection_ms", "recognition_ms", "total_ms", "error"]).astype({"image_width": "Int32", "image_height": "Int32"})

    ship(images.sparkSession)
    return images.select("path", "content").mapInPandas(run, SCHEMA)


def to_details(recognised: DataFrame, pipeline: str) -> DataFrame:
    """The rows that did not fail, in the shape of a details table."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return recognised.where("error is null").select(name.alias("filename"), "image_width", "image_height", F.size("text_regions").alias("num_regions"), "detection_ms", "recognition_ms", "total_ms", "text_regions", F.lit(pipeline).alias("pipeline"))


class Detector(Protocol):
    """Pixels of an encoded image, and the map of text probabilities for a normalised tensor."""

    def decode(self, content: bytes): ...

    def probabilities(self, tensor): ...


class Recogniser(Protocol):
    def decode(self, content: bytes): ...

    def class_scores(self, tensor): ...


QUADS = "array<array<struct<x:double,y:double>>>"


def detect(images: DataFrame, factory: Callable[[], Detector], limit: int = 640, threshold: float = 0.15, box_threshold: float = 0.15, warm_ups: int = 0) -> DataFrame:
    """path, content, width, height, quads (rectangles in tensor pixels), ratio_h, ratio_w, detection_ms, error. warm_ups: pages a new detector sees first."""
    from glyphmill.functions import pixels

    name = _known_as(factory)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = _backend(name, factory, lambda d: [d.probabilities(pixels.detection_tensor(pixels.text_page(i + 1), 480, 640)) for i in range(warm_ups)])
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    image = detector.decode(content)
                    begin = time.perf_counter()
                    h, w = image.shape[:2]
                    ratio = min(limit / max(h, w), 1.0)
                    th, tw = (max(int(int(s * ratio) / 32) * 32, 32) for s in (h, w))
                    found = pixels.boxes(detector.probabilities(pixels.detection_tensor(image, th, tw)), threshold, box_threshold)
                    took = (time.perf_counter() - begin) * 1000
                    rows.append((path, content, w, h, [[{"x": float(x), "y": float(y)} for x, y in q] for q in found], th / h, tw / w, took, None))
                except Exception as error:  # noqa: BLE001
                    rows.append((path, content, None, None, [], None, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "content", "width", "height", "quads", "ratio_h", "ratio_w", "detection_ms", "error"]).astype({"width": "Int32", "height": "Int32"})

    ship(images.sparkSession)
    return images.select("path", "content").mapInPandas(run, f"path string, content binary, width int, height int, quads {QUADS}, ratio_h double, ratio_w double, detection_ms double, error string")


def label_regions(detected: DataFrame, unclip_ratio: float = 2.0) -> DataFrame:
    """Adds boxes: grown, brought to image pixels, clipped, in reading order, cut to the label's four and to those worth a crop."""
    from glyphmill.functions import boxes as B

    grown = F.filter(F.transform("quads", lambda q: B.unclip(B.order_points(q), unclip_ratio)), lambda q: q.isNotNull() & B.is_large_enough(q))
    placed = F.transform(grown, lambda q: B.clip(B.rescale(B.order_points(q), F.col("ratio_w"), F.col("ratio_h")), F.col("width"), F.col("height")))
    rows = detected.select("*", F.explode(F.array(B.reading_order(placed))).alias("placed"))
    rows = rows.select("*", F.explode(F.array(B.label_boxes(F.col("placed"), F.col("width"), F.col("height")))).alias("label"))
    kept = F.filter(F.transform("label", lambda b: F.struct(B.order_points(b["box"]).alias("box"), b["source"].alias("source"))), lambda b: B.is_croppable(b["box"]))
    return rows.withColumn("boxes", kept).drop("placed", "label", "quads")


def recognise_regions(regions: DataFrame, factory: Callable[[], Recogniser], alphabet, batch: int = 6, height: int = 48, most_wide: int | None = 320, warm_ups: int = 0) -> DataFrame:
    """Reads each box: batches of crops go through the model in workers, class scores are decoded by column expressions. Returns details with text_regions."""
    from glyphmill.functions import ctc, pixels
    from glyphmill.functions.text import blank_marker

    name = _known_as(factory)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _backend(name, factory, lambda m: [m.class_scores(pixels.recognition_tensor([pixels.text_page(i + 1)[330:390, 150:350]], height, most_wide)) for i in range(warm_ups)])
        for part in batches:
            scores, times, errors = [], [], []
            for content, boxes, error in zip(part["content"], part["boxes"], part["error"], strict=True):
                out: list = [None] * len(boxes)
                begin = time.perf_counter()
                try:
                    if len(boxes) and not error:
                        image = model.decode(content)
                        begin = time.perf_counter()
                        quads = [np.array([[p["x"], p["y"]] for p in b["box"]]) for b in boxes]
                        sides = [(int(max(np.hypot(*(q[0] - q[1])), np.hypot(*(q[2] - q[3])))), int(max(np.hypot(*(q[0] - q[3])), np.hypot(*(q[1] - q[2]))))) for q in quads]
                        for group in pixels.batches([w / h for w, h in sides], batch):
                            got = model.class_scores(pixels.recognition_tensor([pixels.crop(image, quads[i], *sides[i]) for i in group], height, most_wide))
                            for i, s in zip(group, got, strict=True):
                                out[i] = [[float(v) for v in step] for step in s]
                except Exception as failed:  # noqa: BLE001
                    error, out = f"{type(failed).__name__}: {failed}", []
                scores.append(out)
                errors.append(error)
                times.append((time.perf_counter() - begin) * 1000)
            yield part.drop(columns=["content"]).assign(scores=scores, recognition_ms=times, error=errors)

    ship(regions.sparkSession)
    plain = regions.select("path", "content", "width", "height", "boxes", "detection_ms", "error")
    schema = "path string, width int, height int, boxes array<struct<box:array<struct<x:double,y:double>>,source:string>>, detection_ms double, error string, scores array<array<array<double>>>, recognition_ms double"
    read = plain.mapInPandas(run, schema)

    def region(b, i):
        text = ctc.decode(F.col("scores")[i], alphabet)
        return F.struct(F.transform(b["box"], lambda p: F.array(p["x"], p["y"])).alias("bbox"), blank_marker(text["text"]).alias("text"), text["score"].alias("score"), b["source"].alias("source"))

    found = F.when(F.size("scores") == F.size("boxes"), F.transform("boxes", region)).otherwise(F.array().cast("array<struct<bbox:array<array<double>>,text:string,score:double,source:string>>"))
    return read.select("path", F.col("width").alias("image_width"), F.col("height").alias("image_height"), found.alias("text_regions"), "detection_ms", "recognition_ms", (F.col("detection_ms") + F.when(F.size("boxes") > 0, F.col("recognition_ms")).otherwise(0.0)).alias("total_ms"), "error")


def read_images(images: DataFrame, detector: Callable[[], Detector], recogniser: Callable[[], Recogniser], alphabet, settings: Settings | None = None) -> DataFrame:
    """From pixels to texts with the settings' sizes and thresholds: path, image_width, image_height, text_regions, times, error."""
    s = settings or Settings.defaults()
    pages = s.warmup.count if s.warmup.enabled else 0
    found = detect(images, detector, s.detection.limitSideLen, s.detection.thresh, s.detection.boxThresh, pages)
    labelled = label_regions(found, s.detection.unclipRatio)
    return recognise_regions(labelled, recogniser, alphabet, s.recognition.batchSize, s.recognition.imageHeight, s.recognition.maxWidth, pages)


def overlays(recognised: DataFrame) -> DataFrame:
    """(path, points, label, anchor, colour) of each region that can be drawn: those of under four points cannot."""
    from glyphmill.functions import boxes as B

    rows = recognised.select("path", F.explode("text_regions").alias("r")).where("size(r.bbox) >= 4")
    points = F.transform("r.bbox", lambda p: B.point(p[0], p[1]))
    return rows.select("path", F.col("r.bbox").alias("points"), B.label(F.col("r.text"), F.col("r.score")).alias("label"), B.label_anchor(points).alias("anchor"), B.label_colour(F.col("r.source")).alias("colour"))


#: BGR of outlines that were detected or created, and of labels.
COLOURS = {"green": (0, 255, 0), "red": (0, 0, 255), "label": (0, 140, 255)}


def drawn(images: DataFrame, recognised: DataFrame, decode: Callable[[bytes], np.ndarray]) -> DataFrame:
    """(path, png): each image with its regions' outlines and labels."""
    from glyphmill.functions import pixels

    marks = overlays(recognised).groupBy(F.col("path").alias("of")).agg(F.collect_list(F.struct("points", "label", "anchor", "colour")).alias("marks"))
    rows = images.where("content is not null").select("path", "content").join(marks, F.col("path") == F.col("of"), "left").select("path", "content", "marks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content, own in zip(batch["content"], batch["marks"], strict=True):
                image = np.array(decode(content))
                for m in own if own is not None else ():
                    pixels.draw_polygon(image, [tuple(p) for p in m["points"]], COLOURS[m["colour"]])
                    pixels.write_text(image, m["label"], int(m["anchor"]["x"]), int(m["anchor"]["y"]), COLOURS["label"])
                out.append(pixels.png(image))
            yield pd.DataFrame({"path": batch["path"], "png": out})

    ship(images.sparkSession)
    return rows.mapInPandas(run, "path string, png binary")
