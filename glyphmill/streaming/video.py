"""Frames of uncompressed video files (YUV4MPEG2) as a stream.

`spark.readStream.format("y4m")` once `register` has been called. Options: path (a file that executors see), skip (frames to leave out
at the start), flip (mirror left and right), framesPerTrigger (how many frames a trigger takes at most) and framesPerTask.
The offset is a frame number, so a restart goes on where the checkpoint ends; at the end of the file no more frames come.

Rows: frame_id from 0, height, width, content packed for operators.recognition.PackedPixels (BGR).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from glyphmill.workers import ship

SCHEMA = "frame_id long, height int, width int, content binary"
_MARK = b"FRAME\n"


@dataclass
class Header:
    width: int
    height: int
    size: int  # of the head line
    chroma: str

    @property
    def frame(self) -> int:
        """Bytes of one frame's planes."""
        small = (self.width + 1) // 2 * ((self.height + 1) // 2)
        return self.width * self.height + {"420": 2 * small, "mono": 0, "444": 2 * self.width * self.height}[self.chroma]


def header(path: str) -> Header:
    with open(path, "rb") as f:
        line = f.readline(1024)
    words = line.decode("ascii", "replace").split()
    if not words or words[0] != "YUV4MPEG2":
        raise ValueError(f"{path} is no YUV4MPEG2 file")
    given = {w[0]: w[1:] for w in words[1:]}
    kind = next((k for k in ("mono", "444", "420") if given.get("C", "420").startswith(k)), None)
    if kind is None:
        raise ValueError(f"chroma {given['C']} is not read")
    return Header(int(given["W"]), int(given["H"]), len(line), kind)


def frame_count(path: str, head: Header) -> int:
    with open(path, "rb") as f:
        return (f.seek(0, 2) - head.size) // (len(_MARK) + head.frame)


def read_frame(path: str, head: Header, number: int) -> np.ndarray:
    """One frame as BGR."""
    h, w = head.height, head.width
    with open(path, "rb") as f:
        f.seek(head.size + number * (len(_MARK) + head.frame))
        if f.read(len(_MARK)) != _MARK:
            raise ValueError(f"frame {number} of {path} has parameters of its own")
        planes = np.frombuffer(f.read(head.frame), np.uint8).astype(np.float32)
    y, rest = planes[: h * w].reshape(h, w), planes[h * w :]
    if head.chroma == "mono":
        u = v = np.full((h, w), 128, np.float32)
    elif head.chroma == "444":
        u, v = rest.reshape(2, h, w)
    else:
        u, v = (p.repeat(2, 0).repeat(2, 1)[:h, :w] for p in rest.reshape(2, (h + 1) // 2, (w + 1) // 2))
    y, u, v = 1.164 * (y - 16), u - 128, v - 128
    return np.clip(np.rint(np.dstack([y + 2.017 * u, y - 0.392 * u - 0.813 * v, y + 1.596 * v])), 0, 255).astype(np.uint8)


class Stretch(InputPartition):
    def __init__(self, first: int, stop: int) -> None:
        self.first, self.stop = first, stop


class Y4mReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.skip, self.pace = int(options.get("skip", 0)), int(options.get("framespertrigger", 30))
        self.task, self.flip = int(options.get("framespertask", 10)), str(options.get("flip", "false")).lower() == "true"
        self.head = header(self.path)
        self.at: int | None = None

    def initialOffset(self) -> dict:
        return {"frame": self.skip}

    def latestOffset(self) -> dict:
        end = frame_count(self.path, self.head)
        self.at = min(end, (self.skip if self.at is None else self.at) + self.pace)
        return {"frame": max(self.skip, self.at)}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        self.at = end["frame"]  # after a restart, too, the next trigger goes on from here
        return [Stretch(i, min(i + self.task, end["frame"])) for i in range(start["frame"], end["frame"], self.task)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        for number in range(partition.first, partition.stop):
            image = read_frame(self.path, self.head, number)
            image = np.ascontiguousarray(image[:, ::-1]) if self.flip else image
            h, w, c = image.shape
            yield number, h, w, struct.pack(">III", h, w, c) + image.tobytes()


class Y4m(DataSource):
    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Y4mReader:
        return Y4mReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Y4m)
