"""Images to texts with real files: the JVM's codecs, ONNX models, crops, pictures, warm-ups, live frames."""

import json
import struct
import time
import zlib
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill import cli
from glyphmill.functions import pixels as P
from glyphmill.operators import onnx
from glyphmill.operators import recognition as R
from glyphmill.sources import config, readers, sinks
from glyphmill.streaming import frames, video


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    """One protobuf field: an integer, a float, or bytes."""
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def model(nodes, rank_in, rank_out):
    """An ONNX file of float tensors x to y; nodes: (operator, input, output, {attribute: list of ints, or int})."""

    def attribute(name, value):
        kind, body = (7, b"".join(field(8, v) for v in value)) if isinstance(value, list) else (2, field(3, value))
        return field(5, field(1, name) + body + field(20, kind))

    def tensor(name, rank):
        shape = b"".join(field(1, field(2, f"{name}{i}")) for i in range(rank))
        return field(1, name) + field(2, field(1, field(1, 1) + field(2, shape)))

    graph = b"".join(field(1, field(1, a) + field(2, b) + field(4, op) + b"".join(attribute(k, v) for k, v in attributes.items())) for op, a, b, attributes in nodes)
    graph += field(2, "g") + field(11, tensor("x", rank_in)) + field(12, tensor("y", rank_out))
    return field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13))


def page(bars):
    image = np.zeros((192, 224, 3), np.uint8)
    for top, colour in bars:
        image[top : top + 16, 32:192] = colour
    return image


@pytest.fixture
def folder(tmp_path):
    """Two pages, a broken image, settings and models: what is bright is text, and a letter is the channel that is brightest."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.png").write_bytes(P.png(page([(10, (255, 0, 0)), (80, (0, 255, 0)), (112, (0, 0, 255)), (144, (0, 255, 0))])))
    (tmp_path / "in" / "TWO.PNG").write_bytes(P.png(page([(100, (0, 0, 255))])))
    (tmp_path / "in" / "bad.png").write_bytes(b"no image")
    (tmp_path / "in" / "notes.txt").write_text("no image either")
    (tmp_path / "settings").mkdir()
    (tmp_path / "det.onnx").write_bytes(model([("ReduceMax", "x", "m", {"axes": [1], "keepdims": 1}), ("Sigmoid", "m", "y", {})], 4, 4))
    (tmp_path / "rec.onnx").write_bytes(model([("ReduceMean", "x", "m", {"axes": [2], "keepdims": 0}), ("Transpose", "m", "y", {"perm": [0, 2, 1]})], 4, 3))
    (tmp_path / "letters.txt").write_text("g\nr\n")
    models = {"detectionModelPath": "det.onnx", "recognitionModelPath": "rec.onnx", "characterDictPath": "letters.txt"}
    text = {"models": models, "detection": {"thresh": 0.6, "boxThresh": 0.6}, "runtime": {"numThreads": 1, "performanceHint": "LATENCY"}, "own": {"x": 1}}
    (tmp_path / "settings" / "run.json").write_text(json.dumps(text))
    return tmp_path


def test_images_are_decoded_by_the_jvm(spark, folder):
    rows = {r.path.rsplit("/", 1)[1]: r.content for r in readers.decoded_images(spark, f"{folder}/in").collect()}
    assert set(rows) == {"one.png", "TWO.PNG", "bad.png"} and rows["bad.png"] is None
    assert (R.PackedPixels().decode(bytes(rows["one.png"])) == page([(10, (255, 0, 0)), (80, (0, 255, 0)), (112, (0, 0, 255)), (144, (0, 255, 0))])).all()
    assert {r.path.rsplit("/", 1)[1] for r in readers.images(spark, f"{folder}/in").collect()} == {"one.png", "TWO.PNG", "bad.png"}
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        readers.decoded_images(spark, f"{folder}/none").count()


def test_settings_reach_the_model(folder):
    settings = config.load(f"{folder}/settings/run.json")
    options = onnx.OnnxDetector(settings).session.get_session_options()
    assert (options.intra_op_num_threads, options.inter_op_num_threads) == (1, 1)
    with pytest.raises(ValueError, match="provider"):
        onnx.session(settings.models.detectionModelPath, config.Runtime(device="NPU"))
    with pytest.raises(FileNotFoundError):
        onnx.session(f"{folder}/none.onnx", config.Runtime())
    assert config.raw(f"{folder}/settings/run.json")["own"] == {"x": 1}


def test_recognise_command(spark, folder, capsys):
    argv = ["recognise", "--config", f"{folder}/settings/run.json", "--visualize", "--crops"]
    assert cli.main([*argv, "--images", f"{folder}/in", "--output", f"{folder}/out"]) == 0
    said = capsys.readouterr()
    assert "Total images processed: 2" in said.out and "bad.png: ValueError" in said.err
    read = readers.results(spark, f"{folder}/out/results").collect()
    assert {r.source_image: len(r.text_regions) for r in read} == {"one.png": 4, "TWO.PNG": 1}
    letters = {r.source_image: [x.text for x in r.text_regions] for r in read}
    assert letters["TWO.PNG"] == ["r"] and letters["one.png"][1:] == ["g", "r", "g"] and letters["one.png"][0] == "<None>"
    details = readers.details(spark, f"{folder}/out/details", "run")
    assert details.count() == 2 and details.where("total_ms > 0 and detection_ms > 0").count() == 2
    crops = sorted(p.name for p in (folder / "out" / "crops" / "one").iterdir() if p.suffix == ".png")
    assert crops == ["crop_001.png", "crop_002.png", "crop_003.png", "crop_004.png"]
    pictures = {r.path.rsplit("/", 1)[1]: R.PackedPixels().decode(bytes(r.content)) for r in readers.decoded_images(spark, f"{folder}/out/pictures").collect()}
    assert set(pictures) == {"one_vis.png", "TWO_vis.png"} and (pictures["TWO_vis.png"] == (0, 255, 0)).all(axis=2).sum() > 300
    assert cli.main([*argv, "--image", f"{folder}/in/bad.png", "--output", f"{folder}/single"]) == 1
    assert cli.main([*argv, "--image", f"{folder}/in/TWO.PNG", "--output", f"{folder}/single"]) == 0


class Says:
    def __init__(self, word):
        self.word = word

    def decode(self, content):
        return content

    def recognise(self, image):
        return R.Recognised(1, 1, [{"bbox": [], "text": self.word, "score": 1.0, "source": "detected"}], 0.0, 0.0)


def test_two_backends_of_one_session(spark):
    images = spark.createDataFrame([(f"{i}.png", bytearray(b"x")) for i in range(8)], "path string, content binary").repartition(4)
    for word in ("one", "two", "one"):
        got = {r.text_regions[0].text for r in R.recognise(images, partial(Says, word)).collect()}
        assert got == {word}


def test_regions_that_cannot_be_drawn_are_left_out(spark):
    rows = [("a", [([[1.0, 2.0], [5.0, 2.0], [5.0, 4.0], [1.0, 4.0]], "x", 0.987, "created"), ([[1.0, 2.0]], "y", 0.5, "detected"), ([], "z", 0.5, "detected")])]
    found = spark.createDataFrame(rows, f"path string, text_regions {readers.REGIONS}")
    (r,) = R.overlays(found).collect()
    assert (r.label, r.anchor.x, r.anchor.y, r.colour) == ("x (0.99)", 10.0, 14.0, "red")


def test_pages_with_text():
    one, two = P.text_page(1), P.text_page(2)
    assert one.shape == (480, 640, 3) and 0.01 < (one < 128).mean() < 0.2 and (one != two).any() and sorted(set(one.ravel().tolist())) == [0, 50, 80, 255]
    raw = P.png(one)
    size, kind = struct.unpack(">I4s", raw[8:16])
    assert raw[:4] == b"\x89PNG" and (size, kind) == (13, b"IHDR") and struct.unpack(">I", raw[29:33])[0] == zlib.crc32(raw[12:29])


def test_live_preprocessing():
    """Frames: brought to 1280 at most and to a square tensor without turning channels; crops by 32 pixels of width for a ratio of 1, no limit."""
    frame = np.zeros((10, 20, 3), np.uint8)
    frame[:, :, 0] = 255
    t = P.detection_tensor(frame, 640, 640, flip_channels=False)
    assert t.shape == (1, 3, 640, 640) and np.allclose(t[0, :, 0, 0], (np.array([1, 0, 0]) - P.MEAN) / P.STD, atol=1e-5)
    crops = [np.full((10, 160, 3), 255), np.zeros((10, 20, 3))]
    assert P.recognition_tensor(crops, unit=32, most=None).shape == (2, 3, 48, 512) and P.recognition_tensor(crops).shape == (2, 3, 48, 320)
    prob = np.zeros((64, 64))
    prob[20:30, 10:50] = 0.31
    assert len(P.boxes(prob, 0.3, 0.3)) == 1 and P.boxes(prob, 0.31, 0.3) == []


def y4m(path, count, h=6, w=8):
    with open(path, "wb") as f:
        f.write(f"YUV4MPEG2 W{w} H{h} F30:1 C444\n".encode())
        for i in range(count):
            f.write(b"FRAME\n" + bytes([16 + i] * (h * w)) + bytes([128] * (2 * h * w)))


def test_video_frames(spark, tmp_path):
    y4m(f"{tmp_path}/v.y4m", 25)
    video.register(spark)
    stream = spark.readStream.format("y4m").option("path", f"{tmp_path}/v.y4m").option("skip", 5).option("framesPerTrigger", 8).option("flip", "true").load()
    seen = []

    def show(batch, number):
        seen.append([r.frame_id for r in batch.select("frame_id").orderBy("frame_id").collect()])

    begin = time.time()
    frames.serve(stream, show, f"{tmp_path}/state", lambda: sum(map(len, seen)) >= 20 or time.time() - begin > 60)
    assert [i for part in seen for i in part] == list(range(5, 25)) and max(map(len, seen)) <= 8
    image = video.read_frame(f"{tmp_path}/v.y4m", video.header(f"{tmp_path}/v.y4m"), 24)
    assert image.shape == (6, 8, 3) and set(image.ravel().tolist()) == {28}
    (tmp_path / "not.y4m").write_bytes(b"RIFF")
    with pytest.raises(ValueError):
        video.header(f"{tmp_path}/not.y4m")


def test_details_are_read_by_their_heads(spark, tmp_path):
    (tmp_path / "d.csv").write_text('total_ms,extra,filename,recognition_ms,detection_ms\n30,x,"a ""b"".png",20,10\nbad,y,c.png,1,2\n')
    rows = readers.details(spark, f"{tmp_path}/d.csv", "p").collect()
    assert [(r.filename, r.detection_ms, r.recognition_ms, r.total_ms, r.pipeline) for r in rows] == [('a "b".png', 10.0, 20.0, 30.0, "p"), ("c.png", 2.0, 1.0, None, "p")]
    assert "extra" not in rows[0] and "image_width" not in rows[0]


def test_regions_that_are_no_records_drop_out(spark, tmp_path):
    (tmp_path / "a_result.json").write_text(json.dumps({"source_image": "a.png", "text_regions": [None, "x", 5, [1], {"text": "t", "score": 0.5, "bbox": [[1, 2]]}, {}], "total_regions": 6}))
    (tmp_path / "b_result.json").write_text("[1, 2]")
    (tmp_path / "c_result.json").write_text(json.dumps({"source_image": "c.png"}))
    rows = {r.source_image: r.text_regions for r in readers.results(spark, f"{tmp_path}").collect()}
    assert [(x.text, x.score, x.source) for x in rows["a.png"]] == [("t", 0.5, "detected"), ("", 0.0, "detected")] and rows["c.png"] == []


def test_files_go_to_shared_folders_only(spark, tmp_path):
    results = spark.createDataFrame([("x.png", [([[1.0, 2.0]], "ü", 0.5, "detected")])], f"source_image string, text_regions {readers.REGIONS}")
    for _ in range(2):
        sinks.write_result_files(results, f"{tmp_path}/deep/out")
    assert [p.name for p in (tmp_path / "deep" / "out").iterdir()] == ["x_result.json"]
    assert json.loads((tmp_path / "deep" / "out" / "x_result.json").read_text())["total_regions"] == 1

    class Cluster:
        _jvm, _jsc, sparkContext = spark._jvm, spark._jsc, type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="share"):
        sinks.shared_uri(Cluster, f"{tmp_path}/elsewhere")
