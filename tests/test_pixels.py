"""Pixel work, and the whole path from images to texts with a toy model."""

import numpy as np
from pyspark.sql import functions as F

from glyphmill.functions import pixels as P
from glyphmill.operators import recognition as R


def test_resize_and_tensors():
    image = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    assert np.allclose(P.resize(image, 2, 2), image) and P.resize(image, 4, 6).shape == (4, 6, 3)
    assert P.detection_tensor(image, 32, 64).shape == (1, 3, 32, 64)
    t = P.recognition_tensor([np.full((10, 20, 3), 255), np.full((10, 30, 3), 0)])
    assert t.shape == (2, 3, 48, 144) and t[0, :, :, :96].min() == 1 and t[0, :, :, 97:].max() == 0 and t[1].max() == -1
    assert P.batches([3, 1, 2], 2) == [[1, 2], [0]]


def test_outlines_have_holes():
    mask = np.zeros((12, 14), bool)
    mask[2:9, 2:11] = True
    mask[4:7, 4:8] = False
    mask[10, 12] = True
    found = P.outlines(mask)
    assert len(found) == 3 and sorted(len(o.points) for o in found) == [1, 14, 28]
    assert sorted((int(o.fill.sum()), o.corners) for o in found) == [(1, 1), (26, 4), (63, 4)]


def test_nested_components_have_outlines():
    mask = np.zeros((20, 20), bool)
    mask[1:19, 1:19] = True
    mask[3:17, 3:17] = False
    mask[6:12, 6:13] = True
    assert sorted(int(o.fill.sum()) for o in P.outlines(mask)) == [42, 14 * 14 + 56, 18 * 18]


def drawn(*rows):
    return np.array([[c == "#" for c in r] for r in rows])


def test_corners_of_borders():
    """Points that a border keeps when straight runs are shortened to their ends."""
    shapes = {
        1: drawn("#"),
        2: drawn("####"),
        3: drawn("#.", "##"),
        4: drawn("##", "##"),
        8: drawn(".##.", "####", "####", ".##."),
    }
    for corners, shape in shapes.items():
        assert [o.corners for o in P.outlines(shape)] == [corners]
    assert [o.corners for o in P.outlines(drawn("#..", ".#.", "..#"))] == [2]
    assert [o.corners for o in P.outlines(drawn("#...", "##..", "###.", "####"))] == [3]
    assert [o.corners for o in P.outlines(drawn(".#.", "###", ".#."))] == [4]


def test_least_rectangle_of_a_turned_box():
    a = np.deg2rad(30)
    turn = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
    grid = np.array([(x, y) for x in range(21) for y in range(7)]) @ turn.T
    sides = sorted(np.hypot(*(P.least_rectangle(grid) - np.roll(P.least_rectangle(grid), -1, axis=0)).T))
    assert np.allclose(sides, [6, 6, 20, 20])


def test_boxes_and_scores():
    p = np.zeros((40, 60), np.float32)
    p[5:15, 10:40] = 0.9
    p[20:22, 1:3] = 0.9
    p[25:35, 10:40] = 0.4
    p[37, 10:50] = 0.9  # a line has two corners
    found = P.boxes(p)
    assert sorted(tuple(map(tuple, sorted(map(tuple, q)))) for q in found) == [((1, 20), (1, 21), (2, 20), (2, 21)), ((10, 5), (10, 14), (39, 5), (39, 14))]


def test_scores_are_of_the_outline():
    """A frame's rectangle is mostly empty, and so is what its outline encloses; a slanted bar's rectangle is not its outline."""
    p = np.zeros((60, 60))
    for i in range(40):
        p[10 + i, 5 + i : 9 + i] = 0.8
    (bar,) = P.outlines(p > 0.3)
    assert abs(P.outline_score(p, bar) - 0.8) < 1e-6
    frame = np.zeros((30, 30))
    frame[5:25, 5:25] = 0.9
    frame[8:22, 8:22] = 0.0
    outer, hole = P.outlines(frame > 0.3)
    assert abs(P.outline_score(frame, outer) - 0.9 * (400 - 196) / 400) < 1e-6
    assert abs(P.outline_score(frame, hole) - 0.9 * 56 / (196 + 56)) < 1e-6 and len(P.boxes(frame, 0.3, 0.3)) == 1


def grown(spark, quad, ratio):
    from glyphmill.functions import boxes as B

    q = F.array(*(B.point(F.lit(float(x)), F.lit(float(y))) for x, y in quad))
    u = B.unclip(B.order_points(q), ratio)
    r = spark.range(1).select(B.order_points(u).alias("u"), B.is_large_enough(u).alias("large")).first()
    return (None if r.u is None else [(c.x, c.y) for c in r.u]), r.large


def test_growing_by_hand(spark):
    # A bar of two pixel rows: area 59, perimeter 120, so 0.98 on each side; offsets are whole, so it comes to three rows.
    assert grown(spark, [(10, 5), (69, 5), (69, 6), (10, 6)], 2.0) == ([(9, 4), (70, 4), (70, 7), (9, 7)], True)
    # Corners lose their fractions before growing, area and perimeter do not: 20.8 * 10.4 * 1.5 / 62.4 = 5.2.
    quad, large = grown(spark, [(10.6, 5.3), (31.4, 5.3), (31.4, 15.7), (10.6, 15.7)], 1.5)
    assert quad == [(5, 0), (36, 0), (36, 20), (5, 20)] and large
    # Under an area of 1 nothing is grown.
    assert grown(spark, [(1, 1), (1.9, 1), (1.9, 2), (1, 2)], 1.5)[0] is None
    # Beyond the image's edge: -0.5 goes to -1.
    assert grown(spark, [(0, 0), (2, 0), (2, 2), (0, 2)], 1.0)[0] == [(-1, -1), (3, -1), (3, 3), (-1, 3)]
    # A turned square of side 20 (corners 28.28 apart): 5 more on each side and still turned.
    quad, _ = grown(spark, [(20, 0), (40, 20), (20, 40), (0, 20)], 1.0)
    sides = np.hypot(*(np.array(quad) - np.roll(np.array(quad), -1, axis=0)).T)
    assert np.allclose(sides, 800**0.5 + 2 * 800 / (4 * 800**0.5)) and np.allclose(np.mean(quad, axis=0), 20)


def rectangle_by_hand(quad, ratio):
    """Area of the least rectangle, along any side, around the quad's whole-pixel corners and a disc."""
    q = np.array(quad, float)
    x, y = q.T
    size = abs(np.dot(x, np.roll(y, -1)) - np.dot(np.roll(x, -1), y)) / 2
    d = size * ratio / np.hypot(*(np.roll(q, -1, axis=0) - q).T).sum()
    t, found = np.trunc(q), []
    for side in np.roll(t, -1, axis=0) - t:
        n = np.hypot(*side)
        if n:
            u = side / n
            a, b = t @ u, t @ np.array([-u[1], u[0]])
            found.append((np.ptp(a) + 2 * d) * (np.ptp(b) + 2 * d))
    return min(found)


def test_rectangles_lie_along_the_best_side(spark):
    from glyphmill.functions import boxes as B

    rng = np.random.default_rng(3)
    quads = [[(10.1, 5.2), (10.9, 5.9), (30.0, 25.0), (0.0, 25.0)], [(5.2, 5.1), (40.3, 9.7), (38.0, 22.0), (3.0, 18.5)]]
    for _ in range(60):
        c, w, h, turn = rng.uniform(40, 90, 2), *rng.uniform(4, 40, 2), rng.uniform(-0.6, 0.6)
        corners = np.array([(-w, -h), (w, -h), (w, h), (-w, h)]) / 2 + rng.uniform(-1, 1, (4, 2))
        quads.append([tuple(map(float, p)) for p in corners @ np.array([[np.cos(turn), np.sin(turn)], [-np.sin(turn), np.cos(turn)]]) + c])
    table = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in q]) for i, q in enumerate(quads)], f"i int, q {B.QUAD}")
    for r in table.select("i", B.unclip(F.col("q"), 1.5).alias("u")).collect():
        u = np.array([(p.x, p.y) for p in r.u])
        upright = np.isclose(u[0][0], u[3][0]) or np.isclose(u[0][1], u[3][1])
        area = np.hypot(*(u[1] - u[0])) * np.hypot(*(u[3] - u[0]))
        assert upright or np.isclose(area, rectangle_by_hand(quads[r.i], 1.5)), quads[r.i]


def test_thin_texts_survive(spark):
    page = np.zeros((192, 224), np.uint8)
    page[40:42, 32:192] = 255  # two rows high: under three before it is grown, over three after
    page[90, 10:13] = 255
    rows = [("thin.png", bytearray([192, 224]) + bytearray(page.tobytes()))]
    found = R.detect(spark.createDataFrame(rows, "path string, content binary"), Toy).first()
    assert len(found.quads) == 1


def test_crop_is_upright():
    image = np.zeros((20, 20, 3), np.uint8)
    image[5:9, 5:15] = 200
    assert P.crop(image, np.array([(5, 5), (14, 5), (14, 8), (5, 8)], float), 9, 3).min() == 200
    assert P.gradient_page().shape == P.white_page().shape == (480, 640, 3)


class Toy:
    """Bright pixels are text; a crop's class is its brightness."""

    def decode(self, content):
        h, w = int(content[0]), int(content[1])
        return np.frombuffer(content[2:], np.uint8).reshape(h, w, 1).repeat(3, 2)

    def probabilities(self, tensor):
        return (tensor[0, 0] > 0).astype(np.float32)

    def class_scores(self, tensor):
        levels = np.where(tensor[:, :, 20:28, 20:28].mean(axis=(1, 2, 3)) > 0.5, 1, 2)
        return np.eye(3)[[[0, k, k, 0] for k in levels]]


def test_images_to_texts(spark):
    h, w = 192, 224
    page = np.zeros((h, w), np.uint8)
    for top, shade in ((10, 255), (80, 255), (112, 160), (144, 255)):
        page[top : top + 16, 32:192] = shade
    rows = [("a.png", bytearray([h, w]) + bytearray(page.tobytes())), ("bad.png", bytearray(b"\x05\x05x"))]
    images = spark.createDataFrame(rows, "path string, content binary")
    found = R.recognise_regions(R.label_regions(R.detect(images, Toy)), Toy, F.array(*(F.lit(c) for c in ("blank", "x", "y")))).orderBy("path").collect()
    assert [r.text for r in found[0].text_regions] == ["x", "x", "y", "x"] and found[0].error is None and found[0].total_ms > 0
    assert found[1].text_regions == [] and found[1].error.startswith("ValueError")


def test_boxes_behind_many_outlines_are_found():
    p = np.zeros((140, 160))
    p[:90:2, ::2] = 0.9  # 3,600 dots
    p[110:125, 30:90] = 0.9
    found = P.boxes(p)
    assert len(found) == 1 and found[0][:, 1].min() >= 105
