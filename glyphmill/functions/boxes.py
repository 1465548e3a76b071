"""Box geometry as column expressions. A quad is array<struct<x:double,y:double>> of four corners."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.text import bound

QUAD = "array<struct<x:double,y:double>>"
UPPER_PART, UPPER_SHARE = 0.35, 0.40
MIN_GAP, MIN_SIDE, SHAPE = 2.0, 3.0, 1.5
_TINY = 1e-6


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _plus(p: Column, d: Column, k: Column | float) -> Column:
    return point(p["x"] + d["x"] * k, p["y"] + d["y"] * k)


def _minus(p: Column, q: Column) -> Column:
    return point(p["x"] - q["x"], p["y"] - q["y"])


def distance(p: Column, q: Column) -> Column:
    dx, dy = p["x"] - q["x"], p["y"] - q["y"]
    return F.sqrt(dx * dx + dy * dy)


def _length(d: Column) -> Column:
    return F.sqrt(d["x"] * d["x"] + d["y"] * d["y"])


def _each(quad: Column, axis: str) -> list[Column]:
    return [quad[i][axis] for i in range(4)]


def min_y(quad: Column) -> Column:
    return F.array_min(F.transform(quad, lambda p: p["y"]))


def max_y(quad: Column) -> Column:
    return F.array_max(F.transform(quad, lambda p: p["y"]))


def area(quad: Column) -> Column:
    """Shoelace."""

    def half(q: Column) -> Column:
        x, y = _each(q, "x"), _each(q, "y")
        return F.abs(sum((x[i] * y[(i + 1) % 4] - x[(i + 1) % 4] * y[i] for i in range(4)), F.lit(0.0))) / 2

    return bound(half, quad)


def order_points(quad: Column) -> Column:
    """Corners clockwise (by angle about the centroid), the one of least x + y first."""

    def turned(q: Column) -> Column:
        def around(c: Column) -> Column:
            by_angle = F.transform(F.sort_array(F.transform(q, lambda p, i: F.struct(F.atan2(p["y"] - c["y"], p["x"] - c["x"]).alias("a"), i.alias("i"), p.alias("p")))), lambda s: s["p"])

            def rotate(r: Column) -> Column:
                sums = F.transform(r, lambda p: p["x"] + p["y"])
                first = F.array_position(sums, F.array_min(sums)).cast("int")
                return F.concat(F.slice(r, first, 4), F.slice(r, 1, first - 1))

            return bound(rotate, by_angle)

        return bound(around, point(sum(_each(q, "x"), F.lit(0.0)) / 4, sum(_each(q, "y"), F.lit(0.0)) / 4))

    return bound(turned, quad)


def rescale(quad: Column, ratio_w: Column, ratio_h: Column) -> Column:
    return F.transform(quad, lambda p: point(p["x"] / ratio_w, p["y"] / ratio_h))


def clip(quad: Column, width: Column, height: Column) -> Column:
    lo = F.lit(0.0)
    return F.transform(quad, lambda p: point(F.greatest(lo, F.least(p["x"], width.cast("double"))), F.greatest(lo, F.least(p["y"], height.cast("double")))))


def region(quad: Column, image_height: Column) -> Column:
    """upper, lower, or null for a box without height: upper if UPPER_SHARE of its height is above the mark."""

    def place(top: Column, tall: Column) -> Column:
        above = F.greatest(F.lit(0.0), image_height * UPPER_PART - top)
        return F.when(tall > 0, F.when(above / tall >= UPPER_SHARE, "upper").otherwise("lower"))

    return bound(lambda q: bound(lambda top, low: place(top, low - top), min_y(q), max_y(q)), quad)


def side_lengths(quad: Column) -> Column:
    """struct(w, h) of an ordered quad: the longer of each two opposite sides."""
    return bound(lambda q: F.struct(F.greatest(distance(q[0], q[1]), distance(q[2], q[3])).alias("w"), F.greatest(distance(q[0], q[3]), distance(q[1], q[2])).alias("h")), quad)


def crop_size(quad: Column) -> Column:
    """struct(w, h) in whole pixels of the upright crop."""
    return bound(lambda s: F.struct(s["w"].cast("int").alias("w"), s["h"].cast("int").alias("h")), side_lengths(quad))


def worth_a_crop(size: Column) -> Column:
    """Of a crop's struct(w, h): both at least 3 pixels, at least 12 high, and at least half as wide as high."""
    return (size["w"] >= 3) & (size["h"] >= 3) & (size["h"] >= 12) & (size["w"] >= size["h"] / 2)


def is_croppable(quad: Column) -> Column:
    return bound(worth_a_crop, crop_size(quad))


def _whole(x: Column) -> Column:
    """To the nearest integer, halves away from 0."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def unclip(quad: Column, ratio: float = 1.5) -> Column:
    """The least rectangle around an ordered quad, its corners cut to whole pixels, grown on all sides by area * ratio / perimeter; null if the area is under 1.

    Area and perimeter are those of the quad as it is. The least rectangle around what a disc grows has a side along one of the
    quad's, and is 2 d wider and higher than the quad is along that side and across: no polygon offset is needed. Where
    it is upright its sides are on whole pixels (halves away from 0), as the corners of a polygon offset in integers are.
    Leaning ones keep fractions. Of equal rectangles the one along the first side is taken.
    """

    def grown(q: Column) -> Column:
        p = [q[i] for i in range(4)]

        def out(t: Column, size: Column, d: Column) -> Column:
            def along(side: Column) -> Column:
                """Rectangle along a side: extents on both axes from the unit vector, grown area."""

                def extents(u: Column) -> Column:
                    a, b = F.transform(t, lambda c: c["x"] * u["x"] + c["y"] * u["y"]), F.transform(t, lambda c: c["y"] * u["x"] - c["x"] * u["y"])
                    return bound(rectangle, u, a, b)

                def rectangle(u: Column, a: Column, b: Column) -> Column:
                    spread = lambda v: F.struct((F.array_min(v) - d).alias("lo"), (F.array_max(v) + d).alias("hi"))
                    return bound(lambda a, b: F.struct(((a["hi"] - a["lo"]) * (b["hi"] - b["lo"])).alias("area"), side["i"].alias("i"), u.alias("u"), a.alias("a"), b.alias("b")), spread(a), spread(b))

                return bound(lambda n: F.when(n > 0, bound(extents, point(side["x"] / n, side["y"] / n))), _length(side))

            def corners(r: Column) -> Column:
                u, a, b = r["u"], r["a"], r["b"]
                upright = (u["x"] == 0) | (u["y"] == 0)
                snapped = lambda q: F.transform(q, lambda c: F.when(upright, point(_whole(c["x"]), _whole(c["y"]))).otherwise(c))
                at = lambda i, j: point(a[i] * u["x"] - b[j] * u["y"], a[i] * u["y"] + b[j] * u["x"])
                return snapped(F.array(at("lo", "lo"), at("hi", "lo"), at("hi", "hi"), at("lo", "hi")))

            def least(s: Column) -> Column:
                """Of the rectangles along all sides; a side parallel to the one opposite, which came before, gives no other."""
                turned = lambda p, q: (p["x"] * q["y"] != p["y"] * q["x"]) | ((q["x"] == 0) & (q["y"] == 0))
                other = [F.when(turned(s[i], s[i - 2]), s[i]) for i in (2, 3)]
                return F.array_min(F.array_compact(F.transform(F.array_compact(F.array(s[0], s[1], *other)), along)))

            sides = F.array(*(F.struct(F.lit(i).alias("i"), (t[(i + 1) % 4]["x"] - t[i]["x"]).alias("x"), (t[(i + 1) % 4]["y"] - t[i]["y"]).alias("y")) for i in range(4)))
            return F.when(size >= 1, bound(lambda r: F.when(r.isNotNull(), corners(r)), bound(least, sides)))

        around = sum((distance(p[i], p[(i + 1) % 4]) for i in range(4)), F.lit(0.0))
        whole = F.transform(q, lambda c: point(F.signum(c["x"]) * F.floor(F.abs(c["x"])), F.signum(c["y"]) * F.floor(F.abs(c["y"]))))
        return bound(lambda t, size, around: bound(lambda d: out(t, size, d), size * ratio / around), whole, area(q), around)

    return bound(grown, quad)


def is_large_enough(quad: Column) -> Column:
    """Whether both sides of a rectangle are MIN_SIDE or more."""
    return bound(lambda q: F.least(distance(q[0], q[1]), distance(q[1], q[2])) >= MIN_SIDE, quad)


def resize_shape(height: Column, width: Column, limit: int = 640, kind: str = "max") -> Column:
    """struct(h, w, ratio_h, ratio_w): sides for detection, whole multiples of 32."""
    ratio = F.least(limit / F.greatest(height, width), F.lit(1.0)) if kind == "max" else F.greatest(limit / F.least(height, width), F.lit(1.0))
    side = lambda x: F.greatest(F.floor(F.floor(x * ratio) / 32) * 32, F.lit(32)).cast("int")
    return bound(lambda h, w: F.struct(h.alias("h"), w.alias("w"), (h / height).alias("ratio_h"), (w / width).alias("ratio_w")), side(height), side(width))


def reading_order(quads: Column) -> Column:
    """Quads by y, then x, of their first corner; ties by place."""
    keyed = F.transform(quads, lambda q, i: F.struct(q[0]["y"].alias("y"), q[0]["x"].alias("x"), i.alias("i"), q.alias("q")))
    return F.transform(F.sort_array(keyed), lambda s: s["q"])


def top_down(quads: Column, most: int = 3) -> Column:
    """The first quads by least y; ties by place."""
    keyed = F.transform(quads, lambda q, i: F.struct(min_y(q).alias("y"), i.alias("i"), q.alias("q")))
    return F.slice(F.transform(F.sort_array(keyed), lambda s: s["q"]), 1, most)


def largest(quads: Column) -> Column:
    """The quad of greatest area, the first of equals; null for none."""
    keyed = F.transform(quads, lambda q, i: F.struct(area(q).alias("a"), (-i).alias("i"), q.alias("q")))
    return F.array_max(keyed)["q"]


def vertical_gap(above: Column, below: Column) -> Column:
    """From the lower edge of an ordered quad to the upper edge of the next."""
    return bound(lambda a, b: F.least(b[0]["y"], b[1]["y"]) - F.greatest(a[3]["y"], a[2]["y"]), above, below)


def between(above: Column, below: Column, width: Column, height: Column) -> Column:
    """A box between two ordered quads, left-aligned with the leftmost, SHAPE times as wide as high; null if above has no lower edge.

    It is at least as high as the two on average and leans like the lower edge of the one above.
    """

    def build(a: Column, b: Column) -> Column:
        edge = _minus(a[2], a[3])
        usual = (distance(a[3], a[0]) + distance(b[3], b[0])) / 2

        def box(edge: Column, size: Column, usual: Column, left: Column) -> Column:
            top, bottom = a[3]["y"], b[0]["y"]
            now = F.abs(bottom - top)
            more = F.when(now < usual, (usual - now) / 2).otherwise(0.0)
            wide = SHAPE * F.greatest(now, usual)
            tl, bl = point(left, top - more), point(left, bottom + more)
            unit = point(edge["x"] / size, edge["y"] / size)
            return F.when(size >= _TINY, clip(F.array(tl, _plus(tl, unit, wide), _plus(bl, unit, wide), bl), width, height))

        left = F.least(a[0]["x"], a[3]["x"], b[0]["x"], b[3]["x"])
        return bound(box, edge, _length(edge), usual, left)

    return bound(build, above, below)


def expanded(above: Column, middle: Column, below: Column, width: Column, height: Column) -> Column:
    """The middle of three ordered quads, brought in line with its neighbours; unchanged where nothing is amiss or an edge has no direction.

    Its left edge moves out to theirs (beyond 1 pixel), then it grows up and down to their mean height, then to the
    right to SHAPE times its height, then it is clipped to the image.
    """

    def build(a: Column, m: Column, b: Column) -> Column:
        usual = (distance(a[3], a[0]) + distance(b[3], b[0])) / 2
        tall, wide = distance(m[3], m[0]), distance(m[1], m[0])
        left = F.least(m[0]["x"], m[3]["x"])
        target = F.least(a[0]["x"], a[3]["x"], b[0]["x"], b[3]["x"])

        def along(q: Column) -> Column:
            """Unit vector of a quad's upper edge, or of the one above where it has none, else null."""
            own, other = _minus(q[1], q[0]), _minus(a[1], a[0])
            return F.when(_length(own) >= _TINY, point(own["x"] / _length(own), own["y"] / _length(own))).when(_length(other) >= _TINY, point(other["x"] / _length(other), other["y"] / _length(other)))

        def steps(usual: Column, tall: Column, wide: Column, left: Column, target: Column) -> Column:
            grow, move = tall < usual, left > target + 1
            final = F.when(grow, usual).otherwise(tall)

            def moved() -> Column:
                return F.when(~move, m).otherwise(bound(lambda u: F.when(u.isNotNull(), F.array(_plus(m[0], u, target - left), m[1], m[2], _plus(m[3], u, target - left))), along(m)))

            def heightened(q: Column) -> Column:
                down = _minus(q[3], q[0])

                def by(d: Column, size: Column) -> Column:
                    k = (usual - tall) / 2 / size
                    return F.when(size >= _TINY, F.array(_plus(q[0], d, -k), _plus(q[1], d, -k), _plus(q[2], d, k), _plus(q[3], d, k)))

                return F.when(~grow, q).otherwise(bound(by, down, _length(down)))

            def widened(q: Column) -> Column:
                now = distance(q[1], q[0])
                return F.when(now >= SHAPE * final, q).otherwise(bound(lambda u: F.when(u.isNotNull(), F.array(q[0], _plus(q[1], u, SHAPE * final - now), _plus(q[2], u, SHAPE * final - now), q[3])), along(q)))

            full = bound(lambda q: clip(bound(widened, bound(heightened, q)), width, height), moved())
            needed = grow | move | (wide < SHAPE * final)
            return F.when(needed, F.coalesce(full, m)).otherwise(m)

        return bound(steps, usual, tall, wide, left, target)

    return bound(build, above, middle, below)


def lower_boxes(quads: Column, width: Column, height: Column) -> Column:
    """array<struct<box, source>> for the lower part of a label: nothing, one, two with a created one between if there is room, or the first three with the middle one put right."""

    def item(q: Column, source: str = "detected") -> Column:
        return F.struct(q.alias("box"), F.lit(source).alias("source"))

    def build(q: Column) -> Column:
        ordered = [order_points(q[i]) for i in range(3)]

        def two(a: Column, b: Column) -> Column:
            plain = F.array(item(a), item(b))
            return F.when(vertical_gap(a, b) < MIN_GAP, plain).otherwise(bound(lambda c: F.when(c.isNull(), plain).otherwise(F.array(item(a), item(c, "created"), item(b))), between(a, b, width, height)))

        three = bound(lambda a, m, b: F.array(item(a), item(expanded(a, m, b, width, height)), item(b)), *ordered)
        return F.when(F.size(q) == 0, F.array().cast(f"array<struct<box:{QUAD},source:string>>")).when(F.size(q) == 1, F.array(item(ordered[0]))).when(F.size(q) == 2, bound(two, ordered[0], ordered[1])).otherwise(three)

    return bound(build, top_down(quads))


def label_boxes(quads: Column, width: Column, height: Column) -> Column:
    """The at most four boxes of a label: the largest upper box as it is, then the lower boxes. quads: in reading order."""

    def build(q: Column) -> Column:
        upper = F.filter(q, lambda b: region(b, height) == "upper")
        lower = F.filter(q, lambda b: region(b, height) == "lower")
        head = bound(lambda b: F.when(b.isNull(), F.array().cast(f"array<struct<box:{QUAD},source:string>>")).otherwise(F.array(F.struct(b.alias("box"), F.lit("detected").alias("source")))), largest(upper))
        return F.slice(F.concat(head, lower_boxes(lower, width, height)), 1, 4)

    return bound(build, quads)


def above_threshold(probabilities: Column, threshold: float) -> Column:
    """Rows of 0 and 1: 1 where a value is strictly over the threshold."""
    return F.transform(probabilities, lambda row: F.transform(row, lambda v: (v > threshold).cast("int")))


def masked_mean(values: Column, mask: Column) -> Column:
    """Sum of the values under the mask over its size plus a millionth; both flat arrays."""
    total = F.aggregate(F.zip_with(values, mask, lambda v, m: v.cast("double") * m), F.lit(0.0), lambda s, v: s + v)
    size = F.aggregate(mask, F.lit(0.0), lambda s, m: s + m)
    return total / (size + 1e-6)


def recognition_width(ratio: Column, height: int = 48, most: int | None = 320) -> Column:
    """Width of a batch whose widest crop has this ratio of width to height; for live frames 32 a ratio of 1, without a limit."""
    wide = F.floor(ratio * height)
    return (F.least(wide, F.lit(most)) if most else wide).cast("int")


def downscale(height: Column, width: Column, longest: int = 1280) -> Column:
    """Factor that brings a frame's longest side to `longest`, never over 1."""
    return F.least(F.lit(float(longest)) / F.greatest(height, width), F.lit(1.0))


def label(text: Column, score: Column) -> Column:
    return F.concat(text, F.lit(" ("), F.format_string("%.2f", score.cast("double")), F.lit(")"))


def label_anchor(quad: Column) -> Column:
    """Where a box's label is drawn: right of it, a line below its top."""
    return point(F.array_max(F.transform(quad, lambda p: p["x"])) + 5, min_y(quad) + 12)


def label_colour(source: Column) -> Column:
    return F.when(source == "created", "red").otherwise("green")


def rotation(quad: Column) -> Column:
    """Angle of the upper edge in degrees."""
    return F.atan2(quad[1]["y"] - quad[0]["y"], quad[1]["x"] - quad[0]["x"]) * (180 / math.pi)
