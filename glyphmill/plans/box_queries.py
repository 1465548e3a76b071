"""Box geometry, label structure, decoding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphmill.functions import boxes as B
from glyphmill.functions import ctc
from glyphmill.operators import latency as L
from glyphmill.operators.accuracy import once
from glyphmill.plans import adapters as A
from glyphmill.plans.latency_queries import _rounded

W, H = A.WIDTH, A.HEIGHT


def _corners(df, quad, *keep, digits=4):
    """x0, y0 .. x3, y3 of a quad column beside the kept ones."""
    return df.select(*keep, *(F.round(F.col(quad)[i][a], digits).alias(f"{a}{i}") for i in range(4) for a in "xy"))


def _corners_sql(quad: str, digits: int = 4) -> str:
    return ", ".join(f"round({quad}[{i + 1}].{a}, {digits}) AS {a}{i}" for i in range(4) for a in "xy")


def order_points(spark, d):
    return _corners(once(A.quads(spark, d), "o", B.order_points(F.col("quad"))), "o", "image", "idx")


def box_area_argmax(spark, d):
    big = once(A.image_quads(spark, d), "q", B.largest(F.col("quads")))
    return _corners(big.withColumn("area", F.round(B.area(F.col("q")), 4)), "q", "image", "area")


def reading_order(spark, d):
    rows = A.image_quads(spark, d).select("image", F.posexplode(B.reading_order(F.col("quads"))).alias("pos", "q"))
    return _corners(rows, "q", "image", "pos")


def region_classify(spark, d):
    return A.quads(spark, d).select("image", "idx", B.region(F.col("quad"), F.lit(H)).alias("region"))


def lower_region_top3(spark, d):
    rows = A.image_quads(spark, d).select("image", F.posexplode(B.top_down(F.filter("quads", lambda q: B.region(q, F.lit(H)) == "lower"))).alias("pos", "q"))
    return _corners(rows, "q", "image", "pos")


def _neighbours(spark, d):
    w = Window.partitionBy("image").orderBy("idx")
    o = once(A.quads(spark, d), "o", B.order_points(F.col("quad"))).withColumn("quad", F.col("o"))
    return o.select("image", "idx", F.col("quad").alias("a"), F.lead("quad", 1).over(w).alias("m"), F.lead("quad", 2).over(w).alias("b"))


def intermediate_box(spark, d):
    rows = _neighbours(spark, d).where("m is not null").withColumn("gap", F.round(B.vertical_gap(F.col("a"), F.col("m")), 4))
    rows = once(rows, "c", B.between(F.col("a"), F.col("m"), F.lit(W), F.lit(H)))
    return _corners(rows, "c", "image", "idx", "gap")


def expand_middle(spark, d):
    rows = once(_neighbours(spark, d).where("b is not null"), "c", B.expanded(F.col("a"), F.col("m"), F.col("b"), F.lit(W), F.lit(H)))
    return _corners(rows, "c", "image", "idx", digits=3)


def label_structure(spark, d):
    rows = A.image_quads(spark, d).select("image", F.posexplode(B.label_boxes(B.reading_order(F.col("quads")), F.lit(W), F.lit(H))).alias("pos", "b"))
    return _corners(rows.select("image", "pos", "b.source", "b.box"), "box", "image", "pos", "source", digits=3)


def label_overlay(spark, d):
    rows = A.quads(spark, d).withColumns({"text": F.concat(F.lit("t"), "idx"), "score": F.col("idx") / 8 + F.col("image") % 7 / 100 + 0.001, "source": F.when(F.col("idx") % 3 == 0, "created").otherwise("detected")})
    rows = rows.withColumn("at", B.label_anchor(F.col("quad")))
    return rows.select("image", "idx", B.label(F.col("text"), F.col("score")).alias("label"), F.round("at.x", 4).alias("x"), F.round("at.y", 4).alias("y"), B.label_colour(F.col("source")).alias("colour"), F.round(B.rotation(F.col("quad")), 4).alias("degrees"))


def frame_downscale(spark, d):
    p = A.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 61 + 5).alias("h"), (F.col("p_partkey") % 2900 + 20).cast("int").alias("w"))
    return _rounded(p.select("p_partkey", B.downscale(F.col("h"), F.col("w")).alias("factor")))


def unclip_expand(spark, d):
    rows = once(A.quads(spark, d), "u", B.unclip(B.order_points(F.col("quad")))).where("u is not null")
    rows = once(rows.withColumn("large", B.is_large_enough(F.col("u"))), "o", B.order_points(F.col("u")))
    return _corners(rows, "o", "image", "idx", "large")


def rescale_clip(spark, d):
    rows = once(A.quads(spark, d), "c", B.clip(B.rescale(F.col("quad"), F.lit(0.8), F.lit(0.75)), F.lit(W), F.lit(H)))
    return _corners(rows, "c", "image", "idx")


def crop_filter(spark, d):
    rows = once(A.quads(spark, d), "s", B.crop_size(B.order_points(F.col("quad"))))
    return rows.where(B.worth_a_crop(F.col("s"))).select("image", "idx", "s.w", "s.h")


def resize_shape(spark, d):
    p = A.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 37 + 5).alias("h"), (F.col("p_partkey") % 1900 + 20).cast("int").alias("w"))
    for kind in ("max", "min"):
        p = once(p, kind, B.resize_shape(F.col("h"), F.col("w"), kind=kind))
    return _rounded(p.select("p_partkey", *(F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in ("max", "min") for c in ("h", "w", "ratio_h", "ratio_w"))))


def batch_assign(spark, d):
    rows = once(A.quads(spark, d), "s", B.crop_size(B.order_points(F.col("quad")))).select((F.col("image") % 100).alias("stream"), "image", "idx", (F.col("s.w") / F.greatest("s.h", F.lit(1))).alias("ratio"))
    done = L.batched(rows, ("ratio", "image", "idx"), "stream", keys=A.table(spark, d, "lineitem").select((F.col("l_orderkey") % 100).alias("stream")))
    return _rounded(done.select("image", "idx", "batch", B.recognition_width(F.col("max_ratio")).alias("width"), B.recognition_width(F.col("max_ratio"), 32, None).alias("live_width"), "max_ratio"))


def ctc_decode(spark, d):
    alphabet = F.array(*(F.lit(c) for c in ("blank", "a", "b", "c", "d", "e", "f")))
    rows = once(A.scores(spark, d), "r", ctc.decode(F.col("steps"), alphabet))
    return _rounded(rows.select("vec_id", "r.text", "r.score"))


def threshold_mask(spark, d):
    mask = A.scores(spark, d).select("vec_id", B.above_threshold(F.col("steps"), 0.1).alias("m"))
    return mask.select("vec_id", F.array_join(F.transform("m", lambda r: F.array_join(r.cast("array<string>"), "")), "/").alias("mask"))


def masked_mean(spark, d):
    e = A.table(spark, d, "embeddings").select("vec_id", "embedding")
    mask = F.transform("embedding", lambda v: F.when(v > 0.05, 1.0).otherwise(0.0))
    return _rounded(e.select("vec_id", B.masked_mean(F.col("embedding"), mask).alias("score")))


QUERIES = {f.__name__: f for f in (order_points, box_area_argmax, reading_order, region_classify, lower_region_top3, intermediate_box, expand_middle, label_structure, label_overlay, frame_downscale, unclip_expand, rescale_clip, crop_filter, resize_shape, batch_assign, ctc_decode, threshold_mask, masked_mean)}

_WITH = f"WITH {A.QUADS}"
_ORD = f"{_WITH}, {A.ORDERED}"
_AREA = "abs(" + " + ".join(f"quad[{i + 1}].x * quad[{(i + 1) % 4 + 1}].y - quad[{(i + 1) % 4 + 1}].x * quad[{i + 1}].y" for i in range(4)) + ") / 2"
_TOP, _LOW = "least(quad[1].y, quad[2].y, quad[3].y, quad[4].y)", "greatest(quad[1].y, quad[2].y, quad[3].y, quad[4].y)"
_REGION = f"CASE WHEN {_LOW} - {_TOP} > 0 THEN CASE WHEN greatest(0, {H} * 0.35 - {_TOP}) / ({_LOW} - {_TOP}) >= 0.40 THEN 'upper' ELSE 'lower' END END"


def _dist(p: str, q: str) -> str:
    return f"sqrt(({p}.x - {q}.x) * ({p}.x - {q}.x) + ({p}.y - {q}.y) * ({p}.y - {q}.y))"


def _clip(x: str, most: int) -> str:
    return f"greatest(0, least({x}, {most}))"


_NEXT = f"{_ORD}, nb AS (SELECT image, idx, o AS a, lead(o, 1) OVER w AS m, lead(o, 2) OVER w AS b FROM oq WINDOW w AS (PARTITION BY image ORDER BY idx))"
# A box between a and m, and m put right between a and b, from (image, idx, a, m, b): CTEs that end in bt and ex.
_BETWEEN = f"""s1 AS (SELECT image, idx, a, m, least(m[1].y, m[2].y) - greatest(a[4].y, a[3].y) AS gap, least(a[1].x, a[4].x, m[1].x, m[4].x) AS l, {_dist('a[3]', 'a[4]')} AS n, ({_dist('a[4]', 'a[1]')} + {_dist('m[4]', 'm[1]')}) / 2 AS u, abs(m[1].y - a[4].y) AS h FROM nb WHERE m IS NOT NULL),
s2 AS (SELECT *, (a[3].x - a[4].x) / n AS dx, (a[3].y - a[4].y) / n AS dy, CASE WHEN h < u THEN (u - h) / 2 ELSE 0 END AS e, 1.5 * greatest(h, u) AS wd FROM s1),
bt AS (SELECT image, idx, gap, {_clip('l', W)} AS x0, {_clip('a[4].y - e', H)} AS y0, {_clip('l + dx * wd', W)} AS x1, {_clip('a[4].y - e + dy * wd', H)} AS y1, {_clip('l + dx * wd', W)} AS x2, {_clip('m[1].y + e + dy * wd', H)} AS y2, {_clip('l', W)} AS x3, {_clip('m[1].y + e', H)} AS y3 FROM s2)"""
# The fixture's boxes all have sides, so directions are always there.
_EXPAND = f"""t0 AS (SELECT image, idx, a, m, b, ({_dist('a[4]', 'a[1]')} + {_dist('b[4]', 'b[1]')}) / 2 AS u, {_dist('m[4]', 'm[1]')} AS h, {_dist('m[2]', 'm[1]')} AS w0, least(m[1].x, m[4].x) AS l, least(a[1].x, a[4].x, b[1].x, b[4].x) AS t FROM nb WHERE b IS NOT NULL),
t1 AS (SELECT *, h < u AS grow, l > t + 1 AS move, greatest(h, u) AS fh, CASE WHEN l > t + 1 THEN l - t ELSE 0 END AS mv, (m[2].x - m[1].x) / w0 AS ux, (m[2].y - m[1].y) / w0 AS uy FROM t0),
t2 AS (SELECT *, m[1].x - ux * mv AS ax, m[1].y - uy * mv AS ay, m[4].x - ux * mv AS dx, m[4].y - uy * mv AS dy FROM t1),
t3 AS (SELECT *, sqrt((dx - ax) * (dx - ax) + (dy - ay) * (dy - ay)) AS hl, CASE WHEN grow THEN (u - h) / 2 ELSE 0 END AS k FROM t2),
t4 AS (SELECT *, (dx - ax) / hl * k AS kx, (dy - ay) / hl * k AS ky FROM t3),
t5 AS (SELECT *, ax - kx AS p1x, ay - ky AS p1y, m[2].x - kx AS p2x, m[2].y - ky AS p2y, m[3].x + kx AS p3x, m[3].y + ky AS p3y, dx + kx AS p4x, dy + ky AS p4y FROM t4),
t6 AS (SELECT *, sqrt((p2x - p1x) * (p2x - p1x) + (p2y - p1y) * (p2y - p1y)) AS cw FROM t5),
t7 AS (SELECT *, CASE WHEN cw < 1.5 * fh THEN (1.5 * fh - cw) / cw ELSE 0 END AS r FROM t6),
t8 AS (SELECT *, (p2x - p1x) * r AS rx, (p2y - p1y) * r AS ry, grow OR move OR w0 < 1.5 * fh AS needed FROM t7),
ex AS (SELECT image, idx, """ + ", ".join(f"CASE WHEN needed THEN {_clip(f'p{i + 1}{c} + ' + (f'r{c}' if i in (1, 2) else '0'), W if c == 'x' else H)} ELSE m[{i + 1}].{c} END AS {c}{i}" for i in range(4) for c in "xy") + " FROM t8)"
_XY = [f"{c}{i}" for i in range(4) for c in "xy"]


def _plain(quad: str) -> str:
    return ", ".join(f"{quad}[{i + 1}].{c} AS {c}{i}" for i in range(4) for c in "xy")


_LABEL = f"""{_ORD}, k AS (SELECT q.image, q.idx, q.quad, o.o, {_REGION} AS region, {_AREA} AS ar, row_number() OVER (PARTITION BY q.image ORDER BY quad[1].y, quad[1].x, q.idx) AS r FROM qd q JOIN oq o USING (image, idx)),
up AS (SELECT image, quad FROM k WHERE region = 'upper' QUALIFY row_number() OVER (PARTITION BY image ORDER BY ar DESC, r) = 1),
lw AS (SELECT image, o, row_number() OVER (PARTITION BY image ORDER BY {_TOP}, r) AS n, count(*) OVER (PARTITION BY image) AS c FROM k WHERE region = 'lower'),
nb AS (SELECT image, least(any_value(c), 3) AS idx, any_value(o) FILTER (n = 1) AS a, any_value(o) FILTER (n = 2) AS m, any_value(o) FILTER (n = 3) AS b FROM lw GROUP BY image),
{_BETWEEN}, {_EXPAND},
al AS (
  SELECT image, 0.0 AS place, 'detected' AS source, {_plain('quad')} FROM up
  UNION ALL SELECT image, n, 'detected', {_plain('o')} FROM lw WHERE n <= 3 AND NOT (n = 2 AND c > 2)
  UNION ALL SELECT image, 1.5, 'created', {', '.join(_XY)} FROM bt WHERE idx = 2 AND gap >= 2
  UNION ALL SELECT image, 2.0, 'detected', {', '.join(_XY)} FROM ex
)
SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY place) - 1 AS INTEGER) AS pos, source, {', '.join(f'round({x}, 3) AS {x}' for x in _XY)} FROM al"""
_GROWN = f"""{_ORD}, g0 AS (
  SELECT image, idx, ({_AREA.replace('quad', 'o')}) AS size, {' + '.join(_dist(f'o[{i + 1}]', f'o[{(i + 1) % 4 + 1}]') for i in range(4))} AS around, list_transform(o, lambda p: {{'x': trunc(p.x), 'y': trunc(p.y)}}) AS t FROM oq
), g1 AS (SELECT image, idx, t, size * 1.5 / around AS d, unnest([1, 2, 3, 4]) AS i FROM g0 WHERE size >= 1),
g2 AS (SELECT *, t[i % 4 + 1].x - t[i].x AS sx, t[i % 4 + 1].y - t[i].y AS sy FROM g1),
g3 AS (SELECT image, idx, t, d, i, sx / sqrt(sx * sx + sy * sy) AS ux, sy / sqrt(sx * sx + sy * sy) AS uy FROM g2 WHERE sx <> 0 OR sy <> 0),
g4 AS (SELECT *, list_transform(t, lambda p: p.x * ux + p.y * uy) AS a, list_transform(t, lambda p: p.y * ux - p.x * uy) AS b FROM g3),
g5 AS (SELECT image, idx, ux, uy, list_min(a) - d AS a0, list_max(a) + d AS a1, list_min(b) - d AS b0, list_max(b) + d AS b1 FROM g4
  QUALIFY row_number() OVER (PARTITION BY image, idx ORDER BY (list_max(a) - list_min(a) + 2 * d) * (list_max(b) - list_min(b) + 2 * d), i) = 1),
g6 AS (SELECT image, idx, ux = 0 OR uy = 0 AS upright, [{{'x': a0 * ux - b0 * uy, 'y': a0 * uy + b0 * ux}}, {{'x': a1 * ux - b0 * uy, 'y': a1 * uy + b0 * ux}}, {{'x': a1 * ux - b1 * uy, 'y': a1 * uy + b1 * ux}}, {{'x': a0 * ux - b1 * uy, 'y': a0 * uy + b1 * ux}}] AS c FROM g5),
qd2 AS (SELECT image, idx, CASE WHEN upright THEN list_transform(c, lambda p: {{'x': round(p.x), 'y': round(p.y)}}) ELSE c END AS quad FROM g6),
{A.ORDERED.replace('sr', 'sr2').replace('ft', 'ft2').replace('oq', 'oq2').replace('FROM qd', 'FROM qd2')}
SELECT image, idx, least({_dist('quad[1]', 'quad[2]')}, {_dist('quad[2]', 'quad[3]')}) >= 3 AS large, {_corners_sql('o')} FROM oq2 JOIN qd2 USING (image, idx)"""
_CROP = f"SELECT image, idx, CAST(floor(greatest({_dist('o[1]', 'o[2]')}, {_dist('o[3]', 'o[4]')})) AS INTEGER) AS w, CAST(floor(greatest({_dist('o[1]', 'o[4]')}, {_dist('o[2]', 'o[3]')})) AS INTEGER) AS h FROM oq"
_STEPS = "st AS (SELECT vec_id, list_transform(range(0, 8), lambda i: embedding[i * 8 + 1 : i * 8 + 8]) AS steps FROM embeddings)"


def _resize(kind: str) -> str:
    ratio = "least(640.0::DOUBLE / greatest(h, w), 1.0)" if kind == "max" else "greatest(640.0::DOUBLE / least(h, w), 1.0)"
    side = lambda x: f"greatest(floor(floor({x} * {ratio}) / 32) * 32, 32)"
    return f"CAST({side('h')} AS INTEGER) AS {kind}_h, CAST({side('w')} AS INTEGER) AS {kind}_w, round({side('h')} / h, 6) AS {kind}_ratio_h, round({side('w')} / w, 6) AS {kind}_ratio_w"


ORACLES = {
    "order_points": f"{_ORD} SELECT image, idx, {_corners_sql('o')} FROM oq",
    "box_area_argmax": f"{_WITH}, ar AS (SELECT *, {_AREA} AS ar FROM qd QUALIFY row_number() OVER (PARTITION BY image ORDER BY {_AREA} DESC, idx) = 1) SELECT image, round(ar, 4) AS area, {_corners_sql('quad')} FROM ar",
    "reading_order": f"{_WITH} SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY quad[1].y, quad[1].x, idx) - 1 AS INTEGER) AS pos, {_corners_sql('quad')} FROM qd",
    "region_classify": f"{_WITH} SELECT image, idx, {_REGION} AS region FROM qd",
    "lower_region_top3": f"{_WITH}, lw AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY {_TOP}, idx) - 1 AS pos FROM qd WHERE {_REGION} = 'lower') SELECT image, CAST(pos AS INTEGER) AS pos, {_corners_sql('quad')} FROM lw WHERE pos < 3",
    "intermediate_box": f"{_NEXT}, {_BETWEEN} SELECT image, idx, round(gap, 4) AS gap, {', '.join(f'round({x}, 4) AS {x}' for x in _XY)} FROM bt",
    "expand_middle": f"{_NEXT}, {_EXPAND} SELECT image, idx, {', '.join(f'round({x}, 3) AS {x}' for x in _XY)} FROM ex",
    "label_structure": _LABEL,
    "label_overlay": f"{_WITH} SELECT image, idx, 't' || idx || ' (' || printf('%.2f', idx / 8 + image % 7 / 100 + 0.001) || ')' AS label, round(list_max(list_transform(quad, lambda p: p.x)) + 5, 4) AS x, round({_TOP} + 12, 4) AS y, CASE WHEN idx % 3 = 0 THEN 'red' ELSE 'green' END AS colour, round(degrees(atan2(quad[2].y - quad[1].y, quad[2].x - quad[1].x)), 4) AS degrees FROM qd",
    "frame_downscale": "SELECT p_partkey, round(least(1280.0::DOUBLE / greatest(p_size * 61 + 5, p_partkey % 2900 + 20), 1.0), 6) AS factor FROM part",
    "unclip_expand": _GROWN,
    "rescale_clip": f"{_WITH} SELECT image, idx, " + ", ".join(f"round({_clip(f'quad[{i + 1}].{c} / {0.8 if c == "x" else 0.75}::DOUBLE', W if c == 'x' else H)}, 4) AS {c}{i}" for i in range(4) for c in "xy") + " FROM qd",
    "crop_filter": f"{_ORD}, cr AS ({_CROP}) SELECT image, idx, w, h FROM cr WHERE w >= 3 AND h >= 12 AND w >= h / 2",
    "resize_shape": f"SELECT p_partkey, {_resize('max')}, {_resize('min')} FROM (SELECT p_partkey, p_size * 37 + 5 AS h, CAST(p_partkey % 1900 + 20 AS INTEGER) AS w FROM part)",
    "batch_assign": f"{_ORD}, cr AS ({_CROP}), rt AS (SELECT image, idx, image % 100 AS stream, w / greatest(h, 1) AS ratio FROM cr), nm AS (SELECT *, CAST((row_number() OVER (PARTITION BY stream ORDER BY ratio, image, idx) - 1) // 6 AS INTEGER) AS batch FROM rt) SELECT image, idx, batch, CAST(least(floor(max(ratio) OVER (PARTITION BY stream, batch) * 48), 320) AS INTEGER) AS width, CAST(floor(max(ratio) OVER (PARTITION BY stream, batch) * 32) AS INTEGER) AS live_width, round(max(ratio) OVER (PARTITION BY stream, batch), 6) AS max_ratio FROM nm",
    "ctc_decode": f"WITH {_STEPS}, bs AS (SELECT vec_id, list_transform(steps, lambda r: list_position(r, list_max(r)) - 1) AS c, list_transform(steps, lambda r: CAST(list_max(r) AS DOUBLE)) AS s FROM st), kp AS (SELECT vec_id, c, s, list_filter(range(1, 9), lambda i: c[i] <> 0 AND c[i] <> (CASE WHEN i = 1 THEN 0 ELSE c[i - 1] END)) AS k FROM bs) SELECT vec_id, array_to_string(list_transform(k, lambda i: coalesce(['a', 'b', 'c', 'd', 'e', 'f'][c[i]], '')), '') AS text, round(CASE WHEN len(k) > 0 THEN list_sum(list_transform(k, lambda i: s[i])) / len(k) ELSE 0 END, 6) AS score FROM kp",
    "threshold_mask": f"WITH {_STEPS} SELECT vec_id, array_to_string(list_transform(steps, lambda r: array_to_string(list_transform(r, lambda v: CASE WHEN CAST(v AS DOUBLE) > 0.1::DOUBLE THEN '1' ELSE '0' END), '')), '/') AS mask FROM st",
    "masked_mean": "SELECT vec_id, round(coalesce(list_sum(list_transform(list_filter(embedding, lambda v: CAST(v AS DOUBLE) > 0.05::DOUBLE), lambda v: CAST(v AS DOUBLE))), 0) / (len(list_filter(embedding, lambda v: CAST(v AS DOUBLE) > 0.05::DOUBLE)) + 1e-6), 6) AS score FROM embeddings",
}
