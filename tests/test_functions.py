"""Text, box and decoding functions on worked examples."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import boxes as B
from glyphmill.functions import ctc
from glyphmill.functions import text as T
from glyphmill.operators import matching as M


def value(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("r")).first().r


def scores(spark, pairs, build):
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    return [r.r for r in frame.select("i", build(F.col("a"), F.col("b")).alias("r")).orderBy("i").collect()]


def test_jaro_winkler_goldens(spark):
    pairs = [("ABXXXXXX", "ABYYYYYY"), ("ABCDEF", "BCADEF"), ("MARTHA", "MARHTA"), ("", ""), ("", "A"), ("é", "é"), (None, None), ("abc", "xyz")]
    got = scores(spark, pairs, T.jaro_winkler)
    assert [round(x, 6) for x in got] == [0.6, 0.916667, 0.961111, 1.0, 0.0, 1.0, 1.0, 0.0]


def slow_jaro_winkler(a, b):
    """The definition, for the property below: matches in the window, half the moved ones, the prefix bonus."""
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, matched = set(range(len(b))), {}
    for i, c in enumerate(a):
        j = next((j for j in sorted(free) if b[j] == c and abs(i - j) <= reach), None)
        if j is not None:
            free -= {j}
            matched[i] = j
    if not matched:
        return 0.0
    m = len(matched)
    moved = sum(a[i] != b[j] for i, j in zip(sorted(matched), sorted(matched.values()), strict=True))
    jaro = (m / len(a) + m / len(b) + (m - moved / 2) / m) / 3
    same = next((k for k in range(4) if k >= min(len(a), len(b)) or a[k] != b[k]), 4)
    return jaro + same * 0.1 * (1 - jaro)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("abAé 1", max_size=9), st.text("abAé 1", max_size=9)), min_size=20, max_size=60))
def test_similarities_keep_their_laws(spark, pairs):
    got = scores(spark, pairs, T.jaro_winkler)
    assert got == pytest.approx([slow_jaro_winkler(a, b) for a, b in pairs])
    lev, back = scores(spark, pairs, T.levenshtein_similarity), scores(spark, [(b, a) for a, b in pairs], T.levenshtein_similarity)
    assert lev == back and all(0 <= x <= 1 and (x == 1) == (a == b) for x, (a, b) in zip(lev, pairs, strict=True))


def test_text_helpers(spark):
    assert value(spark, T.normalize_text(F.lit(" a b\tc\n"))) == "AB\tC"
    assert value(spark, T.normalize_text(F.lit(None).cast("string"))) == ""
    for name, base in (("a/result_x_result.json", "x"), ("x.png", "x"), ("result_result_y.json", "result_y"), ("a.b.c", "a.b"), (".hidden", ".hidden")):
        assert value(spark, T.filename_base(F.lit(name))) == base
    assert value(spark, T.levenshtein_distance(F.lit("é"), F.lit(None).cast("string"))) == 1
    assert value(spark, T.field_similarity(F.lit(" "), F.lit(""))) == 1.0 and value(spark, T.field_similarity(F.lit("a"), F.lit(" "))) == 0.0
    assert [value(spark, T.match_class(F.lit(s), F.lit(h))) for s, h in ((1.0, True), (0.9, True), (0.89, True), (1.0, False))] == ["exact", "acceptable", "rejected", "missing"]
    assert value(spark, T.blank_marker(F.lit(" 　"))) == "<None>"


def test_best_in_array(spark):
    names = F.array(*(F.lit(x) for x in ("sand", "Sand", "stone")))
    assert tuple(value(spark, M.best_in(F.lit("SAND "), names))) == ("sand", 1.0)
    assert tuple(value(spark, M.best_in(F.lit("zzz"), names, 0.3))) == ("", 0.3)
    assert tuple(value(spark, M.best_in(F.lit(""), names))) == ("", 0.0)


def test_prefilter_loses_nothing(spark):
    names = spark.createDataFrame([(x,) for x in ("aaaaaaaaaa", "aaaaaaaaab", "aaaaa", "aa", "", "aaaaaaaa")], "a string")
    pairs = names.join(names.select(F.col("a").alias("b")))
    assert M.above(pairs, "a", "b", 0.9).count() == pairs.where(T.is_match(F.col("a"), F.col("b"), 0.9)).count()


def quad(*points):
    return F.array(*(B.point(F.lit(float(x)), F.lit(float(y))) for x, y in points))


def flat(rows):
    return [round(v, 3) for p in rows for v in (p.x, p.y)]


CORNERS = ((0, 0), (40, 0), (40, 10), (0, 10))


def test_corner_order_and_area(spark):
    assert flat(value(spark, B.order_points(quad((40, 10), (0, 10), (0, 0), (40, 0))))) == [0, 0, 40, 0, 40, 10, 0, 10]
    assert value(spark, B.area(quad(*CORNERS))) == 400


def test_unclip_is_the_grown_rectangle(spark):
    d = 40 * 10 * 1.5 / 100
    assert flat(value(spark, B.unclip(quad(*CORNERS)))) == [-d, -d, 40 + d, -d, 40 + d, 10 + d, -d, 10 + d]
    assert value(spark, B.unclip(quad((0, 0), (0.5, 0), (0.5, 0.5), (0, 0.5)))) is None


@pytest.mark.parametrize(
    "middle, expected",
    [
        (((0, 20), (40, 20), (40, 32), (0, 32)), [0, 20, 40, 20, 40, 32, 0, 32]),  # nothing amiss
        (((9, 20), (49, 20), (49, 32), (9, 32)), [0, 20, 49, 20, 49, 32, 0, 32]),  # indented
        (((0, 22), (40, 22), (40, 28), (0, 28)), [0, 20, 40, 20, 40, 30, 0, 30]),  # too low
        (((0, 20), (10, 20), (10, 32), (0, 32)), [0, 20, 18, 20, 18, 32, 0, 32]),  # too narrow
        (((0.5, 20), (40, 20), (40, 32), (0.5, 32)), [0.5, 20, 40, 20, 40, 32, 0.5, 32]),  # within a pixel
    ],
)
def test_middle_box_is_put_right(spark, middle, expected):
    below = quad((0, 40), (40, 40), (40, 50), (0, 50))
    assert flat(value(spark, B.expanded(quad(*CORNERS), quad(*middle), below, F.lit(640), F.lit(480)))) == expected


def test_box_between(spark):
    below = quad((2, 16), (42, 16), (42, 26), (2, 26))
    assert flat(value(spark, B.between(quad(*CORNERS), below, F.lit(640), F.lit(480)))) == [0, 8, 15, 8, 15, 18, 0, 18]
    flatless = quad((0, 0), (40, 0), (0, 10), (0, 10))
    assert value(spark, B.between(flatless, below, F.lit(640), F.lit(480))) is None


def test_label_policy(spark):
    row = lambda y, x=0: quad((x, y), (x + 40, y), (x + 40, y + 10), (x, y + 10))
    sources = lambda *qs: [b.source for b in value(spark, B.label_boxes(F.array(*qs), F.lit(100), F.lit(100)))]
    assert sources(row(60)) == ["detected"]
    assert sources(row(50), row(80)) == ["detected", "created", "detected"]
    assert sources(row(50), row(61)) == ["detected"] * 2
    assert sources(row(0), row(5, 2), row(50), row(62), row(75), row(88)) == ["detected"] * 4
    assert value(spark, B.region(quad((0, 5), (9, 5), (9, 5), (0, 5)), F.lit(100))) is None


def test_shapes(spark):
    assert tuple(value(spark, B.resize_shape(F.lit(480), F.lit(1280))))[:2] == (224, 640)
    assert tuple(value(spark, B.resize_shape(F.lit(10), F.lit(10))))[:2] == (32, 32)
    assert value(spark, B.is_croppable(quad(*CORNERS))) is False and value(spark, B.is_croppable(quad((0, 0), (40, 0), (40, 12), (0, 12))))
    assert value(spark, B.recognition_width(F.lit(2.5))) == 120 and value(spark, B.recognition_width(F.lit(99.0))) == 320
    assert value(spark, B.downscale(F.lit(720), F.lit(2560))) == 0.5
    assert value(spark, B.masked_mean(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(1), F.lit(0)))) == pytest.approx(1.0, abs=1e-5)
    assert value(spark, B.rotation(quad(*CORNERS))) == 0 and value(spark, B.label_colour(F.lit("created"))) == "red"
    assert math.isclose(value(spark, B.label_anchor(quad(*CORNERS))).x, 45) and value(spark, B.label(F.lit("a"), F.lit(0.5))) == "a (0.50)"


def test_ctc(spark):
    steps = lambda *cs: F.array(*(F.array(*(F.lit(1.0 if i == c else 0.0) for i in range(4))) for c in cs))
    alphabet = F.array(F.lit("blank"), F.lit("a"), F.lit("b"))
    assert tuple(value(spark, ctc.decode(steps(1, 1, 0, 1, 2, 2), alphabet))) == ("aab", 1.0)
    assert tuple(value(spark, ctc.decode(steps(0, 0), alphabet))) == ("", 0.0)
    assert tuple(value(spark, ctc.decode(steps(3, 1), alphabet))) == ("a", 1.0)  # beyond the alphabet: no character
