"""The driver's tables in the shapes that the operators read, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("string").alias("filename"), F.col("event_type").alias("pipeline"), F.col("value").alias("total_ms"))


EVENTS_DETAILS = "SELECT CAST(event_id AS VARCHAR) AS filename, event_type AS pipeline, value AS total_ms FROM events"


def split_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("pipeline"), F.col("l_extendedprice").alias("detection_ms"), (F.col("l_extendedprice") * F.col("l_tax")).alias("recognition_ms"))
    return rows.withColumn("total_ms", F.col("detection_ms") + F.col("recognition_ms"))


SPLIT_DETAILS = "SELECT l_returnflag AS pipeline, l_extendedprice AS detection_ms, l_extendedprice * l_tax AS recognition_ms, l_extendedprice + l_extendedprice * l_tax AS total_ms FROM lineitem"


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two runs over the same images: orders, and their lines summed."""
    first = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("filename"), F.col("o_totalprice").alias("total_ms"))
    second = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total_ms")).select(F.col("l_orderkey").cast("string").alias("filename"), "total_ms")
    return first, second


RUNS = """a AS (SELECT CAST(o_orderkey AS VARCHAR) AS filename, o_totalprice AS first_ms FROM orders),
b AS (SELECT CAST(l_orderkey AS VARCHAR) AS filename, round(sum(l_extendedprice), 2) AS second_ms FROM lineitem GROUP BY l_orderkey)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """base, four expected values and damaged texts in another order, one row a part; every 13th part lacks a value."""
    # The table is one small file, so one task; scoring is dear, so its rows are dealt out.
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size").repartition(spark.sparkContext.defaultParallelism)
    k = F.col("p_partkey")
    value = {"color": F.split("p_name", " ")[0], "productCode": F.col("p_brand"), "size": F.col("p_size").cast("string"), "positionQuantity": F.concat((k % 9 + 1).cast("string"), F.lit("/9"))}
    color = F.when(k % 5 == 0, F.expr("substring(split(p_name, ' ')[0], 1, length(split(p_name, ' ')[0]) - 1)")).otherwise(value["color"])
    brand = F.when(k % 3 == 0, F.replace("p_brand", F.lit("o"), F.lit("0"))).otherwise(value["productCode"])
    size = F.when(k % 11 == 0, F.concat(F.lit(" "), value["size"], F.lit(" "))).otherwise(value["size"])
    texts = F.array(value["positionQuantity"], color, brand, size)
    return p.select(F.concat(F.lit("img"), k.cast("string")).alias("base"), F.when(k % 13 == 0, "").otherwise(value["color"]).alias("color"), value["productCode"].alias("productCode"), value["size"].alias("size"), value["positionQuantity"].alias("positionQuantity"), F.when(k % 7 == 0, F.slice(texts, 2, 3)).otherwise(texts).alias("texts"), F.when(k % 2 == 0, "even").otherwise("odd").alias("pipeline"))


IMAGES = """p AS (
  SELECT p_partkey AS k, string_split(p_name, ' ')[1] AS color, p_brand AS brand, CAST(p_size AS VARCHAR) AS size, CAST(p_partkey % 9 + 1 AS VARCHAR) || '/9' AS pos FROM part
), im AS (
  SELECT k, 'img' || k AS base, CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END AS pipeline, [CASE WHEN k % 13 = 0 THEN '' ELSE color END, brand, size, pos] AS e,
  CASE WHEN k % 7 = 0 THEN t[2:] ELSE t END AS t FROM (SELECT *, [pos, CASE WHEN k % 5 = 0 THEN color[:-2] ELSE color END, CASE WHEN k % 3 = 0 THEN replace(brand, 'o', '0') ELSE brand END, CASE WHEN k % 11 = 0 THEN ' ' || size || ' ' ELSE size END] AS t FROM p)
)"""


def jaro_winkler_sql(a: str, b: str) -> str:
    """Jaro-Winkler of two SQL text columns, as one SQL expression."""
    taken = f"list_reduce(list_transform(range(1, length({a}) + 1), lambda i: [i]), lambda acc, i: list_append(acc, coalesce(list_filter(range(greatest(1, i[1] - greatest(0, greatest(length({a}), length({b})) // 2 - 1)), least(length({b}), i[1] + greatest(0, greatest(length({a}), length({b})) // 2 - 1)) + 1), lambda j: substr({b}, j, 1) = substr({a}, i[1], 1) AND NOT list_contains(acc, j))[1], 0)), CAST([] AS BIGINT[]))"
    return taken


def similarity_ctes(source: str) -> str:
    """CTEs from `source` (x, y: ASCII texts) to jw(x, y, lev, levsim, jw, combined); x and y as they are, scores on them unchanged."""
    return f"""q AS (SELECT DISTINCT x, y FROM {source}),
tk AS (SELECT x, y, {jaro_winkler_sql('x', 'y')} AS taken FROM q),
ht AS (SELECT x, y, taken, list_filter(taken, lambda j: j > 0) AS places, list_filter(range(1, length(x) + 1), lambda i: taken[i] > 0) AS froms FROM tk),
mv AS (SELECT *, len(places) AS hits, list_sort(places) AS tos FROM ht),
jr AS (SELECT x, y, hits, CASE WHEN hits = 0 THEN 0.0 ELSE (hits / length(x) + hits / length(y) + (hits - len(list_filter(range(1, hits + 1), lambda r: substr(x, froms[r], 1) <> substr(y, tos[r], 1))) / 2) / hits) / 3 END AS jaro,
  CASE WHEN length(x) = 0 OR length(y) = 0 OR substr(x, 1, 1) <> substr(y, 1, 1) THEN 0 WHEN least(length(x), length(y)) < 2 OR substr(x, 2, 1) <> substr(y, 2, 1) THEN 1 WHEN least(length(x), length(y)) < 3 OR substr(x, 3, 1) <> substr(y, 3, 1) THEN 2 WHEN least(length(x), length(y)) < 4 OR substr(x, 4, 1) <> substr(y, 4, 1) THEN 3 ELSE 4 END AS pre FROM mv),
jw AS (SELECT x, y, levenshtein(x, y) AS lev, CASE WHEN greatest(length(x), length(y)) = 0 THEN 1.0 ELSE 1 - levenshtein(x, y) / greatest(length(x), length(y)) END AS levsim,
  CASE WHEN x = y THEN 1.0 WHEN hits = 0 THEN 0.0 ELSE jaro + pre * 0.1 * (1 - jaro) END AS jw FROM jr)"""


#: A quad a line: centre, size and shear from its numbers, corners from an arbitrary one; `idx` orders the quads of an image.
_CORNERS = {
    "x": ("l_quantity * 10 - (20 + l_quantity) + l_suppkey % 5", "l_quantity * 10 + (20 + l_quantity) + l_suppkey % 5", "l_quantity * 10 + (20 + l_quantity) - l_suppkey % 5", "l_quantity * 10 - (20 + l_quantity) - l_suppkey % 5"),
    "y": ("l_linenumber * 60 - (6 + l_partkey % 20)", "l_linenumber * 60 - (6 + l_partkey % 20) + l_suppkey % 3", "l_linenumber * 60 + (6 + l_partkey % 20) + l_suppkey % 3", "l_linenumber * 60 + (6 + l_partkey % 20)"),
}
WIDTH, HEIGHT = 640, 480
_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, idx, quad): idx from 1."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem")
    corners = [f"named_struct('x', cast({_CORNERS['x'][i]} as double), 'y', cast({_CORNERS['y'][i]} as double))" for i in range(4)]
    # One whole array for each turn, of which a row builds the one it needs.
    turned = " ".join(f"when {k} then array({', '.join(corners[(i + k) % 4] for i in range(4))})" for k in range(4))
    ordered = Window.partitionBy("l_orderkey").orderBy(*_ORDER)
    return rows.select(F.col("l_orderkey").alias("image"), F.row_number().over(ordered).cast("long").alias("idx"), F.expr(f"case l_partkey % 4 {turned} end").alias("quad"))


def image_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, quads) with the quads of an image in idx order."""
    return quads(spark, sf_dir).groupBy("image").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "quad"))), lambda s: s["quad"]).alias("quads"))


QUADS = "qd AS (SELECT image, idx, list_transform([0, 1, 2, 3], lambda i: c[(i + turn) % 4 + 1]) AS quad FROM (SELECT l_orderkey AS image, l_partkey % 4 AS turn, row_number() OVER (PARTITION BY l_orderkey ORDER BY " + ", ".join(_ORDER) + ") AS idx, [" + ", ".join(f"{{'x': CAST({_CORNERS['x'][i]} AS DOUBLE), 'y': CAST({_CORNERS['y'][i]} AS DOUBLE)}}" for i in range(4)) + "] AS c FROM lineitem))"
#: Corners clockwise from the one of least x + y.
ORDERED = """sr AS (SELECT image, idx, list_transform(list_sort(list_transform(range(1, 5), lambda i: {'a': atan2(quad[i].y - (quad[1].y + quad[2].y + quad[3].y + quad[4].y) / 4, quad[i].x - (quad[1].x + quad[2].x + quad[3].x + quad[4].x) / 4), 'i': i, 'x': quad[i].x, 'y': quad[i].y})), lambda s: {'x': s.x, 'y': s.y}) AS s FROM qd),
ft AS (SELECT *, list_position(list_transform(s, lambda p: p.x + p.y), list_min(list_transform(s, lambda p: p.x + p.y))) AS f FROM sr),
oq AS (SELECT image, idx, list_transform([0, 1, 2, 3], lambda i: s[(i + f - 1) % 4 + 1]) AS o FROM ft)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, steps): each vector as eight time steps of eight classes."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8)).alias("steps"))
