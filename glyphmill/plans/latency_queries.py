"""Latency, joins, windows, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import latency as L
from glyphmill.operators import reports as R
from glyphmill.operators.ordering import exact_percentiles
from glyphmill.plans import adapters as A
from glyphmill.sources import readers


def _rounded(df, *keep):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


_STATS = """SELECT pipeline, count(*) AS num_images, round(avg(total_ms), 6) AS avg_ms, round(min(total_ms), 6) AS min_ms, round(max(total_ms), 6) AS max_ms, round({spread}(total_ms), 6) AS std_ms, round(median(total_ms), 6) AS median_ms, round(quantile_cont(total_ms, 0.95), 6) AS p95_ms, round(quantile_cont(total_ms, 0.99), 6) AS p99_ms,
round(CASE WHEN avg(total_ms) > 0 THEN 1000 / avg(total_ms) ELSE 0 END, 6) AS throughput_fps, round(coalesce(sum(total_ms), 0) / 1000, 6) AS total_time_s{more} FROM ({source}) GROUP BY pipeline"""


def stats(spark, d):
    return _rounded(L.statistics(A.events_details(spark, d)))


def stats_population(spark, d):
    return _rounded(L.statistics(A.events_details(spark, d), population=True))


def breakdown(spark, d):
    return _rounded(L.statistics(A.split_details(spark, d)))


def speedup(spark, d):
    return _rounded(L.speedup(L.statistics(A.events_details(spark, d)), "click", "view"))


def coerce_numeric(spark, d):
    e = A.table(spark, d, "events").select("event_id", F.regexp_extract("props", r"(\d+)", 1).alias("raw"))
    p = A.table(spark, d, "part").select((-F.col("p_partkey")).alias("event_id"), F.col("p_name").alias("raw"))
    return e.unionByName(p).select("event_id", L.number(F.col("raw")).alias("value"))


def paired(spark, d):
    return L.paired(*A.runs(spark, d))


def paired_sampled(spark, d):
    rows = L.sampled(L.paired(*A.runs(spark, d)))
    return rows.select("filename", "first_ms", "second_ms", "position")


def _lines(spark, d):
    return A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("filename")).agg(F.count(F.lit(1)).alias("lines"), F.max("l_discount").alias("best")).withColumn("pipeline", F.lit("second"))


def merge_accuracy(spark, d):
    first, _ = A.runs(spark, d)
    return L.with_accuracy(first, _lines(spark, d).where("lines > 3"))


def missing_results(spark, d):
    return L.unmatched(A.table(spark, d, "documents").select("doc_id", "lang"), A.table(spark, d, "labels"), "doc_id")


def _rates(df):
    """Means and rates to four digits; the nudge makes exact halves, which engines sum in another order, fall alike."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 4) for c in ("mean_ms", "fps")})


def rolling(spark, d):
    e = A.table(spark, d, "events").select("event_id", "ts", "user_id", (F.col("value") / 1000).alias("seconds"))
    return _rates(L.rolling_mean(e).select("event_id", "mean_ms", "fps"))


def rolling_by_user(spark, d):
    e = A.table(spark, d, "events").select("event_id", "ts", "user_id", (F.col("value") / 1000).alias("seconds"))
    return _rates(L.rolling_mean(e, size=20, by="user_id").select("event_id", "user_id", "mean_ms", "fps"))


def speed_values(spark, d):
    return _rounded(R.speed_values(L.statistics(A.events_details(spark, d)), "click", "view"))


def bar_chart(spark, d):
    return _rounded(R.bar_chart(L.statistics(A.events_details(spark, d)), "click", "view"))


def extension_filter(spark, d):
    pages = A.table(spark, d, "pages").select("page_id", F.concat("url", F.element_at(F.array(*(F.lit(x) for x in (".JPG", ".png", ".tif", ".webp", "", ".tiff.txt"))), (F.col("page_id") % 6 + 1).cast("int"))).alias("path"))
    return pages.where(readers.is_image(F.col("path"))).select("page_id", T.file_suffix(F.col("path")).alias("suffix"))


def gradient(spark, d):
    return readers.gradient_images(spark)


def region_zip(spark, d):
    c = A.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    texts, rates = F.transform("t", lambda s: s["role"]), F.transform(F.filter("t", lambda s: s["turn"] % 3 != 2), lambda s: s["turn"] / 10)
    polygon = lambda turn, corners, shift: F.transform(F.sequence(F.lit(1), corners), lambda i: F.array((turn + shift).cast("double"), i.cast("double")))
    own = F.when(F.col("conv_id") % 3 != 0, F.transform(F.filter("t", lambda s: s["turn"] % 4 != 3), lambda s: polygon(s["turn"], (s["turn"] % 3 + 2).cast("int"), 0)))
    detected = F.when(F.col("conv_id") % 7 != 0, F.transform("t", lambda s: polygon(s["turn"], F.lit(4), 100)))
    regions = readers.regions_of(texts, rates, F.coalesce(own, F.array().cast("array<array<array<double>>>")), detected)
    return c.select("conv_id", F.posexplode(regions).alias("pos", "r")).select("conv_id", "pos", "r.text", F.round("r.score", 6).alias("score"), F.size("r.bbox").alias("corners"), F.try_element_at("r.bbox", F.lit(1))[0].alias("x"))


def ranged_percentiles(spark, d):
    return _rounded(exact_percentiles(A.events_details(spark, d), "pipeline", "total_ms", (0.5, 0.95, 0.99)))


QUERIES = {
    "latency_percentiles": ranged_percentiles,
    "latency_stats_by_pipeline": stats,
    "latency_stats_population": stats_population,
    "latency_breakdown": breakdown,
    "speedup_report": speedup,
    "coerce_numeric": coerce_numeric,
    "paired_latency": paired,
    "paired_latency_sampled": paired_sampled,
    "merge_accuracy_left": merge_accuracy,
    "missing_results_report": missing_results,
    "rolling_mean_200": rolling,
    "rolling_mean_by_user": rolling_by_user,
    "speed_report_values": speed_values,
    "bar_chart_data": bar_chart,
    "extension_filter": extension_filter,
    "gradient_images": gradient,
    "region_zip": region_zip,
}
_PAIR = f"""WITH s AS ({_STATS.format(spread='stddev_samp', more='', source=A.EVENTS_DETAILS).replace(', 6)', ', 12)')}), a AS (SELECT * FROM s WHERE pipeline = 'click'), b AS (SELECT * FROM s WHERE pipeline = 'view')"""
_METRICS = ("num_images", "avg_ms", "median_ms", "min_ms", "max_ms", "std_ms", "p95_ms", "p99_ms", "throughput_fps", "total_time_s")
ORACLES = {
    "latency_percentiles": " UNION ALL ".join(f"SELECT pipeline, {p}::DOUBLE AS percent, round(quantile_cont(total_ms, {p}), 6) AS total_ms FROM ({A.EVENTS_DETAILS}) GROUP BY pipeline" for p in (0.5, 0.95, 0.99)),
    "latency_stats_by_pipeline": _STATS.format(spread="stddev_samp", more="", source=A.EVENTS_DETAILS),
    "latency_stats_population": _STATS.format(spread="stddev_pop", more="", source=A.EVENTS_DETAILS),
    "latency_breakdown": _STATS.format(spread="stddev_samp", more=", round(avg(detection_ms), 6) AS avg_detection_ms, round(avg(recognition_ms), 6) AS avg_recognition_ms", source=A.SPLIT_DETAILS),
    "speedup_report": f"{_PAIR} SELECT (SELECT num_images FROM a) AS first_num_images, (SELECT num_images FROM b) AS second_num_images, round(x, 6) AS first_avg_ms, round(y, 6) AS second_avg_ms, round(CASE WHEN x > 0 THEN y / x ELSE 0 END, 6) AS speedup, CASE WHEN coalesce(x, 0) < coalesce(y, 0) THEN 'click' WHEN coalesce(y, 0) < coalesce(x, 0) THEN 'view' ELSE 'Tie' END AS faster FROM (SELECT (SELECT avg_ms FROM a) AS x, (SELECT avg_ms FROM b) AS y)",
    "coerce_numeric": "SELECT event_id, TRY_CAST(raw AS DOUBLE) AS value FROM (SELECT event_id, regexp_extract(props, '(\\d+)', 1) AS raw FROM events UNION ALL SELECT -p_partkey, p_name FROM part)",
    "paired_latency": f"WITH {A.RUNS} SELECT a.filename, first_ms, second_ms FROM a JOIN b ON a.filename IS NOT DISTINCT FROM b.filename",
    "paired_latency_sampled": f"WITH {A.RUNS}, p AS (SELECT a.filename, first_ms, second_ms FROM a JOIN b ON a.filename = b.filename), n AS (SELECT *, row_number() OVER (ORDER BY filename, first_ms, second_ms) - 1 AS position, count(*) OVER () AS n FROM p) SELECT filename, first_ms, second_ms, position FROM n WHERE n <= 50 OR position % greatest(n // 50, 1) = 0",
    "merge_accuracy_left": "WITH x AS (SELECT CAST(l_orderkey AS VARCHAR) AS filename, count(*) AS lines, max(l_discount) AS best FROM lineitem GROUP BY 1 HAVING count(*) > 3) SELECT CAST(o_orderkey AS VARCHAR) AS filename, o_totalprice AS total_ms, lines, best FROM orders LEFT JOIN x ON CAST(o_orderkey AS VARCHAR) = x.filename",
    "missing_results_report": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "rolling_mean_200": "SELECT event_id, round(m + 1e-9, 4) AS mean_ms, round(CASE WHEN m > 0 THEN 1000 / m END + 1e-9, 4) AS fps FROM (SELECT event_id, avg(value / 1000) OVER (ORDER BY ts, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) * 1000 AS m FROM events)",
    "rolling_mean_by_user": "SELECT event_id, user_id, round(m + 1e-9, 4) AS mean_ms, round(CASE WHEN m > 0 THEN 1000 / m END + 1e-9, 4) AS fps FROM (SELECT event_id, user_id, avg(value / 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * 1000 AS m FROM events)",
    "speed_report_values": f"{_PAIR} " + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS row_no, '{n}' AS metric, round(CAST((SELECT {c} FROM a) AS DOUBLE), 6) AS first, round(CAST((SELECT {c} FROM b) AS DOUBLE), 6) AS second, " + ("round((SELECT avg_ms FROM b) / (SELECT avg_ms FROM a), 6)" if c in ("avg_ms", "throughput_fps") else "CAST(NULL AS DOUBLE)") + " AS speedup" for i, (c, n) in enumerate(zip(_METRICS, (x[0] for x in R._SPEED), strict=False), 1)),
    "bar_chart_data": f"{_PAIR}, v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS metric, pipeline, {c} AS value FROM s WHERE pipeline IN ('click', 'view')" for c in ("avg_ms", "median_ms", "p95_ms", "p99_ms")) + ") SELECT metric, pipeline, round(value, 6) AS value, round((SELECT max(value) FROM v) * 1.2, 6) AS axis_max FROM v",
    "extension_filter": "SELECT page_id, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS suffix FROM (SELECT page_id, url || ['.JPG', '.png', '.tif', '.webp', '', '.tiff.txt'][page_id % 6 + 1] AS path FROM pages) WHERE lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) IN ('.jpg', '.jpeg', '.png', '.bmp', '.tiff', '.webp')",
    "gradient_images": "SELECT CAST(i AS INTEGER) AS image, CAST(y AS INTEGER) AS y, 640 AS width, CAST(floor(255 * y / 480) AS INTEGER) AS grey FROM range(2) a(i), range(480) b(y)",
    "region_zip": "WITH c AS (SELECT conv_id, list(role ORDER BY turn, role, text) AS roles, list(turn / 10 ORDER BY turn, role, text) FILTER (turn % 3 <> 2) AS rates, list(turn ORDER BY turn, role, text) AS turns, list(turn ORDER BY turn, role, text) FILTER (turn % 4 <> 3) AS own FROM conversations GROUP BY conv_id), s AS (SELECT *, CASE WHEN conv_id % 3 <> 0 AND len(own) > 0 THEN list_transform(own, lambda k: {'corners': k % 3 + 2, 'x': k}) WHEN conv_id % 7 <> 0 THEN list_transform(turns, lambda k: {'corners': 4, 'x': k + 100}) ELSE [] END AS shapes FROM c) SELECT conv_id, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN trim(roles[i]) = '' THEN '<None>' ELSE trim(roles[i]) END AS text, round(coalesce(rates[i], 0.0), 6) AS score, CAST(coalesce(shapes[i].corners, 0) AS INTEGER) AS corners, CAST(shapes[i].x AS DOUBLE) AS x FROM (SELECT *, unnest(range(1, len(roles) + 1)) AS i FROM s)",
}
