"""String scores and accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import accuracy as E
from glyphmill.operators import matching as M
from glyphmill.operators import reports as R
from glyphmill.plans import adapters as A
from glyphmill.plans.latency_queries import _rounded
from glyphmill.sql import register_functions


def _names(spark, d):
    return A.table(spark, d, "part").select("p_name").distinct()


def _pairs(spark, d):
    a = _names(spark, d).select(F.col("p_name").alias("a"))
    b = _names(spark, d).select(F.col("p_name").alias("b"))
    return a.join(b)  # distinct names, whose number the table's size does not change


def _files(spark, d):
    k = F.col("p_partkey")
    return A.table(spark, d, "part").select(k, F.concat(F.when(k % 2 == 0, "result_").otherwise(""), F.replace("p_name", F.lit(" "), F.lit(".")), F.when(k % 3 == 0, "_result").otherwise(""), F.when(k % 5 == 0, ".tar.gz").otherwise(".json")).alias("name"))


def filename_base(spark, d):
    return _files(spark, d).select("p_partkey", T.filename_base(F.col("name")).alias("base"), T.file_stem(F.col("name")).alias("stem"), T.file_suffix(F.col("name")).alias("suffix"))


def normalize_text(spark, d):
    k = F.col("p_partkey")
    padded = F.concat(F.when(k % 2 == 0, "\t ").otherwise(""), F.col("p_name"), F.when(k % 3 == 0, "\n").otherwise(" "))
    return A.table(spark, d, "part").select("p_partkey", T.normalize_text(F.when(k % 7 != 0, padded)).alias("normal"))


def levenshtein_distance(spark, d):
    return _pairs(spark, d).select("a", "b", T.levenshtein_distance(F.col("a"), F.col("b")).alias("distance"))


def levenshtein_similarity(spark, d):
    return _rounded(_pairs(spark, d).select("a", "b", T.levenshtein_similarity(F.col("a"), F.col("b")).alias("similarity")))


def jaro_winkler(spark, d):
    return _rounded(_pairs(spark, d).select("a", "b", T.jaro_winkler(F.col("a"), F.col("b")).alias("similarity")))


def combined_similarity(spark, d):
    return _rounded(_pairs(spark, d).select("a", "b", T.combined_similarity(F.col("a"), F.col("b")).alias("similarity")))


def _damaged(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 5 == 0, F.expr("substring(p_name, 2)")).when(k % 7 == 0, "").otherwise(F.replace("p_name", F.lit("e"), F.lit("c")))
    return A.table(spark, d, "part").select(k, name.alias("text"), "p_name")


def best_match(spark, d):
    return _rounded(M.best_match(_damaged(spark, d), _names(spark, d).withColumn("position", F.conv(F.substring(F.md5("p_name"), 1, 12), 16, 10).cast("long")), "text", "p_name", "position", 0.5))


def is_match(spark, d):
    scored = M.scored_pairs(_damaged(spark, d), "text", "p_name", T.combined_similarity)
    return scored.select("p_partkey", (F.col("score") >= 0.8).alias("matches"), T.match_class(F.col("score"), F.col("text") != "").alias("kind"))


def sql_scores(spark, d):
    register_functions(spark)
    scored = spark.sql("SELECT p_partkey, text_normal(text) AS normal, combined_similarity(text, p_name) AS score, text <> '' AS has FROM {rows}", rows=_damaged(spark, d))
    return _rounded(scored.selectExpr("p_partkey", "normal", "score", "match_class(score, has) AS kind"))


def evaluate_images(spark, d):
    return _rounded(E.evaluate(A.images(spark, d), F.col("pipeline")))


def accuracy_long(spark, d):
    return _rounded(E.long_form(E.evaluate(A.images(spark, d), F.col("pipeline"))))


def field_stats(spark, d):
    return _rounded(E.field_statistics(E.evaluate(A.images(spark, d), F.col("pipeline"))))


def overall_stats(spark, d):
    return _rounded(E.overall_statistics(E.evaluate(A.images(spark, d), F.col("pipeline"))))


def accuracy_winner(spark, d):
    accuracy = E.evaluate(A.images(spark, d), F.col("pipeline"))
    return _rounded(R.compared(E.both_statistics(accuracy), "even", "odd"))


def gt_join_ocr(spark, d):
    p = A.images(spark, d)
    expected = p.select(F.concat(F.lit("result_"), F.col("base"), F.lit(".json")).alias("file_name"), *E.FIELDS).where("size <> '7'")
    results = p.select(F.concat("base", F.lit("_result.json")).alias("file_name"), F.transform("texts", lambda t: F.struct(t.alias("text"))).alias("text_regions")).where("positionQuantity <> '3/9'")
    return E.paired_images(expected, results).select("base", "size", "positionQuantity", F.array_join("texts", "|").alias("texts"))


def format_results(spark, d):
    regions = F.transform("texts", lambda t, i: F.struct(T.blank_marker(t).alias("text"), (i * 0.217 + F.char_length("base") * 0.0131 + 0.00002).alias("score")))
    return A.images(spark, d).select("base", T.region_list(regions).alias("results"))


QUERIES = {
    "filename_base": filename_base,
    "normalize_text": normalize_text,
    "levenshtein_distance": levenshtein_distance,
    "levenshtein_similarity": levenshtein_similarity,
    "jaro_winkler": jaro_winkler,
    "combined_similarity": combined_similarity,
    "best_match": best_match,
    "is_match": is_match,
    "sql_scores": sql_scores,
    "gt_join_ocr": gt_join_ocr,
    "format_results": format_results,
    "evaluate_images": evaluate_images,
    "accuracy_long": accuracy_long,
    "accuracy_field_stats": field_stats,
    "accuracy_overall_stats": overall_stats,
    "accuracy_winner": accuracy_winner,
}

_FILES = "SELECT p_partkey, (CASE WHEN p_partkey % 2 = 0 THEN 'result_' ELSE '' END) || replace(p_name, ' ', '.') || (CASE WHEN p_partkey % 3 = 0 THEN '_result' ELSE '' END) || (CASE WHEN p_partkey % 5 = 0 THEN '.tar.gz' ELSE '.json' END) AS name FROM part"
_NAMES = "n AS (SELECT DISTINCT p_name FROM part), pr AS (SELECT a.p_name AS a, b.p_name AS b, a.p_name AS x, b.p_name AS y FROM n a, n b)"
_UPPER = "n AS (SELECT DISTINCT p_name FROM part), pr AS (SELECT a.p_name AS a, b.p_name AS b, upper(trim(a.p_name)) AS x, upper(trim(b.p_name)) AS y FROM n a, n b)"
_DAMAGED = "dm AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN substr(p_name, 2) WHEN p_partkey % 7 = 0 THEN '' ELSE replace(p_name, 'e', 'c') END AS text, p_name FROM part)"
_NORMAL = "upper(replace(trim({}), ' ', ''))"
_EVALUATED = f"""WITH {A.IMAGES},
ce AS (SELECT k, f, ti, e[f] AS ev, t[ti] AS tv, {_NORMAL.format('e[f]')} AS x, {_NORMAL.format('t[ti]')} AS y FROM (SELECT *, unnest(range(1, len(t) + 1)) AS ti FROM (SELECT *, unnest(range(1, 5)) AS f FROM im)) WHERE e[f] <> ''),
{A.similarity_ctes('ce')},
sc AS (SELECT k, f, ti, tv, CASE WHEN ce.x = '' AND ce.y = '' THEN 1.0 WHEN ce.x = '' OR ce.y = '' THEN 0.0 ELSE greatest(levsim, jw) END AS s FROM ce JOIN jw ON ce.x = jw.x AND ce.y = jw.y),
{{steps}}
al AS (SELECT * FROM m4 UNION ALL SELECT * FROM r4),
wide AS (
  SELECT im.k, im.pipeline, im.base, i.f, im.e[i.f] AS gt, coalesce(al.tv, '') AS ocr, coalesce(al.s, 0.0) AS s,
  CASE WHEN al.k IS NULL THEN 'missing' WHEN al.s >= 1 THEN 'exact' WHEN al.s >= 0.9 THEN 'acceptable' ELSE 'rejected' END AS kind
  FROM im CROSS JOIN (SELECT unnest(range(1, 5)) AS f) i LEFT JOIN al ON al.k = im.k AND al.f = i.f
)"""
_none = "m0 AS (SELECT k, f, ti, tv, s FROM sc WHERE false)"
_steps = [_none]
for _f in range(1, 5):  # confident fields in order: the best free text if it is acceptable
    _steps.append(f"m{_f} AS (SELECT * FROM m{_f - 1} UNION ALL SELECT k, f, ti, tv, s FROM (SELECT k, f, ti, tv, s FROM sc WHERE f = {_f} AND NOT EXISTS (SELECT 1 FROM m{_f - 1} m WHERE m.k = sc.k AND m.ti = sc.ti) QUALIFY row_number() OVER (PARTITION BY k ORDER BY s DESC, ti) = 1) WHERE s >= 0.9)")
_steps.append("r0 AS (SELECT * FROM m0)")
for _r in range(1, 5):  # then the best free pair, as often as there are fields
    _steps.append(f"r{_r} AS (SELECT * FROM r{_r - 1} UNION ALL SELECT k, f, ti, tv, s FROM sc WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM m4 UNION ALL SELECT * FROM r{_r - 1}) m WHERE m.k = sc.k AND (m.ti = sc.ti OR m.f = sc.f)) QUALIFY row_number() OVER (PARTITION BY k ORDER BY s DESC, f, ti) = 1)")
_EVALUATED = _EVALUATED.format(steps=",\n".join(_steps) + ",")
_KEYS = dict(enumerate(E.FIELDS, 1))
_FIELD = "CASE f " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in _KEYS.items()) + " END"
_OVER = "ov AS (SELECT pipeline, base, sum(s * 0.25) AS score, bool_and(kind = 'exact') AS ex, bool_and(kind IN ('exact', 'acceptable')) AS ac FROM wide GROUP BY pipeline, base)"
_FIELDS_SQL = f"fs AS (SELECT pipeline, {_FIELD} AS field, count(*) AS num_images, avg(s) AS avg_score, CAST(count_if(kind = 'exact') AS BIGINT) AS exact_count, CAST(count_if(kind IN ('exact', 'acceptable')) AS BIGINT) AS acceptable_count, CAST(count_if(kind = 'rejected') AS BIGINT) AS rejected_count, CAST(count_if(kind = 'missing') AS BIGINT) AS missing_count, avg(CAST(kind = 'exact' AS INTEGER)) * 100 AS exact_pct, avg(CAST(kind IN ('exact', 'acceptable') AS INTEGER)) * 100 AS acceptable_pct FROM wide GROUP BY 1, 2)"
_OVERALL_SQL = "os AS (SELECT pipeline, count(*) AS num_images, avg(score) AS avg_score, CAST(count_if(ex) AS BIGINT) AS all_exact_count, CAST(count_if(ac) AS BIGINT) AS all_acceptable_count, avg(CAST(ex AS INTEGER)) * 100 AS all_exact_pct, avg(CAST(ac AS INTEGER)) * 100 AS all_acceptable_pct FROM ov GROUP BY pipeline)"
ORACLES = {
    "filename_base": f"SELECT p_partkey, regexp_replace(regexp_replace(stem, '^result_', ''), '_result$', '') AS base, stem, suffix FROM (SELECT p_partkey, regexp_replace(name, '\\.[^.]*$', '') AS stem, lower(regexp_extract(name, '(\\.[^.]+)$', 1)) AS suffix FROM ({_FILES}))",
    "normalize_text": "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE replace(upper(regexp_replace((CASE WHEN p_partkey % 2 = 0 THEN chr(9) || ' ' ELSE '' END) || p_name || (CASE WHEN p_partkey % 3 = 0 THEN chr(10) ELSE ' ' END), '^\\s+|\\s+$', '', 'g')), ' ', '') END AS normal FROM part",
    "levenshtein_distance": f"WITH {_NAMES} SELECT a, b, CAST(levenshtein(a, b) AS INTEGER) AS distance FROM pr",
    "levenshtein_similarity": f"WITH {_NAMES} SELECT a, b, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS similarity FROM pr",
    "jaro_winkler": f"WITH {_NAMES}, {A.similarity_ctes('pr')} SELECT a, b, round(jw, 6) AS similarity FROM pr JOIN jw USING (x, y)",
    "combined_similarity": f"WITH {_UPPER}, {A.similarity_ctes('pr')} SELECT a, b, round(greatest(levsim, jw), 6) AS similarity FROM pr JOIN jw USING (x, y)",
    "best_match": f"WITH {_DAMAGED}, nm AS (SELECT DISTINCT p_name FROM part), dt AS (SELECT DISTINCT text FROM dm), pr AS (SELECT text, nm.p_name AS c, upper(trim(text)) AS x, upper(trim(nm.p_name)) AS y FROM dt, nm WHERE text <> ''), {A.similarity_ctes('pr')}, b AS (SELECT text, c, greatest(levsim, jw) AS s FROM pr JOIN jw USING (x, y) QUALIFY row_number() OVER (PARTITION BY text ORDER BY greatest(levsim, jw) DESC, CAST('0x' || substr(md5(c), 1, 12) AS BIGINT), c DESC) = 1) SELECT dt.text, CASE WHEN b.s > 0.5 THEN b.c ELSE '' END AS match, round(CASE WHEN b.s > 0.5 THEN b.s WHEN b.s IS NULL THEN 0.0 ELSE 0.5 END, 6) AS score FROM dt LEFT JOIN b USING (text)",
    "is_match": f"WITH {_DAMAGED}, pr AS (SELECT *, upper(trim(text)) AS x, upper(trim(p_name)) AS y FROM dm), {A.similarity_ctes('pr')}, g AS (SELECT p_partkey, text, greatest(levsim, jw) AS s FROM pr JOIN jw USING (x, y)) SELECT p_partkey, s >= 0.8 AS matches, CASE WHEN text = '' THEN 'missing' WHEN s >= 1 THEN 'exact' WHEN s >= 0.9 THEN 'acceptable' ELSE 'rejected' END AS kind FROM g",
    "sql_scores": f"WITH {_DAMAGED}, pr AS (SELECT *, upper(trim(text)) AS x, upper(trim(p_name)) AS y FROM dm), {A.similarity_ctes('pr')}, g AS (SELECT p_partkey, text, greatest(levsim, jw) AS s FROM pr JOIN jw USING (x, y)) SELECT p_partkey, {_NORMAL.format('text')} AS normal, round(s, 6) AS score, CASE WHEN text = '' THEN 'missing' WHEN s >= 1 THEN 'exact' WHEN s >= 0.9 THEN 'acceptable' ELSE 'rejected' END AS kind FROM g",
    "gt_join_ocr": f"WITH {A.IMAGES} SELECT base, e[3] AS size, e[4] AS positionQuantity, array_to_string(t, '|') AS texts FROM im WHERE e[3] <> '7' AND e[4] <> '3/9'",
    "format_results": f"WITH {A.IMAGES} SELECT base, array_to_string(list_transform(range(1, len(t) + 1), lambda i: (CASE WHEN trim(t[i]) = '' THEN '<None>' ELSE t[i] END) || ' (' || printf('%.4f', (i - 1) * 0.217::DOUBLE + length(base) * 0.0131::DOUBLE + 0.00002::DOUBLE) || ')'), ', ') AS results FROM im",
    "evaluate_images": _EVALUATED + ", " + _OVER + " SELECT w.base || '.png' AS filename, w.pipeline, " + ", ".join(f"max(gt) FILTER (f = {i}) AS gt_{n}, max(ocr) FILTER (f = {i}) AS ocr_{n}, round(max(s) FILTER (f = {i}), 6) AS score_{n}, max(kind) FILTER (f = {i}) AS match_type_{n}" for i, n in _KEYS.items()) + ", round(max(ov.score), 6) AS avg_accuracy_score, bool_and(ov.ex) AS all_exact, bool_and(ov.ac) AS all_acceptable FROM wide w JOIN ov USING (base) GROUP BY 1, 2",
    "accuracy_long": _EVALUATED + f" SELECT base || '.png' AS filename, pipeline, {_FIELD} AS field, gt AS gt_value, ocr AS ocr_value, round(s, 6) AS similarity, kind AS match_type FROM wide",
    "accuracy_field_stats": _EVALUATED + f", {_FIELDS_SQL} SELECT pipeline, field, num_images, round(avg_score, 6) AS avg_score, exact_count, acceptable_count, rejected_count, missing_count, round(exact_pct, 6) AS exact_pct, round(acceptable_pct, 6) AS acceptable_pct FROM fs",
    "accuracy_overall_stats": _EVALUATED + f", {_OVER}, {_OVERALL_SQL} SELECT pipeline, num_images, round(avg_score, 6) AS avg_score, all_exact_count, all_acceptable_count, round(all_exact_pct, 6) AS all_exact_pct, round(all_acceptable_pct, 6) AS all_acceptable_pct FROM os",
    "accuracy_winner": _EVALUATED + f", {_FIELDS_SQL}, {_OVER}, {_OVERALL_SQL}, bt AS (SELECT pipeline, field, exact_pct, acceptable_pct, avg_score FROM fs UNION ALL SELECT pipeline, 'overall', all_exact_pct, all_acceptable_pct, avg_score FROM os), u AS (" + " UNION ALL ".join(f"SELECT pipeline, field, '{m}' AS metric, {j} AS j, {m} AS v FROM bt" for j, m in enumerate(("exact_pct", "acceptable_pct", "avg_score"))) + "), g AS (SELECT field, metric, j, coalesce(max(v) FILTER (pipeline = 'even'), 0) AS a, coalesce(max(v) FILTER (pipeline = 'odd'), 0) AS b FROM u GROUP BY ALL) SELECT CAST((CASE field " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate([*E.FIELDS, 'overall'])) + " END) * 3 + j + 1 AS INTEGER) AS row_no, field, metric, round(a, 6) AS first, round(b, 6) AS second, CASE WHEN a > b THEN 'even' WHEN b > a THEN 'odd' ELSE 'Tie' END AS winner, round(a - b, 6) AS delta FROM g",
}
