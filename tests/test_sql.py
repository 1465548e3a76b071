from glyphmill import sql


def test_sql_functions_equal_the_columns(spark):
    sql.register_functions(spark)
    goldens = {("ABXXXXXX", "ABYYYYYY"): 0.6, ("ABCDEF", "BCADEF"): 0.916667, ("MARTHA", "MARHTA"): 0.961111, ("", ""): 1.0, ("", "A"): 0.0, ("abc", "xyz"): 0.0}
    for (a, b), score in goldens.items():
        assert round(spark.sql(f"SELECT jaro_winkler('{a}', '{b}') AS s").first().s, 6) == score
    r = spark.sql("SELECT combined_similarity(' Sand ', 'SAND') AS c, levenshtein_similarity('abcd', 'abxd') AS l, match_class(0.95, true) AS k, text_normal(' a b') AS n").first()
    assert (r.c, r.l, r.k, r.n) == (1.0, 0.75, "acceptable", "AB")


def test_tables(spark, data):
    sql.register_tables(spark, data, ("region", "nation"))
    assert spark.sql("SELECT count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey").first().n == 25
