"""The SQL surface: text scores as temporary SQL functions and a folder's tables as views."""

from __future__ import annotations

from pyspark.sql import SparkSession

from glyphmill.functions import text as T

_TAKEN = """aggregate(sequence(1, char_length(a)), cast(array() as array<int>), (taken, i) -> array_append(taken, coalesce(try_element_at(filter(
  if(greatest(i - reach, 1) <= least(i + reach, char_length(b)), sequence(greatest(i - reach, 1), least(i + reach, char_length(b))), cast(array() as array<int>)),
  j -> substring(b, j, 1) = substring(a, i, 1) and not array_contains(taken, j)), 1), 0)))"""
#: name: (arguments, type, body)
FUNCTIONS = {
    "text_strip": ("a STRING", "STRING", f"regexp_replace(a, r'^{T._SPACES}+|{T._SPACES}+$', '')"),
    "text_normal": ("a STRING", "STRING", "replace(upper(text_strip(coalesce(a, ''))), ' ', '')"),
    "levenshtein_similarity": ("a STRING, b STRING", "DOUBLE", "CASE WHEN coalesce(a, '') = '' AND coalesce(b, '') = '' THEN 1D ELSE 1 - levenshtein(coalesce(a, ''), coalesce(b, '')) / greatest(char_length(coalesce(a, '')), char_length(coalesce(b, ''))) END"),
    "jaro_taken": ("a STRING, b STRING, reach INT", "ARRAY<INT>", _TAKEN),
    "jaro_score": ("a STRING, b STRING, taken ARRAY<INT>", "DOUBLE", """CASE WHEN forall(taken, j -> j = 0) THEN 0D ELSE (
  size(filter(taken, j -> j > 0)) / char_length(a) + size(filter(taken, j -> j > 0)) / char_length(b)
  + (size(filter(taken, j -> j > 0)) - size(filter(zip_with(filter(transform(taken, (j, i) -> if(j > 0, i + 1, null)), i -> i is not null), array_sort(filter(taken, j -> j > 0)), (p, q) -> substring(a, p, 1) <> substring(b, q, 1)), x -> x)) / 2) / size(filter(taken, j -> j > 0))) / 3 END"""),
    "common_prefix": ("a STRING, b STRING", "INT", "size(filter(sequence(1, 4), k -> k <= least(char_length(a), char_length(b)) and substring(a, 1, k) = substring(b, 1, k)))"),
    "jaro_bonus": ("jaro DOUBLE, prefix INT", "DOUBLE", "if(jaro = 0, 0D, jaro + prefix * 0.1D * (1 - jaro))"),
    "jaro_winkler": ("a STRING, b STRING", "DOUBLE", "CASE WHEN coalesce(a, '') = coalesce(b, '') THEN 1D WHEN coalesce(a, '') = '' OR coalesce(b, '') = '' THEN 0D ELSE jaro_bonus(jaro_score(a, b, jaro_taken(a, b, greatest(cast(floor(greatest(char_length(a), char_length(b)) / 2) as int) - 1, 0))), common_prefix(a, b)) END"),
    "combined_similarity": ("a STRING, b STRING", "DOUBLE", "greatest(levenshtein_similarity(upper(text_strip(coalesce(a, ''))), upper(text_strip(coalesce(b, '')))), jaro_winkler(upper(text_strip(coalesce(a, ''))), upper(text_strip(coalesce(b, '')))))"),
    "match_class": ("similarity DOUBLE, has_text BOOLEAN", "STRING", f"CASE WHEN NOT has_text THEN 'missing' WHEN similarity >= {T.EXACT} THEN 'exact' WHEN similarity >= {T.ACCEPTABLE} THEN 'acceptable' ELSE 'rejected' END"),
}


def register_functions(spark: SparkSession) -> None:
    """Create FUNCTIONS for this session; they are SQL bodies, so plans that use them stay in the JVM."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")


def register_tables(spark: SparkSession, folder: str, names: tuple[str, ...]) -> None:
    """A view for each `<folder>/<name>.parquet`."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
