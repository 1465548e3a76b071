"""Text functions as column expressions: normalising, edit distance, Jaro-Winkler, match classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT, ACCEPTABLE = 1.0, 0.9
#: Unicode white space, as a Java character class.
_SPACES = r"[\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, f"^{_SPACES}+|{_SPACES}+$", "")


def normalize_text(text: Column) -> Column:
    """Stripped, upper case, without U+0020; null is empty."""
    return F.replace(F.upper(strip(F.coalesce(text, F.lit("")))), F.lit(" "), F.lit(""))


def file_stem(name: Column) -> Column:
    """The last path component without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(F.regexp_extract(name, r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")


def file_suffix(name: Column) -> Column:
    """The last extension with its dot, lower case, or empty."""
    return F.lower(F.regexp_extract(F.regexp_extract(name, r"([^/]*)/*$", 1), r"(?<=.)(\.[^.]+)$", 1))


def filename_base(name: Column) -> Column:
    """The key under which results and expected values of one image meet: the stem without `result_` before or `_result` behind."""
    return F.regexp_replace(F.regexp_replace(file_stem(name), "^result_", ""), "_result$", "")


def levenshtein_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty texts."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def bound(build, *columns: Column) -> Column:
    """build(*columns) with each column computed once a row, however often build uses it: a lambda over one element binds them."""
    pack = F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns)))
    return F.element_at(F.transform(F.array(pack), lambda p: build(*(p[f"c{i}"] for i in range(len(columns))))), 1)


def jaro_winkler(a: Column, b: Column, prefix_scale: float = 0.1) -> Column:
    """Jaro-Winkler with half transpositions kept and the prefix bonus at every score.

    Each character of a, from the left, takes the first free equal character of b within the window. The fold's state is b
    with taken characters struck out (by U+FFFF, which no text has) and the list of places taken, 0 for none.
    """
    return bound(lambda x, y: _jaro_winkler(x, y, prefix_scale), F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def _jaro_winkler(a: Column, b: Column, prefix_scale: float) -> Column:
    n, m = F.char_length(a), F.char_length(b)
    window = F.greatest(F.floor(F.greatest(n, m) / 2).cast("int") - 1, F.lit(0))

    def take(state: Column, i: Column) -> Column:
        first = F.position(F.substring(a, i, F.lit(1)), state["free"], F.greatest(i - window, F.lit(1)))

        def strike(j: Column) -> Column:
            hit = F.when(j <= i + window, j).otherwise(0)
            return F.struct(F.when((j > 0) & (j <= i + window), F.overlay(state["free"], F.lit("\uffff"), j, F.lit(1))).otherwise(state["free"]).alias("free"), F.concat(state["places"], F.array(hit)).alias("places"))

        return bound(strike, first)

    taken = F.aggregate(F.sequence(F.lit(1), n), F.struct(b.alias("free"), F.array().cast("array<int>").alias("places")), take)["places"]

    def score(taken: Column) -> Column:
        places = F.filter(taken, lambda j: j > 0)
        order = F.array_sort(places)
        from_a = F.filter(F.transform(taken, lambda j, i: F.when(j > 0, i + 1)), lambda i: i.isNotNull())
        hits = F.size(places)
        moved = F.aggregate(F.zip_with(from_a, order, lambda p, q: (F.substring(a, p, F.lit(1)) != F.substring(b, q, F.lit(1))).cast("int")), F.lit(0), lambda x, y: x + y)
        jaro = (hits / n + hits / m + (hits - moved / 2) / hits) / 3
        common = F.when(F.substring(a, 1, 1) != F.substring(b, 1, 1), 0)
        for k in (2, 3, 4):
            common = common.when((n < k) | (m < k) | (F.substring(a, k, 1) != F.substring(b, k, 1)), k - 1)
        return F.when(hits == 0, 0.0).otherwise(jaro + common.otherwise(4) * prefix_scale * (1 - jaro))

    return F.when(a == b, 1.0).when((n == 0) | (m == 0), 0.0).otherwise(bound(score, taken))


def combined_similarity(a: Column, b: Column) -> Column:
    """The better of both similarities, on stripped upper case."""
    a, b = F.upper(strip(F.coalesce(a, F.lit("")))), F.upper(strip(F.coalesce(b, F.lit(""))))
    return bound(lambda x, y: F.greatest(levenshtein_similarity(x, y), _jaro_winkler(x, y, 0.1)), a, b)


def field_similarity(expected: Column, found: Column) -> Column:
    """Normalised texts: 1 if both are empty, 0 if one is, else the combined similarity."""

    def score(a: Column, b: Column) -> Column:
        either = F.greatest(levenshtein_similarity(a, b), _jaro_winkler(a, b, 0.1))
        return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(either)

    return bound(score, normalize_text(expected), normalize_text(found))


def is_match(text: Column, target: Column, threshold: float = 0.8) -> Column:
    return combined_similarity(text, target) >= threshold


def match_class(similarity: Column, has_text: Column) -> Column:
    """missing, exact, acceptable or rejected."""
    return F.when(~has_text, "missing").when(similarity >= EXACT, "exact").when(similarity >= ACCEPTABLE, "acceptable").otherwise("rejected")


def blank_marker(text: Column) -> Column:
    """The text, or `<None>` where it is only white space."""
    return F.when(strip(F.coalesce(text, F.lit(""))) == "", "<None>").otherwise(text)


def region_list(regions: Column) -> Column:
    """Regions as `text (0.9523), text (0.8912)`; empty for none."""
    return F.coalesce(F.array_join(F.transform(regions, lambda r: F.concat(r["text"], F.lit(" ("), F.format_string("%.4f", r["score"].cast("double")), F.lit(")"))), ", "), F.lit(""))
