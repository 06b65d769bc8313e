"""Names, n-grams and set similarity as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .geo import haversine_sql


def ngrams(text: Column, k: int) -> Column:
    """Distinct character k-grams; none for texts shorter than k, NULL for NULL. Linear in the text's length."""
    # the array of one array gives the split text a name, so that it is split once and not for each gram
    each = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - k), lambda i: F.concat(*[F.get(c, i + j) for j in range(k)]))
    grams = F.array_distinct(F.transform(F.array(F.split(text, "")), each)[0])
    return F.when(F.char_length(text) >= k, grams).when(text.isNotNull(), F.array().cast("array<string>"))


def set_jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; NULL if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    return F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double"))


def jaccard_ngram(a: Column, b: Column, k: int) -> Column:
    return set_jaccard(ngrams(a, k), ngrams(b, k))


def clean_name(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def joined_name(*parts: Column, missing: str | None = "NA") -> Column:
    """Lower-cased concatenation; a missing part reads as the given text (None: the result is NULL)."""
    shown = [p if missing is None else F.coalesce(p, F.lit(missing)) for p in parts]
    return F.lower(F.concat(*shown))


def initial(text: Column) -> Column:
    return F.lower(F.coalesce(F.substring(text, 1, 1), F.lit("")))


def mentions(text: Column, word: str) -> Column:
    """Whether text holds word in any case; false for NULL."""
    return F.coalesce(F.lower(text).contains(word.lower()), F.lit(False))


def count_distinct_values(column: str) -> Column:
    """Distinct count in which NULL is a value."""
    return F.count_distinct(F.struct(column))


def register_sql_functions(spark: SparkSession) -> None:
    """jaccard_ngram(a, b, k) and haversine_miles(lat1, lon1, lat2, lon2) for SQL text."""
    grams = "array_distinct(transform(sequence(1, char_length({0}) - k + 1), i -> substring({0}, i, k)))"
    safe = "if(char_length({0}) >= k, " + grams + ", cast(array() as array<string>))"
    a, b = safe.format("a"), safe.format("b")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION jaccard_ngram(a STRING, b STRING, k INT) RETURNS DOUBLE RETURN try_divide(cast(size(array_intersect({a}, {b})) as double), cast(size(array_union({a}, {b})) as double))")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION haversine_miles(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN {haversine_sql()}")
