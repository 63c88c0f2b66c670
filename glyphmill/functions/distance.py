"""Edit distances and order statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def char_distance(a: Column, b: Column) -> Column:
    """Unit-cost edit distance in code points; null if either is null. Equal texts skip the table."""
    return F.when(a == b, F.lit(0)).otherwise(F.levenshtein(a, b)).cast("bigint")


def token_distance(a: Column, b: Column) -> Column:
    """Unit-cost edit distance of two token lists: each distinct token of the pair becomes one private
    character (supplementary planes beyond the first 40,000), then the JVM's own distance is used."""
    names = F.array_distinct(F.concat(a, b))

    def as_text(x: Column) -> Column:
        def one(t: Column) -> Column:
            n = F.array_position(names, t) + F.lit(0x3400)
            n = F.when(n >= 0xD800, n + 0x10000 - 0xD800).otherwise(n)
            return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")

        return F.array_join(F.transform(x, one), "")

    return F.when(a == b, F.lit(0)).otherwise(F.levenshtein(as_text(a), as_text(b))).cast("bigint")


def error_rate(distance: Column, length: Column) -> Column:
    """Aggregate: summed distance over summed reference length (1 at least for each row); 0 without rows."""
    return F.coalesce(F.sum(distance) / F.sum(F.greatest(length, F.lit(1))), F.lit(0.0))


def nearest_rank(values: Column, percent: float) -> Column:
    """Element at round-half-even(percent / 100 * (n - 1)) of the sorted array, 0.0 if it's empty."""
    v = F.array_sort(values)
    at = F.bround(F.lit(percent / 100.0) * (F.size(v) - 1).cast("double"), 0).cast("int")
    return F.when(F.size(v) == 0, F.lit(0.0)).otherwise(F.element_at(v, F.greatest(F.least(at, F.size(v) - 1), F.lit(0)) + 1))


def upper_median(values: Column) -> Column:
    """Element n // 2 (from 0) of the sorted array; null if it's empty."""
    v = F.array_sort(values)
    return F.try_element_at(v, (F.size(v) / 2).cast("int") + 1)
