"""Folds over ordered arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ewma(values: Column, alpha: float) -> Column:
    """Exponentially weighted mean, oldest first, seeded with the first value; 0 of an empty array."""
    a, rest = F.lit(float(alpha)), F.lit(1.0) - F.lit(float(alpha))
    first = F.get(values, F.lit(0))
    later = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.when(F.size(values) > 0, F.aggregate(later, first, lambda s, v: a * v + rest * s)).otherwise(0.0)


def changes(statuses: Column, always: str) -> Column:
    """1.0 for each neighbouring pair that differs or of which one is `always`, else 0.0."""
    n = F.greatest(F.size(statuses) - 1, F.lit(0))
    return F.zip_with(
        F.slice(statuses, F.lit(1), n),
        F.slice(statuses, F.lit(2), n),
        lambda x, y: F.when((x != y) | (x == always) | (y == always), 1.0).otherwise(0.0),
    )


def merge_ranges(ranges: Column) -> Column:
    """Sorted ranges (start, end), with those that overlap or touch made one.

    The open range is carried beside those that are done, which grow only where a gap is.
    """
    none = F.slice(ranges, F.lit(1), F.lit(0))
    start = F.struct(none.alias("done"), F.get(ranges, F.lit(-1)).alias("open"))

    def step(s, r):
        last = s["open"]
        joins = last.isNotNull() & (r["start"] <= last["end"] + 1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        own = F.struct(r["start"].alias("start"), r["end"].alias("end"))
        done = F.when(joins | last.isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(last)))
        return F.struct(done.alias("done"), F.when(joins, longer).otherwise(own).alias("open"))

    return F.aggregate(F.array_sort(ranges), start, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def contains(span: Column, line: Column) -> Column:
    """Whether a range (start, end) holds a line, ends included."""
    return (span["start"] <= line) & (line <= span["end"])


def overlaps(a: Column, b: Column) -> Column:
    """Whether two ranges share a line."""
    return (a["start"] <= b["end"]) & (b["start"] <= a["end"])


def budget_fold(costs: Column, cap: float) -> Column:
    """Of calls in order, which still run: a call is refused once the cap is spent, or if the mean
    cost so far on top of what is spent would pass it."""
    start = F.struct(F.lit(0.0).alias("spent"), F.lit(0).cast("long").alias("n"), F.array().cast("array<boolean>").alias("ran"))

    def step(s, c):
        mean = F.when(s["n"] > 0, s["spent"] / s["n"]).otherwise(0.0)
        runs = ~((s["spent"] >= cap) | ((mean > 0) & (s["spent"] + mean > cap)))
        return F.struct(
            (s["spent"] + F.when(runs, c).otherwise(0.0)).alias("spent"),
            (s["n"] + F.when(runs, 1).otherwise(0)).cast("long").alias("n"),
            F.concat(s["ran"], F.array(runs)).alias("ran"),
        )

    return F.aggregate(costs, start, step, lambda s: s["ran"])
