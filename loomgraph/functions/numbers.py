"""Scalar functions over numbers, times, arrays and JSON, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Confidence in permille by how a reference was resolved.
CONFIDENCE = {
    "structural": 1000, "type_checker": 1000, "import": 950, "this_member": 950, "framework": 900,
    "di_constructor": 850, "type_annotation": 800, "name_unique": 600, "heuristic": 500, "name_ambiguous": 300,
}


def permille(x: Column) -> Column:
    """round(1000 x) within 0 and 1000; NaN is 0."""
    return F.when(F.isnan(x), 0).otherwise(F.least(F.greatest(F.round(x * 1000), F.lit(0.0)), F.lit(1000.0))).cast("int")


def rule_confidence(rule: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(v) for kv in CONFIDENCE.items() for v in kv)), rule)


def derived_confidence(rule: Column, given: Column) -> Column:
    return F.least(rule_confidence(rule), given)


def unit(x: Column) -> Column:
    return F.greatest(F.least(F.nanvl(x, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def proximity(distance: Column) -> Column:
    return F.when(distance == 0, 1.0).when(distance == 1, 0.8).when(distance == 2, 0.5).when((distance == 3) | distance.isNull(), 0.2).otherwise(0.0)


def semantic_signal(cosine: Column) -> Column:
    return F.greatest(F.least((cosine - 0.5) / 0.5, F.lit(1.0)), F.lit(0.0))


def sample_factor(n: Column) -> Column:
    return F.least(F.lit(1.0), F.log(1 + n) / F.log(F.lit(31.0)))


def spread_factor(modules: Column) -> Column:
    return F.least(F.lit(1.0), modules / 3)


def backoff_ms(attempt: Column, base: int = 5_000, cap: int = 300_000) -> Column:
    """Milliseconds before the next try, without jitter."""
    return F.least(F.lit(cap).cast("double"), F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0)))).cast("long")


def directory_distance(a: Column, b: Column) -> Column:
    """Directories of either path that the other does not share."""
    x, y = (F.slice(F.split(p, "/"), F.lit(1), F.size(F.split(p, "/")) - 1) for p in (a, b))
    same = F.size(F.filter(F.transform(x, lambda v, i: F.slice(x, F.lit(1), i + 1) == F.slice(y, F.lit(1), i + 1)), lambda v: v))
    return F.size(x) + F.size(y) - 2 * same


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    scaled = lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))
    return F.transform(F.array(norm(a)), scaled)[0]  # the norm is computed once


def in_ranges(ranges: Column, line: Column) -> Column:
    """Whether a line lies in one of the half-open ranges."""
    return F.exists(ranges, lambda r: (line >= r["start"]) & (line < r["end"]))


def ranges_overlap(a: Column, b: Column) -> Column:
    return F.exists(a, lambda x: F.exists(b, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))


def nearest_line(ranges: Column, line: Column, most: int) -> Column:
    """The line in the ranges nearest to a line, the smaller of two; null beyond `most`."""
    near = F.transform(ranges, lambda r: F.greatest(r["start"], F.least(line, r["end"] - 1)))
    best = F.array_min(F.transform(near, lambda x: F.struct(F.abs(x - line).alias("d"), x.alias("x"))))
    return F.when(best["d"] <= most, best["x"])


def newest_time(*times: Column) -> Column:
    """The latest of the texts that are times; others are ignored."""
    parsed = [F.try_to_timestamp(t) for t in times]
    return F.greatest(*parsed)


def epoch_micros(t: Column) -> Column:
    return F.unix_micros(t)


def iso_micros(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def stale_days(as_of: Column, today: Column, most: int) -> Column:
    return F.datediff(today, as_of) > most


def wilson(successes: Column, n: Column) -> Column:
    """95 % score interval as a struct low, high; null for no trials."""
    z = 1.959963984540054
    p = successes / n
    mid, half, d = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)), 1 + z * z / n
    return F.when(n > 0, F.struct(F.greatest((mid - half) / d, F.lit(0.0)).alias("low"), F.least((mid + half) / d, F.lit(1.0)).alias("high")))


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.75, "critical").when(score >= 0.5, "high").when(score >= 0.25, "medium").otherwise("low")


def noisy_or(values: Column) -> Column:
    """1 - prod(1 - x) over an array."""
    return 1 - F.aggregate(values, F.lit(1.0), lambda p, x: p * (1 - x))


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Similarity of arrays as sets; `empty` where both are."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, empty).otherwise(F.size(F.array_intersect(a, b)) / union)
