"""Statistics as columns: Wilson and finite-population intervals, vectors, classes of stars and labels."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.959963984540054
FPC_ABOVE = 0.05
LABELS = ("negative", "neutral", "positive")
INTERVAL = "struct<low:double,high:double,reason:string>"


def interval(low: Column, high: Column, reason: Column) -> Column:
    return F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"), reason.cast("string").alias("reason"))


def wilson(k: Column, n: Column) -> Column:
    """Two-sided 95 % Wilson interval without correction, exactly 0 and 1 at the ends; null for n <= 0."""
    m = F.when(n > 0, n.cast("double"))
    p = k / m
    down = 1 + Z * Z / m
    centre = (p + Z * Z / (2 * m)) / down
    half = Z * F.sqrt((p * (1 - p) + Z * Z / (4 * m)) / m) / down
    low = F.when(k <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half))
    high = F.when(k >= n, 1.0).otherwise(F.least(F.lit(1.0), centre + half))
    return F.when(n > 0, interval(low, high, F.lit(None)))


def wilson_summary(k: Column, n: Column) -> Column:
    """Struct successes, n, value, low, high; null ends and value for n = 0."""
    w = wilson(k, n)
    return F.struct(k.alias("successes"), n.alias("n"), share(k, n).alias("value"), w["low"].alias("low"), w["high"].alias("high"))


def shrink(low: Column, high: Column, centre: Column, n: Column, population: Column) -> tuple[Column, Column]:
    """Both ends drawn to the centre where the sample is over 5 % of a population."""
    by = F.when((population > 1) & (n / population > FPC_ABOVE), F.sqrt(F.greatest(F.lit(0.0), (population - n) / (population - 1)))).otherwise(F.lit(1.0))
    return centre - (centre - low) * by, centre + (high - centre) * by


def proportion(k: Column, n: Column, population: Column) -> Column:
    """Interval of a share; null ends and a reason without rows and for a census."""
    w = wilson(k, n)
    low, high = shrink(w["low"], w["high"], k / F.nullif(n, F.lit(0)), n, population)
    reason = F.when(n == 0, "no_reviews").when(n == population, "census")
    low, high = F.greatest(F.lit(0.0), low), F.least(F.lit(1.0), high)
    return interval(F.when(reason.isNull(), low), F.when(reason.isNull(), high), reason)


def share(k: Column, n: Column) -> Column:
    return F.try_divide(k, n)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector of length 1; the zero vector stays. Vector and length are names of functions, so that they are computed once, not for each component."""
    by = lambda a, size: F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0))
    return let(v, lambda a: let(F.sqrt(dot(a, a)), lambda size: by(a, size)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - the product of unit vectors, clamped at 0."""
    return F.greatest(F.lit(0.0), 1 - dot(a, b))


def star_class(stars: Column) -> Column:
    return F.when(stars <= 2, "negative").when(stars == 3, "neutral").when(stars >= 4, "positive")


def three_classes(scores: Column) -> Column:
    """Five class scores, from very negative to very positive, as a struct label and three sums; the first wins ties."""
    sums = [scores[0] + scores[1], scores[2], scores[3] + scores[4]]
    best = F.greatest(*sums)
    label = reduce(lambda c, i: c.when(sums[i] == best, LABELS[i]), (1, 2), F.when(sums[0] == best, LABELS[0]))
    return F.struct(label.alias("label"), *[s.alias(n) for s, n in zip(sums, LABELS, strict=True)])


def same_issue(label: Column) -> Column:
    """True or false of a label's spelling; any other raises an error."""
    l = F.lower(F.trim(label))
    return F.when(l.isin("1", "true", "yes", "same", "same_issue"), True).when(l.isin("0", "false", "no", "different", "different_issue"), False).otherwise(F.raise_error(F.concat(F.lit("not a label: "), F.coalesce(label, F.lit("null")))).cast("boolean"))


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)
