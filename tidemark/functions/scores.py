"""Classes and scores. Constants are pre-registered, not tuned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GROWTH, DECLINE, SEASONAL = 1.5, 1 / 1.5, 2.0
VOLUME_TOP, SEASONAL_TOP = 1_000_000.0, 100.0
#: anomaly, volume, freshness; trend, seasonal, window, stability.
RANK_WEIGHTS, PURCHASE_WEIGHTS = (0.5, 0.3, 0.2), (0.4, 0.2, 0.2, 0.2)
#: Display order and labels of the classes.
CLASSES = ("GROWING", "SEASONAL", "FALLING", "STABLE")
LABELS_RU = ("растёт", "сезонное", "падает", "стабильное")
LABELS_ZH = ("增长", "季节性", "下降", "平稳")


def classify(score: Column, amplitude: Column) -> Column:
    """NaN never passes a threshold."""
    s, a = F.nanvl(score, F.lit(None).cast("double")), F.nanvl(amplitude, F.lit(None).cast("double"))
    return F.when(s >= GROWTH, "GROWING").when(s <= DECLINE, "FALLING").when(a >= SEASONAL, "SEASONAL").otherwise("STABLE")


def class_order(klass: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CLASSES)), klass).cast("int") - 1


def class_label(klass: Column, labels: tuple[str, ...] = LABELS_RU) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in zip(CLASSES, labels) for x in p]), klass)


def anomaly(score: Column) -> Column:
    return 1 - F.try_divide(F.lit(1.0), score)


def volume(base: Column) -> Column:
    return F.least(F.log10(1 + base) / F.log10(F.lit(1 + VOLUME_TOP)), F.lit(1.0))


def freshness(age: Column) -> Column:
    return F.lit(1.0) / F.coalesce(age, F.lit(1))


def rank_score(klass: Column, score: Column, base: Column, age: Column) -> Column:
    a, v, f = RANK_WEIGHTS
    return F.when(klass == "GROWING", a * anomaly(score) + v * volume(base) + f * freshness(age)).otherwise(F.lit(0.0))


def seasonal_component(amplitude: Column) -> Column:
    return F.when(amplitude < SEASONAL, F.lit(0.0)).otherwise(F.least(F.log10(amplitude) / F.log10(F.lit(SEASONAL_TOP)), F.lit(1.0)))


def window_component(on_time: Column) -> Column:
    return F.coalesce(on_time.cast("double"), F.lit(0.0))


def stability_component(klass: Column, age: Column, filtered_share: Column) -> Column:
    steady = 1 - filtered_share
    return F.when((klass == "GROWING") & age.isNotNull(), steady / age).otherwise(steady)


def purchase_score(trend: Column, seasonal: Column, window: Column, stability: Column) -> Column:
    return sum((w * c for w, c in zip(PURCHASE_WEIGHTS[1:], (seasonal, window, stability))), PURCHASE_WEIGHTS[0] * trend)


def pearson(x: str, y: str) -> Column:
    """Aggregate: correlation, NULL if either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def zscores(values: Column) -> Column:
    """Array of (x - mean) / population deviation; zeros if constant or with undefined parts."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    good = F.coalesce(var > 0, F.lit(False)) & ~F.exists(values, lambda x: x.isNull() | F.isnan(x))
    return F.transform(values, lambda x: F.when(good, (x - mean) / F.sqrt(var)).otherwise(F.lit(0.0)))


def unstable(*breaches: Column) -> Column:
    """True if any limit is broken or could not be measured."""
    out = F.lit(False)
    for b in breaches:
        out = out | F.coalesce(b, F.lit(True))
    return out
