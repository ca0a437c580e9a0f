"""Monthly and daily series: building, checking, profiles, growth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import month_key, month_start

MIN_HISTORY, SCORE_WINDOW, SEASON = 24, 3, 12
GROWTH_STEP = 1.5


class BacktestError(ValueError):
    """A backtest that cannot be run or summed up honestly: no series, one too short for a fold, no baseline."""


def monthly_counts(rows: DataFrame, phrase, ts, before: str | None = None) -> DataFrame:
    """phrase, period, queries: rows per key and month, up to (not including) a day."""
    src = rows.select(phrase.alias("phrase"), ts.cast("date").alias("_d"))
    if before:
        src = src.where(F.col("_d") < F.lit(before).cast("date"))
    return src.groupBy("phrase", month_start(F.col("_d")).alias("period")).agg(F.count(F.lit(1)).alias("queries"))


def daily_counts(rows: DataFrame, phrase, ts) -> DataFrame:
    """phrase, day, count (double)."""
    return rows.groupBy(phrase.alias("phrase"), ts.cast("date").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("count"))


def fill_months(monthly: DataFrame) -> DataFrame:
    """Months without a row become 0, between the first and last month of each phrase."""
    span = monthly.groupBy("phrase").agg(F.min("period").alias("a"), F.max("period").alias("b"))
    grid = span.select("phrase", F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("period"))
    return grid.join(monthly, ["phrase", "period"], "left").select("phrase", "period", F.coalesce("queries", F.lit(0)).alias("queries"))


def month_continuity(monthly: DataFrame) -> DataFrame:
    """Breaches of one row per month: check is 'duplicate' or 'gap', missing counts the months left out."""
    k = monthly.select("phrase", "period", month_key(F.col("period")).alias("k"))
    step = F.col("k") - F.lag("k").over(Window.partitionBy("phrase").orderBy("k"))
    k = k.withColumn("step", step).where(F.col("step") != 1)
    return k.select("phrase", "period", F.when(F.col("step") == 0, "duplicate").otherwise("gap").alias("check"), F.greatest(F.col("step") - 1, F.lit(0)).cast("bigint").alias("missing"))


def day_continuity(daily: DataFrame) -> DataFrame:
    """The same for days."""
    step = F.datediff("day", F.lag("day").over(Window.partitionBy("phrase").orderBy("day")))
    d = daily.withColumn("step", step).where(F.col("step") != 1)
    return d.select("phrase", "day", F.when(F.col("step") == 0, "duplicate").otherwise("gap").alias("check"), F.greatest(F.col("step") - 1, F.lit(0)).cast("bigint").alias("missing"))


def monthly_profile(monthly: DataFrame) -> DataFrame:
    """phrase, month, mean over all years."""
    return monthly.groupBy("phrase", F.month("period").alias("month")).agg(F.avg(F.col("queries").cast("double")).alias("mean"))


def seasonal_amplitude(monthly: DataFrame) -> DataFrame:
    """phrase, amplitude: largest over smallest month mean; 0 if that is not positive."""
    p = monthly_profile(monthly).groupBy("phrase").agg(F.max("mean").alias("hi"), F.min("mean").alias("lo"))
    return p.select("phrase", F.when(F.col("lo") <= 0, F.lit(0.0)).otherwise(F.col("hi") / F.col("lo")).alias("amplitude"))


def peak_month(monthly: DataFrame) -> DataFrame:
    """phrase, peak: month of the largest mean (the earlier one on ties); NULL for short or flat series."""
    n = monthly.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    top = monthly_profile(monthly).groupBy("phrase").agg(F.max_by("month", F.struct("mean", -F.col("month"))).alias("top"))
    seasonal = (F.col("n") >= MIN_HISTORY) & (F.col("amplitude") >= 2.0)
    return top.join(n, "phrase").join(seasonal_amplitude(monthly), "phrase").select("phrase", F.when(seasonal, F.col("top")).alias("peak"))


def growth_score(monthly: DataFrame, window: int = SCORE_WINDOW, forecaster=None) -> DataFrame:
    """phrase, score, is_growth, forecast, actual, base: last months against the seasonal-naive forecast.

    forecast repeats the season before the window, or is the mean of forecaster(values before the window, window),
    called once for each series in a grouped pandas function (those of forecast.MODELS fit). base is the mean before the window. Series that
    are too short, have NULL months or no positive forecast are left out: see growth_violations().
    """
    if window < 1:
        raise ValueError("the window must be positive")
    w = Window.partitionBy("phrase").orderBy(F.desc("period"))
    q = F.col("queries").cast("double")
    n = monthly.select("phrase", "period", q.alias("q"), F.row_number().over(w).alias("rn"))
    # position h of the forecast repeats rn = window + 12 - (h - 1) % 12, so far back h = 1 is oldest
    hits = [window + SEASON - (h % SEASON) for h in range(window)]
    back = sum((F.when(F.col("rn") == r, F.col("q")).otherwise(0.0) for r in hits[1:]), F.when(F.col("rn") == hits[0], F.col("q")).otherwise(0.0))
    agg = n.groupBy("phrase").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("q").isNull() | F.isnan("q")).alias("bad"),
        (F.sum(F.when(F.col("rn") <= window, F.col("q"))) / window).alias("actual"),
        (F.sum(back) / window).alias("forecast"),
        F.avg(F.when(F.col("rn") > window, F.col("q"))).alias("base"),
    )
    if forecaster is not None:
        agg = agg.drop("forecast").join(_forecast_means(monthly, window, forecaster), "phrase")
    ok = agg.where((F.col("n") >= F.greatest(F.lit(MIN_HISTORY), F.lit(window + SEASON))) & (F.col("bad") == 0) & (F.col("forecast") > 0))
    return ok.select("phrase", (F.col("actual") / F.col("forecast")).alias("score"), (F.col("actual") / F.col("forecast") >= GROWTH_STEP).alias("is_growth"), "forecast", "actual", "base")


def _forecast_means(monthly: DataFrame, window: int, forecaster) -> DataFrame:
    """phrase, forecast: the mean forecast of the window; NULL for series that are too short or have a month without value."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        y = g.sort_values("period")["q"].to_numpy(float)
        fit = len(y) >= max(MIN_HISTORY, window + SEASON) and np.isfinite(y).all()
        return pd.DataFrame({"phrase": [key[0]], "forecast": [float(np.mean(forecaster(y[:-window], window))) if fit else None]})

    return monthly.select("phrase", "period", F.col("queries").cast("double").alias("q")).groupBy("phrase").applyInPandas(run, "phrase string, forecast double")


def growth_violations(monthly: DataFrame, window: int = SCORE_WINDOW) -> DataFrame:
    """phrase, check of the series that cannot be scored; the first failing guard, in the reference order."""
    agg = monthly.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("queries").isNull() | F.isnan(F.col("queries").cast("double"))).alias("bad"))
    scored = growth_score(monthly, window).select("phrase", F.lit(True).alias("ok"))
    check = (
        F.when(F.col("n") - SEASON < window, "window").when(F.col("n") < MIN_HISTORY, "history").when(F.col("bad") > 0, "null").otherwise("forecast")
    )
    return agg.join(scored, "phrase", "left").where("ok IS NULL").select("phrase", check.alias("check"))


def growth_age(monthly: DataFrame) -> DataFrame:
    """phrase, age: months at the end of the series in a row that are 1.5 times the year before; NULL if none."""
    by = Window.partitionBy("phrase").orderBy("period")
    q = F.col("queries").cast("double")
    d = monthly.select("phrase", "period", q.alias("q"), F.lag(q, SEASON).over(by).alias("ago"))
    d = d.withColumn("rn", F.row_number().over(Window.partitionBy("phrase").orderBy(F.desc("period"))))
    ok = F.coalesce((F.col("ago") > 0) & (F.col("q") >= GROWTH_STEP * F.col("ago")), F.lit(False))
    run = F.coalesce(F.min(F.when(~ok, F.col("rn"))) - 1, F.count(F.lit(1)))
    return d.groupBy("phrase").agg(F.nullif(run.cast("int"), F.lit(0)).alias("age"))


def truncate_tail(monthly: DataFrame, k: int) -> DataFrame:
    """Drop the last k points of each series."""
    w = Window.partitionBy("phrase").orderBy(F.desc("period"))
    return monthly.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") > k).drop("_rn")


def suffix_days(daily: DataFrame, days: int) -> DataFrame:
    """The last days of each series, whole weeks only."""
    if days % 7:
        raise ValueError("the window must be whole weeks")
    w = Window.partitionBy("phrase").orderBy(F.desc("day"))
    return daily.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= days).drop("_rn")


def expanding_folds(monthly: DataFrame, initial: int = 72, step: int = 12, test: int = 12) -> DataFrame:
    """phrase, fold, idx, period, queries, part: rows of each expanding-window fold, 'train' or 'test'."""
    idx = F.row_number().over(Window.partitionBy("phrase").orderBy("period")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy("phrase"))
    d = monthly.withColumn("idx", idx).withColumn("_n", n)
    last = F.floor((F.col("_n") - test - initial) / F.lit(step))
    d = d.withColumn("fold", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last.cast("int"))).otherwise(F.array().cast("array<int>"))))
    cutoff = F.lit(initial) + F.col("fold") * step
    d = d.where(F.col("idx") < cutoff + test)
    return d.select("phrase", "fold", "idx", "period", "queries", F.when(F.col("idx") < cutoff, "train").otherwise("test").alias("part"))


def seasonal_naive(folds: DataFrame) -> DataFrame:
    """Test rows of each fold with forecast: the value a season before, repeated beyond one season."""
    cut = folds.where("part = 'train'").groupBy("phrase", "fold").agg(F.max("idx").alias("last"))
    test = folds.where("part = 'test'").join(cut, ["phrase", "fold"])
    source = F.col("last") - SEASON + 1 + (F.col("idx") - F.col("last") - 1) % SEASON
    train = folds.where("part = 'train'").select("phrase", "fold", F.col("idx").alias("source"), F.col("queries").cast("double").alias("forecast"))
    return test.withColumn("source", source).join(train, ["phrase", "fold", "source"]).select("phrase", "fold", "idx", "period", F.col("queries").cast("double").alias("actual"), "forecast")


def mase(folds: DataFrame, forecasts: DataFrame) -> DataFrame:
    """phrase, fold, mase: mean absolute error over the lag-1 naive error on the training part."""
    lag = F.lag(F.col("queries").cast("double")).over(Window.partitionBy("phrase", "fold").orderBy("idx"))
    scale = folds.where("part = 'train'").withColumn("_e", F.abs(F.col("queries") - lag)).groupBy("phrase", "fold").agg(F.avg("_e").alias("scale"))
    err = forecasts.groupBy("phrase", "fold").agg(F.avg(F.abs(F.col("actual") - F.col("forecast"))).alias("mae"))
    return err.join(scale, ["phrase", "fold"]).select("phrase", "fold", F.try_divide("mae", "scale").alias("mase"))


def backtest_summary(table: DataFrame, baseline: str) -> DataFrame:
    """model, mase_median, win_rate_vs_baseline, n_phrases over phrase, model, mase_median, n_folds.

    Running it fails if the table is empty, or if a phrase has no row of the baseline: its share of wins is not defined.
    """
    if table.limit(1).count() == 0:
        raise BacktestError("an empty backtest table")
    base = table.where(F.col("model") == baseline).select("phrase", F.col("mase_median").alias("_b"), F.lit(1).alias("_p"))
    joined = table.join(base, "phrase", "left")
    orphan = F.concat(F.lit(f"no row of {baseline} for "), F.col("phrase"))
    joined = joined.withColumn("_b", F.when(F.col("_p").isNull(), F.raise_error(orphan).cast("double")).otherwise(F.col("_b"))).drop("_p")
    win = F.avg(F.when(F.col("mase_median") < F.col("_b"), 1.0).otherwise(0.0))
    return joined.groupBy("model").agg(F.median("mase_median").alias("mase_median"), win.alias("win_rate_vs_baseline"), F.count(F.lit(1)).alias("n_phrases"))


def eda_summary(monthly: DataFrame) -> DataFrame:
    """Count, range, median, variation, outliers by the 1.5 IQR rule, for each phrase."""
    q = F.col("queries").cast("double")
    s = monthly.groupBy("phrase").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(q).alias("lo"),
        F.max(q).alias("hi"),
        F.median(q).alias("median"),
        F.try_divide(F.stddev_samp(q), F.avg(q)).alias("cv"),
        F.percentile(q, F.lit(0.25)).alias("q1"),
        F.percentile(q, F.lit(0.75)).alias("q3"),
    )
    width = 1.5 * (F.col("q3") - F.col("q1"))
    out = monthly.join(s.select("phrase", (F.col("q1") - width).alias("_a"), (F.col("q3") + width).alias("_b")), "phrase")
    out = out.groupBy("phrase").agg(F.count_if((q < F.col("_a")) | (q > F.col("_b"))).alias("outliers"))
    return s.join(out, "phrase").withColumn("max_min", F.try_divide("hi", F.nullif("lo", F.lit(0.0))))


def quarter_means(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy("phrase", F.quarter("period").alias("quarter")).agg(F.avg(F.col("queries").cast("double")).alias("mean"))


def year_over_year(monthly: DataFrame) -> DataFrame:
    """phrase, corr of each month with the same month a year before; NULL if constant."""
    from tidemark.functions.scores import pearson

    ago = F.lag(F.col("queries").cast("double"), SEASON).over(Window.partitionBy("phrase").orderBy("period"))
    d = monthly.select("phrase", F.col("queries").cast("double").alias("x"), ago.alias("y")).where("y IS NOT NULL")
    return d.groupBy("phrase").agg(pearson("x", "y").alias("corr"))


def duplicate_phrases(runs: DataFrame) -> DataFrame:
    """phrase, runs of phrases that more than one run folder claims; runs: phrase, run_dir."""
    return runs.groupBy("phrase").agg(F.count_distinct("run_dir").alias("runs")).where("runs > 1")
