"""Daily signals: weekday profiles, balance and spikes against leave-one-week-out expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPIKE, FULL_WEEK = 1.5, 7


def full_weeks(daily: DataFrame) -> DataFrame:
    """Rows of Monday-to-Sunday weeks with seven days and a mean above 0, with week, weekday, share."""
    d = daily.withColumns({"week": F.date_trunc("week", "day").cast("date"), "weekday": F.weekday("day")})
    w = Window.partitionBy("phrase", "week")
    d = d.withColumns({"_n": F.count(F.lit(1)).over(w), "week_sum": F.sum("count").over(w)})
    d = d.where((F.col("_n") == FULL_WEEK) & (F.col("week_sum") != 0))
    return d.withColumn("share", F.col("count") * FULL_WEEK / F.col("week_sum")).drop("_n")


def weekday_profile(daily: DataFrame) -> DataFrame:
    """phrase, weekday (0 is Monday), profile: mean share over full weeks, scaled to a mean of 1."""
    p = full_weeks(daily).groupBy("phrase", "weekday").agg(F.avg("share").alias("p"))
    return p.withColumn("profile", F.col("p") / F.avg("p").over(Window.partitionBy("phrase"))).drop("p")


def empirical_weekday_profile(daily: DataFrame) -> DataFrame:
    """The same from plain means of all days."""
    p = daily.groupBy("phrase", F.weekday("day").alias("weekday")).agg(F.avg("count").alias("p"))
    return p.withColumn("profile", F.try_divide("p", F.avg("p").over(Window.partitionBy("phrase")))).drop("p")


def weekday_balance(daily: DataFrame) -> DataFrame:
    """phrase, balanced: as many days of each weekday, no day twice and none missing."""
    n = daily.groupBy("phrase", F.weekday("day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    n = n.groupBy("phrase").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count(F.lit(1)).alias("k"))
    long = F.datediff(F.max("day"), F.min("day")) + 1
    span = daily.groupBy("phrase").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("day").alias("days"), long.alias("long"))
    even = (F.col("a") == F.col("b")) & (F.col("k") == FULL_WEEK) & (F.col("rows") == F.col("days")) & (F.col("days") == F.col("long"))
    return n.join(span, "phrase").select("phrase", even.alias("balanced"))


def detect_spikes(daily: DataFrame, threshold: float = SPIKE) -> DataFrame:
    """phrase, day, count, expected, ratio of the days at or above threshold times what the rest suggests.

    Expected is the level of the week's other days times the weekday's mean share in the other weeks.
    Phrases with fewer than two full weeks are left out.
    """
    d = full_weeks(daily)
    by_day = Window.partitionBy("phrase", "weekday")
    weeks = F.count(F.lit(1)).over(by_day)
    d = d.withColumn("_others", F.when(weeks > 1, (F.sum("share").over(by_day) - F.col("share")) / (weeks - 1)))
    d = d.withColumn("expected", (F.col("week_sum") - F.col("count")) / (FULL_WEEK - 1) * F.col("_others"))
    d = d.where("expected > 0").withColumn("ratio", F.col("count") / F.col("expected"))
    return d.where(F.col("ratio") >= threshold).select("phrase", "day", "count", "expected", "ratio")


def short_term_report(daily: DataFrame, last_days: int = 7, threshold: float = SPIKE) -> DataFrame:
    """phrase, measured_through, threshold, n_days, spikes (recent, largest ratio first)."""
    span = daily.groupBy("phrase").agg(F.max("day").alias("measured_through"), F.count(F.lit(1)).alias("n_days"))
    s = detect_spikes(daily, threshold).join(span.select("phrase", "measured_through"), "phrase").where(F.col("day") > F.date_sub("measured_through", last_days))
    s = s.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct((-F.col("ratio")).alias("o"), "day", F.round("ratio", 3).alias("ratio")))).alias("s"))
    none = F.array().cast("array<struct<day:date,ratio:double>>")
    spikes = F.coalesce(F.transform("s", lambda x: F.struct(x["day"].alias("day"), x["ratio"].alias("ratio"))), none)
    return span.join(s, "phrase", "left").select("phrase", "measured_through", F.lit(threshold).alias("threshold"), "n_days", spikes.alias("spikes"))


def autocorrelation(daily: DataFrame, lags: int = 14) -> DataFrame:
    """phrase, lag, acf of each series."""
    by = Window.partitionBy("phrase")
    d = daily.withColumns({"_x": F.col("count") - F.avg("count").over(by), "_i": F.row_number().over(by.orderBy("day")), "_v": F.count(F.lit(1)).over(by)})
    c0 = d.groupBy("phrase").agg(F.sum(F.col("_x") * F.col("_x")).alias("c0"), F.count(F.lit(1)).alias("n"))
    pairs = d.select("phrase", "_i", "_x", F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"))
    right = d.select("phrase", F.col("_i").alias("_j"), F.col("_x").alias("_y"))
    p = pairs.withColumn("_j", F.col("_i") + F.col("lag")).join(right, ["phrase", "_j"]).groupBy("phrase", "lag").agg(F.sum(F.col("_x") * F.col("_y")).alias("ck"))
    return p.join(c0, "phrase").select("phrase", "lag", F.try_divide("ck", F.nullif("c0", F.lit(0.0))).alias("acf"), "n")


def ljung_box(daily: DataFrame, lags: int = 14) -> DataFrame:
    """phrase, lag, q: Ljung-Box statistic up to each lag."""
    a = autocorrelation(daily, lags).withColumn("_t", F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag")))
    upto = Window.partitionBy("phrase").orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    return a.select("phrase", "lag", (F.col("n") * (F.col("n") + 2) * F.sum("_t").over(upto)).alias("q"))
