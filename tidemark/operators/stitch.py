"""Stitching overlapping windows of one series, and the checks around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import month_key

MIN_OVERLAP = 2


def overlap_mismatch(windows: DataFrame) -> DataFrame:
    """phrase, period, lo, hi of the months for which windows disagree; windows: phrase, window_id, period, queries."""
    g = windows.groupBy("phrase", "period").agg(F.min("queries").alias("lo"), F.max("queries").alias("hi"))
    return g.where("lo <> hi")


def stitch_union(windows: DataFrame) -> DataFrame:
    """phrase, period, queries: every month once; months on which windows disagree are left out."""
    g = windows.groupBy("phrase", "period").agg(F.min("queries").alias("queries"), F.max("queries").alias("_hi"))
    return g.where("queries = _hi").drop("_hi")


def reached(windows: DataFrame, min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """phrase, window_id, in_reach: whether a window hangs together with the earliest one.

    What is in reach grows only, so the order in which windows are attached does not matter: as often as there are
    windows, all that share min_overlap months with what is in reach join it. A phrase has a few windows of at
    most some hundred months, so they stand in one row.
    """
    months = windows.groupBy("phrase", "window_id").agg(F.array_sort(F.collect_set(month_key(F.col("period")))).alias("months"))
    one = months.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct(F.get("months", F.lit(0)).alias("first"), "window_id", "months"))).alias("w"))
    shares = lambda m, u: F.size(F.array_intersect(m, u)) >= min_overlap
    grow = lambda u, _: F.array_union(u, F.flatten(F.transform(F.filter("w", lambda x: shares(x["months"], u)), lambda x: x["months"])))
    whole = one.withColumn("u", F.aggregate(F.slice("w", 2, F.size("w")), F.get("w", F.lit(0))["months"], grow))
    flags = F.transform("w", lambda x, i: F.struct(x["window_id"].alias("window_id"), ((i == 0) | shares(x["months"], F.col("u"))).alias("in_reach")))
    return whole.select("phrase", F.explode(flags).alias("f")).select("phrase", "f.*")


def stitch(windows: DataFrame, min_overlap: int = MIN_OVERLAP, expected_from: str | None = None, expected_to: str | None = None) -> DataFrame:
    """phrase, period, queries, error: the series of each phrase, or one row with its error.

    The months of a series are in order. 'mismatch' if a window contradicts itself or two windows in reach of the earliest one disagree; else 'gap' if a window is
    out of reach, a month is missing, or the series does not cover the expected months (first days, as text).
    """
    w = windows.select("phrase", "window_id", "period", "queries")
    bounds = F.min("queries").alias("lo"), F.max("queries").alias("hi")
    inside = w.groupBy("phrase", "window_id", "period").agg(*bounds).groupBy("phrase").agg(F.max(F.col("lo") != F.col("hi")).alias("own"))
    reach = reached(w, min_overlap)
    lost = reach.groupBy("phrase").agg((~F.min("in_reach")).alias("lost"))
    months = w.join(reach.where("in_reach"), ["phrase", "window_id"]).groupBy("phrase", "period").agg(*bounds)
    short = lambda day, found, sign: F.lit(False) if day is None else sign * (month_key(F.lit(day).cast("date")) - month_key(found)) > 0
    per = months.groupBy("phrase").agg(
        F.max(F.col("lo") != F.col("hi")).alias("differ"),
        (F.count(F.lit(1)) <= month_key(F.max("period")) - month_key(F.min("period"))).alias("hole"),
        (short(expected_from, F.min("period"), -1) | short(expected_to, F.max("period"), 1)).alias("short"),
    )
    error = F.when(F.col("own") | F.col("differ"), "mismatch").when(F.col("lost") | F.col("hole") | F.col("short"), "gap")
    verdict = per.join(inside, "phrase").join(lost, "phrase").select("phrase", error.alias("error"))
    good = months.join(verdict.where("error IS NULL"), "phrase").select("phrase", "period", F.col("lo").alias("queries"), "error")
    good = good.repartition("phrase").sortWithinPartitions("phrase", "period")
    return good.unionByName(verdict.where("error IS NOT NULL").select("phrase", F.lit(None).cast("date").alias("period"), F.lit(None).cast("bigint").alias("queries"), "error"))
