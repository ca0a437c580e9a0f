"""Seasonal vectors of phrases: blocks, their comparison, neighbours across refits.

A vector table is long: phrase, block ('sp7' or 'sp12'), pos, value. A block whose values are constant,
missing or undefined does not count as measured: similarities with it are NULL, never 0 or 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scores import pearson

BLOCKS = ("sp7", "sp12")


def blocks(weekday: DataFrame, month: DataFrame) -> DataFrame:
    """One long table from phrase, pos, value tables of weekdays and months."""
    one = lambda d, name: d.select("phrase", F.lit(name).alias("block"), F.col("pos").cast("int").alias("pos"), F.col("value").cast("double").alias("value"))
    return one(weekday, "sp7").unionByName(one(month, "sp12"))


def zblocks(vectors: DataFrame) -> DataFrame:
    """vectors with z (value minus block mean over population deviation; NULL if undefined)."""
    by = Window.partitionBy("phrase", "block")
    bad = F.max((F.col("value").isNull() | F.isnan("value")).cast("int")).over(by) == 1
    z = F.try_divide(F.col("value") - F.avg("value").over(by), F.nullif(F.stddev_pop("value").over(by), F.lit(0.0)))
    return vectors.withColumn("z", F.when(~bad, z))


def similarities(vectors: DataFrame) -> DataFrame:
    """a, b, sp7, sp12, combined: Pearson over each block, and over both if all four blocks are defined."""
    z = zblocks(vectors).where("z IS NOT NULL")
    left = z.select(F.col("phrase").alias("a"), "block", "pos", F.col("z").alias("x"))
    right = z.select(F.col("phrase").alias("b"), "block", "pos", F.col("z").alias("y"))
    both = left.join(right, ["block", "pos"]).where("a < b")
    per = both.groupBy("a", "b", "block").agg(pearson("x", "y").alias("s"))
    one = per.groupBy("a", "b").agg(*[F.max(F.when(F.col("block") == k, F.col("s"))).alias(k) for k in BLOCKS])
    whole = both.groupBy("a", "b").agg(F.count_distinct("block").alias("_n"), pearson("x", "y").alias("_c"))
    names = vectors.select("phrase").distinct()
    pairs = names.select(F.col("phrase").alias("a"), F.lit(1).alias("_k")).join(names.select(F.col("phrase").alias("b"), F.lit(1).alias("_k")), "_k").where("a < b").drop("_k")
    out = pairs.join(one, ["a", "b"], "left").join(whole, ["a", "b"], "left")
    return out.select("a", "b", *BLOCKS, F.when(F.col("_n") == len(BLOCKS), F.col("_c")).alias("combined"))


def neighbours(similar: DataFrame, kind: str = "combined") -> DataFrame:
    """phrase, neighbour, sim: the most similar phrase by one representation; NULL where none is defined."""
    both = similar.select(F.col("a").alias("phrase"), F.col("b").alias("other"), F.col(kind).alias("s")).union(similar.select("b", "a", kind))
    key = F.struct(F.round("s", 9).alias("s"))
    top = both.where("s IS NOT NULL").withColumn("_k", key).groupBy("phrase").agg(F.max("_k").alias("_m"))
    best = both.join(top, "phrase").where(F.round("s", 9) == F.col("_m.s")).groupBy("phrase").agg(F.min("other").alias("neighbour"), F.max("s").alias("sim"))
    return both.select("phrase").distinct().join(best, "phrase", "left")


def preserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """phrase, preserved, undefined_in_both, undefined_in_either between two neighbour tables."""
    d = before.select("phrase", F.col("neighbour").alias("x")).join(after.select("phrase", F.col("neighbour").alias("y")), "phrase")
    same = F.coalesce(F.col("x") == F.col("y"), F.lit(False))
    return d.select("phrase", same.alias("preserved"), (F.col("x").isNull() & F.col("y").isNull()).alias("undefined_in_both"), (F.col("x").isNull() | F.col("y").isNull()).alias("undefined_in_either"))


def fingerprint(similar: DataFrame, kind: str = "combined") -> DataFrame:
    """One row, pairs: from the most to the least similar, undefined ones last."""
    pair = F.concat_ws(" <-> ", "a", "b")
    rows = F.array_sort(F.collect_list(F.struct(F.col(kind).isNull().alias("u"), (-F.round(kind, 9)).alias("s"), pair.alias("p"))))
    return similar.agg(F.transform(rows, lambda x: x["p"]).alias("pairs"))


def discrimination(vectors: DataFrame) -> DataFrame:
    """phrase, block, range, std, argmax (from 1, the first), max of each block."""
    return vectors.groupBy("phrase", "block").agg(
        (F.max("value") - F.min("value")).alias("range"), F.stddev_pop("value").alias("std"), F.max_by("pos", F.struct("value", -F.col("pos"))).alias("argmax"), F.max("value").alias("top")
    )


def compare_profiles(before: DataFrame, after: DataFrame) -> DataFrame:
    """phrase, corr, mae, mae_rel of two profile tables (phrase, pos, value); mae_rel is over the range of the first."""
    d = before.select("phrase", "pos", F.col("value").alias("x")).join(after.select("phrase", "pos", F.col("value").alias("y")), ["phrase", "pos"])
    g = d.groupBy("phrase").agg(pearson("x", "y").alias("corr"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mae"), (F.max("x") - F.min("x")).alias("_r"))
    return g.select("phrase", "corr", "mae", F.try_divide("mae", F.nullif("_r", F.lit(0.0))).alias("mae_rel"))


def cycle_agreement(monthly: DataFrame, sp: int = 12) -> DataFrame:
    """phrase, corr, mae, mae_rel of the last two cycles of each series; series of less than two cycles are left out."""
    rn = F.row_number().over(Window.partitionBy("phrase").orderBy(F.desc("period"))) - 1
    d = monthly.select("phrase", F.col("queries").cast("double").alias("value"), rn.alias("rn")).where(F.col("rn") < 2 * sp)
    full = d.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 2 * sp).select("phrase")
    d = d.join(full, "phrase", "left_semi").withColumn("pos", F.col("rn") % sp)
    return compare_profiles(d.where(F.col("rn") >= sp), d.where(F.col("rn") < sp))
