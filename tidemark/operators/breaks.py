"""Structural breaks: deseasonalised log level, spike runs, level shifts, classes and handling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import month_key

PENALTY, MIN_SIZE, REVERT_HORIZON, REVERT_TOLERANCE = 1.0, 3, 2, 0.5
SPIKE_Z, SPIKE_FLOOR, LOCAL_WINDOW, PROFILE_WINDOW = 3.5, 0.3, 13, 12
#: What to do about each kind of break.
HANDLING = {"demand_transient": "keep", "demand_persistent": "dummy", "measurement": "truncate", "unresolved": "segment"}


def centered_median(df: DataFrame, x: str, before: int, after: int, out: str, order: str = "period") -> DataFrame:
    """Median over a full centred frame; at the edges the nearest full one is carried."""
    by = Window.partitionBy("phrase").orderBy(order)
    frame = by.rowsBetween(-before, after)
    full = F.count(F.lit(1)).over(frame) == before + after + 1
    d = df.withColumn("_m", F.when(full, F.percentile(x, F.lit(0.5)).over(frame)))
    ahead = F.first("_m", True).over(by.rowsBetween(0, Window.unboundedFollowing))
    behind = F.last("_m", True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn(out, F.coalesce(ahead, behind)).drop("_m")


def rolling_median(monthly: DataFrame) -> DataFrame:
    """phrase, period, queries, level: 12-month centred median of queries."""
    return centered_median(monthly.withColumn("_q", F.col("queries").cast("double")), "_q", 6, 5, "level").drop("_q")


def deseasonalize_log(monthly: DataFrame, key=None) -> DataFrame:
    """phrase, period, resid: log(1 + queries) minus the median deviation of its calendar month from the local level."""
    key = F.month("period") if key is None else key
    d = monthly.select("phrase", "period", F.log1p(F.col("queries").cast("double")).alias("_l"), key.alias("_key"))
    d = centered_median(d, "_l", 6, 5, "_level").withColumn("_dev", F.col("_l") - F.col("_level"))
    by = Window.partitionBy("phrase", "_key")
    profile = F.when(F.count("_dev").over(by) < 2, F.lit(0.0)).otherwise(F.coalesce(F.median("_dev").over(by), F.lit(0.0)))
    return d.withColumn("_p", profile).select("phrase", "period", (F.col("_l") - F.col("_p")).alias("resid"))


def local_deviation(resid: DataFrame) -> DataFrame:
    """resid with deviation from its 13-month centred median."""
    return centered_median(resid, "resid", 6, 6, "_level").withColumn("deviation", F.col("resid") - F.col("_level")).drop("_level")


def spike_flags(deviation: DataFrame, z: float = SPIKE_Z, floor: float = SPIKE_FLOOR) -> DataFrame:
    """deviation with spike: robust z beyond the threshold and far enough in absolute terms."""
    by = Window.partitionBy("phrase")
    d = deviation.withColumn("_med", F.median("deviation").over(by)).withColumn("_a", F.abs(F.col("deviation") - F.col("_med")))
    d = d.withColumn("_mad", F.median("_a").over(by))
    spike = (F.col("_mad") > 0) & (F.col("_a") / (1.4826 * F.nullif("_mad", F.lit(0.0))) > z) & (F.col("_a") >= floor)
    return d.withColumn("spike", F.coalesce(spike, F.lit(False))).drop("_med", "_a", "_mad")


def spike_runs(deviation: DataFrame) -> DataFrame:
    """phrase, start, length: runs of neighbouring spike months; start counts from 0."""
    idx = F.row_number().over(Window.partitionBy("phrase").orderBy("period")) - 1
    d = spike_flags(deviation).withColumn("idx", idx).where("spike")
    island = F.col("idx") - F.row_number().over(Window.partitionBy("phrase").orderBy("idx"))
    runs = d.withColumn("_i", island).groupBy("phrase", "_i").agg(F.min("idx").cast("bigint").alias("start"), F.count(F.lit(1)).alias("length"))
    return runs.drop("_i")


def replace_spikes(deviation: DataFrame) -> DataFrame:
    """phrase, period, resid, cleaned: spike months take the mean of the nearest others, one-sided at the edges."""
    by = Window.partitionBy("phrase").orderBy("period")
    d = spike_flags(deviation).withColumn("_v", F.when(~F.col("spike"), F.col("resid")))
    left = F.last("_v", True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first("_v", True).over(by.rowsBetween(1, Window.unboundedFollowing))
    mean = F.coalesce((left + right) / 2, left, right, F.col("resid"))
    return d.withColumn("cleaned", F.when(F.col("spike"), mean).otherwise(F.col("resid"))).drop("_v")


def level_shifts(x: np.ndarray, penalty: float = PENALTY, min_size: int = MIN_SIZE) -> list[int]:
    """Boundaries of the least-squares segmentation with a penalty for each, by exact dynamic programming."""
    n = len(x)
    if n < 2 * min_size:
        return []
    s, s2 = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * x)])
    best, came = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
    best[0] = -penalty
    for e in range(min_size, n + 1):
        a = np.arange(0, e - min_size + 1)
        total = s[e] - s[a]
        c = best[a] + (s2[e] - s2[a]) - total * total / (e - a) + penalty
        k = int(np.argmin(c))
        best[e], came[e] = c[k], a[k]
    out, e = [], n
    while came[e] > 0:
        e = came[e]
        out.append(int(e))
    return out[::-1]


def break_points(monthly: DataFrame, penalty: float = PENALTY, min_size: int = MIN_SIZE) -> DataFrame:
    """phrase, idx, at (last period before), next_period, delta of every level shift.

    delta compares everything after the boundary with the segment before it.
    """
    d = replace_spikes(local_deviation(deseasonalize_log(monthly))).select("phrase", "period", "cleaned")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("period")
        x, periods = g["cleaned"].to_numpy(dtype=float), g["period"].tolist()
        rows, start = [], 0
        for b in level_shifts(x, penalty, min_size):
            rows.append((g["phrase"].iloc[0], b, periods[b - 1], periods[b], float(x[b:].mean() - x[start:b].mean())))
            start = b
        return pd.DataFrame(rows, columns=["phrase", "idx", "at", "next_period", "delta"])

    return d.groupBy("phrase").applyInPandas(run, "phrase string, idx int, at date, next_period date, delta double")


def classify_breaks(monthly: DataFrame, seams: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """phrase, at, kind, delta, spike, reverted of all breaks; seams and events: phrase, period.

    A shock that is over within two months is transient; a lasting shift is one of measurement at a
    seam, of demand at an event (of its month or the month before), else unresolved.
    """
    dev = local_deviation(deseasonalize_log(monthly))
    idx = F.row_number().over(Window.partitionBy("phrase").orderBy("period")) - 1
    flags = spike_flags(dev).withColumn("idx", idx)
    empty = monthly.sparkSession.createDataFrame([], "phrase string, period date")
    seams, events = (seams or empty).distinct(), (events or empty).distinct()

    runs = spike_runs(dev)
    inside = runs.join(flags, "phrase").where((F.col("idx") >= F.col("start")) & (F.col("idx") < F.col("start") + F.col("length")))
    peak = inside.groupBy("phrase", "start").agg(F.max_by("deviation", F.struct(F.abs("deviation"), -F.col("idx"))).alias("delta"))
    before = flags.select("phrase", F.col("period").alias("at"), F.col("idx").cast("bigint").alias("_i"))
    spikes = peak.withColumn("_i", F.greatest(F.col("start") - 1, F.lit(0))).join(before, ["phrase", "_i"])
    spikes = spikes.select("phrase", "at", F.lit("demand_transient").alias("kind"), "delta", F.lit(True).alias("spike"), F.lit(True).alias("reverted"))

    shifts = break_points(monthly)
    by = Window.partitionBy("phrase").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    level = flags.withColumn("before", F.avg("resid").over(by)).select("phrase", "idx", "before")
    near = flags.where("NOT spike").select("phrase", F.col("idx").alias("t"), "resid")
    s = shifts.join(level, ["phrase", "idx"])
    back = s.join(near, "phrase").where((F.col("t") >= F.col("idx")) & (F.col("t") < F.col("idx") + REVERT_HORIZON))
    back = back.where(F.abs(F.col("resid") - F.col("before")) <= REVERT_TOLERANCE * F.abs("delta")).select("phrase", "idx").distinct().withColumn("reverted", F.lit(True))
    s = s.join(back, ["phrase", "idx"], "left").withColumn("reverted", F.coalesce("reverted", F.lit(False)))
    s = s.join(seams.select("phrase", F.col("period").alias("next_period"), F.lit(True).alias("_seam")), ["phrase", "next_period"], "left")
    ev = events.withColumn("_event", F.lit(True))
    s = s.join(ev.select("phrase", F.col("period").alias("next_period"), F.col("_event").alias("_e1")), ["phrase", "next_period"], "left")
    s = s.join(ev.select("phrase", F.col("period").alias("at"), F.col("_event").alias("_e2")), ["phrase", "at"], "left")
    kind = (
        F.when(F.col("reverted"), "demand_transient").when(F.col("_seam"), "measurement").when(F.coalesce("_e1", "_e2", F.lit(False)), "demand_persistent").otherwise("unresolved")
    )
    s = s.select("phrase", "at", kind.alias("kind"), "delta", F.lit(False).alias("spike"), "reverted")
    return spikes.unionByName(s)


def handling(breaks: DataFrame) -> DataFrame:
    """breaks with handling: keep, dummy, truncate or segment."""
    table = F.create_map(*[F.lit(x) for p in HANDLING.items() for x in p])
    return breaks.withColumn("handling", F.try_element_at(table, F.col("kind")))


def truncate_at(monthly: DataFrame, cuts: DataFrame) -> DataFrame:
    """Months after the latest cut (phrase, at) of each series; series without one stay whole."""
    last = cuts.groupBy("phrase").agg(F.max("at").alias("_at"))
    return monthly.join(last, "phrase", "left").where(F.col("_at").isNull() | (F.col("period") > F.col("_at"))).drop("_at")


def add_dummy(monthly: DataFrame, cuts: DataFrame) -> DataFrame:
    """monthly with post_break, 1 after the cut."""
    last = cuts.groupBy("phrase").agg(F.max("at").alias("_at"))
    return monthly.join(last, "phrase", "left").withColumn("post_break", F.coalesce((F.col("period") > F.col("_at")).cast("int"), F.lit(0))).drop("_at")


def breaks_report(breaks: DataFrame) -> DataFrame:
    """phrase, report: its breaks as JSON, delta to four places."""
    rows = F.array_sort(F.collect_list(F.struct("at", "kind", F.round("delta", 4).alias("delta_log"), "spike", "reverted")))
    return handling(breaks).groupBy("phrase").agg(F.to_json(rows).alias("report"))


def month_distance(a, b):
    return F.abs(month_key(a) - month_key(b))
