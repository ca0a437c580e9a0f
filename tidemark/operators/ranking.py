"""Ranking, purchase timing, niches and sourcing scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scores
from tidemark.functions.calendar import lead_time_months, month_key
from tidemark.operators import series

DEFAULT_LEAD_WEEKS = 8
#: Weeks by transport, and lemmas that show the wish to buy.
LEAD_PRESETS = {"air": 4, "rail": 8, "sea": 12}
INTENT_MARKERS = ("купить", "цена", "стоимость", "заказать", "продажа", "недорого", "дешёвый")


def phrase_records(monthly: DataFrame) -> DataFrame:
    """phrase, score, base, amplitude, age: what ranking needs of every scorable series."""
    g = series.growth_score(monthly).select("phrase", "score", "base")
    return g.join(series.seasonal_amplitude(monthly), "phrase").join(series.growth_age(monthly), "phrase")


def score_components(records: DataFrame) -> DataFrame:
    """phrase, klass, anomaly, volume, freshness; the last three only where the class is GROWING."""
    klass = scores.classify(F.col("score"), F.col("amplitude"))
    only = lambda c: F.when(F.col("klass") == "GROWING", c)
    return records.withColumn("klass", klass).select(
        "phrase", "klass", only(scores.anomaly(F.col("score"))).alias("anomaly"), only(scores.volume(F.col("base"))).alias("volume"), only(scores.freshness(F.col("age"))).alias("freshness")
    )


def rank_showcase(records: DataFrame) -> DataFrame:
    """phrase, klass, rank_score, rank: by class order, then score, then phrase; filtered-out phrases are left out."""
    if "filtered_out" in records.columns:
        records = records.where(~F.col("filtered_out"))
    klass = scores.classify(F.col("score"), F.col("amplitude"))
    r = records.withColumn("klass", klass)
    r = r.withColumn("rank_score", scores.rank_score(F.col("klass"), F.col("score"), F.col("base"), F.col("age")))
    place = scores.class_order(F.col("klass"))
    # stretches that follow each other in the order: by score where there is one, else by the phrase's first two bytes
    by_score = F.col("klass") == "GROWING"
    parts = [place, F.when(by_score, -F.floor(F.col("rank_score") * 1024)).otherwise(0), F.when(by_score, "").otherwise(F.hex(F.substring(F.col("phrase").cast("binary"), 1, 2)))]
    return numbered(r, parts, [place, F.desc("rank_score"), F.col("phrase")], "rank")


def numbered(df: DataFrame, stretch: list[Column], order: list[Column], name: str) -> DataFrame:
    """df with a running number over a total order, without sorting everything in one task.

    stretch: keys that only grow along the order. Rows are numbered within their stretch, and the rows
    of earlier stretches are added; only the table of stretches passes through one task.
    """
    keys = [f"_s{i}" for i in range(len(stretch))]
    d = df.withColumns(dict(zip(keys, stretch)))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    d = d.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).join(counts, keys)
    return d.withColumn(name, (F.col("_before") + F.col("_rn")).cast("bigint")).drop(*keys, "_before", "_rn")


def purchase_window(monthly: DataFrame, weeks: int = DEFAULT_LEAD_WEEKS) -> DataFrame:
    """phrase, peak, order_month, months_to_order, months_to_peak, order_period, peak_period, lead, on_time; NULLs without a peak."""
    last = monthly.groupBy("phrase").agg(F.max("period").alias("last"))
    lead = lead_time_months(weeks)
    d = series.peak_month(monthly).join(last, "phrase").withColumn("lead", lead)
    d = d.withColumn("order_month", (F.pmod(F.col("peak") - F.col("lead") - 1, F.lit(12)) + 1).cast("int"))
    off = lambda m: F.pmod(F.col(m) - F.month("last"), F.lit(12)).cast("int")
    d = d.withColumns({"months_to_peak": off("peak"), "months_to_order": off("order_month")})
    return d.select(
        "phrase",
        "peak",
        "order_month",
        "months_to_order",
        "months_to_peak",
        F.add_months("last", F.col("months_to_order")).alias("order_period"),
        F.add_months("last", F.col("months_to_peak")).alias("peak_period"),
        "lead",
        (F.col("months_to_peak") >= F.col("lead")).alias("on_time"),
    )


def dominant_class(members: DataFrame) -> DataFrame:
    """topic, klass: the most frequent class of the members, ties by display order."""
    n = members.groupBy("topic", "klass").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("topic").agg(F.max_by("klass", F.struct("n", -scores.class_order(F.col("klass")))).alias("klass"))


def build_niches(clusters: DataFrame, ranked: DataFrame, records: DataFrame, top: int = 5) -> DataFrame:
    """topic, klass, score, n_phrases, filtered_share, age, phrases of each niche.

    clusters: topic, phrase. ranked: rank_showcase(). records: all phrases with filtered_out. A niche
    whose phrases are all unranked is none.
    """
    members = clusters.join(ranked.select("phrase", "klass", "rank_score", "rank", "age"), "phrase")
    klass = dominant_class(members)
    main = members.join(klass.withColumnRenamed("klass", "_k"), "topic")
    mine = F.col("klass") == F.col("_k")
    agg = main.groupBy("topic").agg(
        F.first("_k").alias("klass"),
        F.median(F.when(mine, F.col("rank_score"))).alias("score"),
        F.count(F.lit(1)).alias("n_phrases"),
        # of all growing members, whatever the niche's class
        F.floor(F.median(F.when(F.col("klass") == "GROWING", F.coalesce("age", F.lit(1))))).cast("int").alias("age"),
    )
    best = members.withColumn("_n", F.row_number().over(Window.partitionBy("topic").orderBy("rank"))).where(F.col("_n") <= top)
    best = best.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "phrase"))), lambda x: x["phrase"]).alias("phrases"))
    agg = agg.join(best, "topic")
    share = clusters.join(records.select("phrase", "filtered_out"), "phrase").groupBy("topic").agg(F.avg(F.col("filtered_out").cast("double")).alias("filtered_share"))
    return agg.join(share, "topic", "left").withColumn("filtered_share", F.coalesce("filtered_share", F.lit(0.0)))


def niche_order(niches: DataFrame) -> DataFrame:
    """niches with place: by class order, then score from the largest, then topic; one row a topic."""
    order = Window.orderBy(scores.class_order(F.col("klass")), F.desc("score"), "topic")
    return niches.withColumn("place", F.row_number().over(order).cast("bigint"))


def niche_series(clusters: DataFrame, monthly: DataFrame) -> DataFrame:
    """topic as phrase, period, queries: mean over the members that have the month."""
    return clusters.join(monthly, "phrase").groupBy(F.col("topic").alias("phrase"), "period").agg(F.avg(F.col("queries").cast("double")).alias("queries"))


def sourcing_scores(niches: DataFrame, clusters: DataFrame, monthly: DataFrame, weeks: int = DEFAULT_LEAD_WEEKS) -> DataFrame:
    """topic, klass, the four components, score and place of each niche."""
    mean = niche_series(clusters, monthly)
    amp = series.seasonal_amplitude(mean).withColumnRenamed("phrase", "topic")
    when = purchase_window(mean, weeks).select(F.col("phrase").alias("topic"), "on_time", "peak", "order_month")
    d = niches.join(amp, "topic").join(when, "topic").withColumnRenamed("score", "trend")
    d = d.withColumns(
        {
            "seasonal": scores.seasonal_component(F.col("amplitude")),
            "window": scores.window_component(F.col("on_time")),
            "stability": scores.stability_component(F.col("klass"), F.col("age"), F.col("filtered_share")),
        }
    )
    d = d.withColumn("score", scores.purchase_score(F.col("trend"), F.col("seasonal"), F.col("window"), F.col("stability")))
    place = Window.orderBy(F.desc("score"), scores.class_order(F.col("klass")), "topic")
    return d.withColumn("place", F.row_number().over(place).cast("bigint"))


def intent_share(tokens: DataFrame, markers: tuple[str, ...] = INTENT_MARKERS) -> DataFrame:
    """topic, share of its phrases that hold a marker; tokens: topic, phrase, lemmas (array)."""
    hit = F.arrays_overlap("lemmas", F.array(*map(F.lit, markers))).cast("double")
    return tokens.groupBy("topic").agg(F.avg(F.coalesce(hit, F.lit(0.0))).alias("intent_share"))


def top_per_class(ranked: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("klass").orderBy("rank")
    return ranked.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def month_offset(month: Column, last: Column) -> Column:
    return F.pmod(month - F.month(last), F.lit(12)).cast("int")


def break_known_dates(breaks: DataFrame, known: DataFrame, tolerance: int = 1) -> DataFrame:
    """known (phrase, known) with covered: whether a break (phrase, at) lies within tolerance months."""
    k = known.withColumn("_k", month_key(F.col("known")))
    # a band join as an equi-join: each break is spread over the months it covers
    b = breaks.select("phrase", F.explode(F.sequence(month_key(F.col("at")) - tolerance, month_key(F.col("at")) + tolerance)).alias("_k")).distinct()
    return k.join(b.withColumn("_hit", F.lit(True)), ["phrase", "_k"], "left").select("phrase", "known", F.coalesce("_hit", F.lit(False)).alias("covered"))
