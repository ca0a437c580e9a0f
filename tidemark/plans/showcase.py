"""From monthly series and clusters to the ranked, priced showcase: one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ranking
from tidemark.sources.artifact import showcase_json


def ranked(monthly: DataFrame) -> DataFrame:
    return ranking.rank_showcase(ranking.phrase_records(monthly))


def niches(monthly: DataFrame, clusters: DataFrame, filtered: DataFrame | None = None) -> DataFrame:
    """Niches of clusters (topic, phrase); filtered: phrases to leave out of the ranking."""
    records = with_filter(monthly, filtered)
    return ranking.build_niches(clusters, ranking.rank_showcase(records), records)


def with_filter(monthly: DataFrame, filtered: DataFrame | None) -> DataFrame:
    records = ranking.phrase_records(monthly)
    if filtered is None:
        return records.withColumn("filtered_out", F.lit(False))
    flags = filtered.select("phrase").distinct().withColumn("filtered_out", F.lit(True))
    return records.join(flags, "phrase", "left").withColumn("filtered_out", F.coalesce("filtered_out", F.lit(False)))


def sourcing(monthly: DataFrame, clusters: DataFrame, filtered: DataFrame | None = None, weeks: int = 8) -> DataFrame:
    return ranking.sourcing_scores(niches(monthly, clusters, filtered), clusters, monthly, weeks)


def document(monthly: DataFrame, clusters: DataFrame, generated_at: str, filtered: DataFrame | None = None) -> DataFrame:
    return showcase_json(ranked(monthly), niches(monthly, clusters, filtered), sourcing(monthly, clusters, filtered), monthly, generated_at)
