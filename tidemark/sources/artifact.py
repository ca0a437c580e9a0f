"""The showcase document, graph state, backtest tables and translation cache."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ranking import niche_order

SCHEMA, READABLE = "showcase/v3", ("showcase/v1", "showcase/v2", "showcase/v3")


class ArtifactError(ValueError):
    """A document or state of unknown shape."""


def showcase_json(ranked: DataFrame, niches: DataFrame, sourcing: DataFrame, monthly: DataFrame, generated_at: str) -> DataFrame:
    """One row, json: phrases with their series, niches and sourcing, all in display order."""
    points = monthly.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("period", "queries"))).alias("series"))
    p = ranked.join(points, "phrase").select(F.struct("rank", "phrase", "klass", F.round("score", 6).alias("ratio"), F.round("rank_score", 6).alias("score"), F.round("amplitude", 6).alias("amplitude"), "series").alias("x"))
    n = niche_order(niches).select(F.struct("place", "topic", "klass", F.round("score", 6).alias("score"), "n_phrases", F.round("filtered_share", 6).alias("filtered_share"), "age", "phrases").alias("x"))
    s = sourcing.select(F.struct("place", "topic", "klass", F.round("score", 6).alias("score"), "peak", "order_month", "on_time").alias("x"))
    one = lambda d, name: d.agg(F.array_sort(F.collect_list("x")).alias(name)).withColumn("_k", F.lit(1))
    doc = one(p, "phrases").join(one(n, "niches"), "_k").join(one(s, "sourcing"), "_k")
    return doc.select(F.to_json(F.struct(F.lit(SCHEMA).alias("schema"), F.lit(generated_at).alias("generated_at"), "niches", "sourcing", "phrases")).alias("json"))


def save_showcase(doc: DataFrame, path: str) -> None:
    doc.select("json").coalesce(1).write.mode("overwrite").text(path)


def load_showcase(spark: SparkSession, path: str) -> dict | None:
    """The document, None if there is none yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    rows = spark.read.text(path, wholetext=True).collect()
    doc = json.loads("".join(r["value"] for r in rows)) if rows else {}
    if doc.get("schema") not in READABLE:
        raise ArtifactError(f"unknown schema {doc.get('schema')!r}")
    return doc


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """Write a small document beside its place and rename it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p, tmp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = p.getFileSystem(conf)
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    # a rename that overwrites: there is an old or a new state at any time
    option = jvm.org.apache.hadoop.fs.Options.Rename
    choices = spark.sparkContext._gateway.new_array(option, 1)
    choices[0] = option.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri(), conf).rename(fs.makeQualified(tmp), fs.makeQualified(p), choices)


def save_state(spark: SparkSession, path: str, state, spent_day: str | None, spent: int) -> None:
    """Graph state as JSON, written beside and renamed, so that it is whole or absent."""
    doc = {
        "version": 1,
        "visited": state.visited,
        "frontier": [{"phrase": e.phrase, "frequency": None if e.frequency == float("inf") else e.frequency, "depth": e.depth, "is_seed": not e.late} for e in sorted(state.frontier)],
        "budget": {"date": spent_day, "spent": spent},
    }
    _replace(spark, path, json.dumps(doc, ensure_ascii=False, sort_keys=True))


def load_state(spark: SparkSession, path: str):
    """(state, budget), or (None, None) if there is none yet."""
    from tidemark.operators.graph import Entry, State

    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None, None
    try:
        doc = json.loads("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
        if doc["version"] != 1:
            raise ArtifactError(f"unknown state version {doc['version']!r}")
        entries = [Entry(not e["is_seed"], -float("inf") if e["frequency"] is None else -e["frequency"], e["phrase"], e["depth"]) for e in doc["frontier"]]
        return State(dict(doc["visited"]), entries), doc["budget"]
    except (KeyError, TypeError, json.JSONDecodeError) as why:
        raise ArtifactError(f"broken state: {why}") from why


def write_backtest(table: DataFrame, path: str) -> None:
    table.coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_backtest(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True, schema="model STRING, mase_median DOUBLE, win_rate_vs_baseline DOUBLE, n_phrases INT")
    if not df.limit(1).count():
        raise ArtifactError("no rows in the backtest summary")
    return df


def translate(phrases: DataFrame, cache: DataFrame, fetch=None, batch: int = 64) -> DataFrame:
    """phrase, translation, origin ('cache', 'fetched' or 'missing'); fetch(list) -> list is called in batches."""
    p = phrases.select("phrase").distinct().join(cache.select("phrase", "translation"), "phrase", "left")
    known = p.where("translation IS NOT NULL").withColumn("origin", F.lit("cache"))
    rest = p.where("translation IS NULL")
    if fetch is None:
        return known.unionByName(rest.withColumn("origin", F.lit("missing")))

    def run(it):
        for pdf in it:
            out = []
            for k in range(0, len(pdf), batch):
                part = pdf["phrase"].iloc[k : k + batch].tolist()
                try:
                    got = fetch(part)
                except Exception:  # a failing service leaves phrases untranslated
                    got = [None] * len(part)
                out += got
            pdf = pdf.assign(translation=out)
            yield pdf.assign(origin=["missing" if t is None else "fetched" for t in out])

    return known.unionByName(rest.mapInPandas(run, "phrase string, translation string, origin string"))


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """phrase, translation of a JSON map of texts; no rows if there is no file yet. Raises ArtifactError if it is anything else."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    kind = "phrase string, translation string"
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], kind)
    try:
        doc = json.loads("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    except json.JSONDecodeError as why:
        raise ArtifactError(f"broken cache: {why}") from why
    if not isinstance(doc, dict) or not all(isinstance(v, str) for v in doc.values()):
        raise ArtifactError("a cache maps phrases to texts")
    return spark.createDataFrame(sorted(doc.items()), kind)


def save_cache(cache: DataFrame, path: str) -> None:
    """A JSON map with its keys in order and a final newline; rows without translation are left out. It is as large as that document."""
    rows = cache.where("phrase IS NOT NULL AND translation IS NOT NULL").groupBy("phrase").agg(F.min("translation").alias("translation")).collect()
    _replace(cache.sparkSession, path, json.dumps({r["phrase"]: r["translation"] for r in rows}, ensure_ascii=False, sort_keys=True, indent=2) + "\n")
