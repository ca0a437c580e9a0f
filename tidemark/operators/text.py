"""Tokens, TF-IDF, cluster labels, silhouette, ARI and k-means on short texts and vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = "[а-яёa-z]+(?:-[а-яёa-z]+)*"
SEED, RESTARTS, TOP_LEMMAS, K_GRID = 42, 10, 3, range(2, 9)
#: Silhouette: vectors of a block, blocks at least, and numbers held at once while two blocks meet.
CELL_VECTORS, CELL_LEAST, CELL_FLOATS = 2048, 4, 4_000_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def lemmas(phrases: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """phrase, lemmas (in order); dictionary: token, lemma; unknown tokens stay. Phrases without letters are left out."""
    t = phrases.select("phrase", F.posexplode(tokens(F.col("phrase"))).alias("pos", "token"))
    if dictionary is not None:
        first = dictionary.groupBy("token").agg(F.min("lemma").alias("lemma"))
        t = t.join(first, "token", "left").withColumn("token", F.coalesce("lemma", "token"))
    return t.groupBy("phrase").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("lemmas"))


def tfidf(docs: DataFrame, min_df: int = 1) -> DataFrame:
    """doc, term, weight: sublinear tf times smoothed idf, L2-normalised; docs: doc, tokens (array)."""
    tf = docs.select("doc", F.explode("tokens").alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    n = docs.where(F.size("tokens") >= 0).agg(F.count(F.lit(1)).alias("n")).first()["n"]
    w = (1 + F.log(F.col("tf").cast("double"))) * (F.log((F.lit(1.0) + n) / (1 + F.col("df"))) + 1)
    raw = tf.join(df, "term").select("doc", "term", w.alias("w"))
    norm = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "doc").select("doc", "term", (F.col("w") / F.col("norm")).alias("weight"))


def top_lemmas(members: DataFrame, top: int = TOP_LEMMAS) -> DataFrame:
    """cluster, label: its most frequent lemmas, ties by name; members: cluster, lemmas."""
    n = members.select("cluster", F.explode("lemmas").alias("lemma")).groupBy("cluster", "lemma").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("cluster").orderBy(F.desc("n"), "lemma")
    n = n.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    return n.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "lemma"))), lambda x: x["lemma"]), ", ").alias("label"))


def mean_tfidf(weights: DataFrame, clusters: DataFrame, top: int = 5) -> DataFrame:
    """cluster, term, mean, place of the terms with the largest mean weight; absent terms count as 0."""
    size = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    m = weights.join(clusters, "doc").groupBy("cluster", "term").agg(F.sum("weight").alias("s")).join(size, "cluster")
    m = m.withColumn("mean", F.col("s") / F.col("n"))
    w = Window.partitionBy("cluster").orderBy(F.desc("mean"), "term")
    return m.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= top).select("cluster", "term", "mean", "place")


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def centroids(vectors: DataFrame) -> DataFrame:
    """cluster, centroid of vectors (id, cluster, embedding)."""
    e = vectors.select("cluster", F.posexplode("embedding").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return e.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centroid"))


def centroid_nearest(vectors: DataFrame, k: int = 3) -> DataFrame:
    """cluster, place, id of the vectors nearest to their centroid."""
    d = vectors.join(centroids(vectors), "cluster").withColumn("d", F.round(_distance(F.col("embedding"), F.col("centroid")), 9))
    w = Window.partitionBy("cluster").orderBy("d", "id")
    return d.withColumn("place", F.row_number().over(w).cast("bigint")).where(F.col("place") <= k).select("cluster", "place", "id")


def _cell_sums(shape: str):
    """Two blocks of vectors -> id, cluster, other, total, n: summed distances of the left ones to each cluster of the right."""
    names = [c.split()[0] for c in shape.split(", ")]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.rename(columns=lambda c: c.removeprefix("right_"))
        left, right = (d[d["embedding"].notna()] for d in (left, right))
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        x, y = (np.stack(d["embedding"].to_numpy()).astype(float) for d in (left, right))
        code, other = pd.factorize(right["cluster"], use_na_sentinel=False)
        member = np.eye(len(other))[code]
        total, n = np.empty((len(x), len(other))), np.empty((len(x), len(other)))
        step = max(1, CELL_FLOATS // y.size)
        for i in range(0, len(x), step):
            here = slice(i, i + step)
            d = np.sqrt(((x[here][:, None] - y[None]) ** 2).sum(-1))
            counts = (left["id"].to_numpy()[here][:, None] != right["id"].to_numpy()[None]) & ~np.isnan(d)
            total[here], n[here] = np.where(counts, d, 0.0) @ member, counts @ member
        i, j = np.nonzero(n)
        columns = (left["id"].to_numpy()[i], left["cluster"].to_numpy()[i], np.asarray(other)[j], total[i, j], n[i, j].astype(np.int64))
        return pd.DataFrame(dict(zip(names, columns)))

    return run


def silhouette(vectors: DataFrame) -> DataFrame:
    """id, cluster, s: Euclidean silhouette of each vector, exact, by sums of distances to each cluster.

    Every vector meets every other by the measure's definition. Both sides are dealt into blocks by count, pairs
    of blocks meet by key, and each pair gives one partial sum for a vector and a cluster, so no task holds more than
    two blocks and no pair of vectors is ever a row. Vectors have one length; a null embedding is left out of all means
    and has s = 0, as has a vector alone in its cluster or in the only cluster. Rows without an id are left out.
    """
    v = vectors.where("id IS NOT NULL").select("id", "cluster", "embedding")
    blocks = max(CELL_LEAST, math.ceil(v.count() / CELL_VECTORS))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))
    part = F.pmod(F.xxhash64("id"), F.lit(blocks))
    left = v.withColumn("p", part).withColumn("q", F.explode(every))
    right = v.select(*[F.col(c).alias(f"right_{c}") for c in v.columns], part.alias("right_q")).withColumn("right_p", F.explode(every))
    kinds = {f.name: f.dataType.simpleString() for f in v.schema}
    shape = f"id {kinds['id']}, cluster {kinds['cluster']}, other {kinds['cluster']}, total double, n bigint"
    sums = left.groupBy("p", "q").cogroup(right.groupBy("right_p", "right_q")).applyInPandas(_cell_sums(shape), shape)
    means = sums.groupBy("id", "cluster", "other").agg((F.sum("total") / F.sum("n")).alias("d"))
    own = F.max(F.when(F.col("cluster") == F.col("other"), F.col("d"))).alias("a")
    near = F.min(F.when(F.col("cluster") != F.col("other"), F.col("d"))).alias("b")
    s = v.select("id", "cluster", F.lit(None).cast(kinds["cluster"]).alias("other"), F.lit(None).cast("double").alias("d")).union(means).groupBy("id", "cluster").agg(own, near)
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return s.select("id", "cluster", value.alias("s"))


def adjusted_rand(pairs: DataFrame) -> DataFrame:
    """One row ari over a, b: two labellings of the same rows, from their contingency table."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    joint = cells.agg(two("n").alias("ij"), F.sum("n").alias("total"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(two("n").alias("ai"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(two("n").alias("bj"))
    one = lambda d: d.withColumn("_one", F.lit(1))
    j = one(joint).join(one(rows), "_one").join(one(cols), "_one")
    expected = F.col("ai") * F.col("bj") / (F.col("total") * (F.col("total") - 1) / 2)
    top = (F.col("ai") + F.col("bj")) / 2
    return j.select(F.coalesce(F.try_divide(F.col("ij") - expected, F.nullif(top - expected, F.lit(0.0))), F.lit(1.0)).alias("ari"))


def kmeans(vectors: DataFrame, k: int, restarts: int = RESTARTS, seed: int = SEED) -> DataFrame:
    """id, cluster: the best of several k-means runs by training cost; vectors: id, embedding."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).persist()
    best = None
    for r in range(restarts):
        model = KMeans(k=k, seed=seed + r, maxIter=50).fit(data)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best.transform(data).select("id", F.col("prediction").alias("cluster"))


def cluster_phrases(vectors: DataFrame, k_grid=K_GRID, restarts: int = RESTARTS) -> tuple[DataFrame, int, float | None]:
    """Clusters, their number and mean silhouette: the smallest k that no other beats; None for fewer than three."""
    n = vectors.count()
    best = None
    for k in [k for k in k_grid if 2 <= k <= n - 1]:
        c = kmeans(vectors, k, restarts)
        if c.select("cluster").distinct().count() < 2:
            continue
        s = silhouette(vectors.join(c, "id")).agg(F.avg("s")).first()[0]
        if best is None or s > best[2]:
            best = (c, k, s)
    if best is None:
        return vectors.select("id", F.lit(0).alias("cluster")), min(n, 1), None
    return best


def fake_embedding(terms: Column, dims: int = 64) -> Column:
    """A deterministic unit vector from the MD5 of each term: an offline stand-in for a text model."""
    one = lambda t: F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.conv(F.substr(F.md5(F.concat(t, F.lit(":"), i.cast("string")).cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("double") / F.lit(2.0**31) - 1
    )
    total = F.aggregate(F.transform(terms, one), F.array_repeat(F.lit(0.0), dims), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    norm = F.sqrt(F.aggregate(total, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(total, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))


def pairwise_similarity(vectors: DataFrame) -> DataFrame:
    """a, b, similarity (Pearson, NULL if constant) of every two phrases with vectors (phrase, pos, value)."""
    from tidemark.functions.scores import pearson

    left = vectors.select(F.col("phrase").alias("a"), "pos", F.col("value").alias("x"))
    right = vectors.select(F.col("phrase").alias("b"), "pos", F.col("value").alias("y"))
    return left.join(right, "pos").where("a < b").groupBy("a", "b").agg(pearson("x", "y").alias("similarity"))


def nearest_neighbors(similar: DataFrame) -> DataFrame:
    """phrase, nearest: the most similar other phrase by defined similarity, ties by name; NULL if none is defined."""
    both = similar.select(F.col("a").alias("phrase"), F.col("b").alias("other"), "similarity").union(similar.select("b", "a", "similarity"))
    r = F.round("similarity", 9)
    best = both.where("similarity IS NOT NULL").groupBy("phrase").agg(F.max(r).alias("_m"))
    near = both.join(best, "phrase").where(r == F.col("_m")).groupBy("phrase").agg(F.min("other").alias("nearest"))
    return both.select("phrase").distinct().join(near, "phrase", "left")


def multi_seed_kmeans(vectors: DataFrame, k: int, seeds: tuple[int, ...] = (0, 1, 2, 42)) -> DataFrame:
    """a, b, ari of the clusterings of every two seeds; vectors: id, embedding."""
    runs = {s: kmeans(vectors, k, restarts=1, seed=s) for s in seeds}
    out = None
    for i, a in enumerate(seeds):
        for b in seeds[i + 1 :]:
            pair = runs[a].withColumnRenamed("cluster", "a").join(runs[b].withColumnRenamed("cluster", "b"), "id")
            row = adjusted_rand(pair).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "ari")
            out = row if out is None else out.unionByName(row)
    return out
