"""Mixing sources to target weights by Poisson replication.

Each document of a source is wanted rate = weight * total / documents-of-the-source times on
average. Its number of copies is the value of the Poisson distribution with that mean at a point
given by a hash of seed and doc_id, so it needs no random state and comes out the same on any
machine and partitioning. Copies are then dealt over all partitions by another hash and sorted by
it there: a global shuffle in one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Hex digits of an MD5 that make the uniform number: 52 bits, exact in a double.
DIGITS = 13


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    head = F.substring(F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts]).cast("binary")), 1, DIGITS)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(16**DIGITS))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, default: float = 1.0) -> DataFrame:
    """source, documents, rate: how often a document of each source is wanted on average.

    weights: relative target share of each source; sources that are not named get default. total:
    documents wanted altogether, as many as there are if None. Null is a source like any other.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    weight = F.lit(float(default))
    if weights:
        named = F.create_map(*[F.lit(x) for k, v in sorted(weights.items()) for x in (k, float(v))])
        weight = F.coalesce(F.try_element_at(named, F.col("source")), weight)
    counts = cut(counts.withColumn("weight", weight), "mix-counts")
    sums = counts.agg(F.sum("weight").alias("weights"), F.sum("documents").alias("all")).first()
    wanted = float(sums["all"] or 0) if total is None else float(total)
    rate = F.col("weight") * F.lit(wanted) / (F.lit(float(sums["weights"] or 1)) * F.col("documents"))
    return counts.select("source", "documents", rate.alias("rate"))


#: exp(-rate) must not vanish: larger rates are drawn in equal parts, whose sum has the same distribution.
PART = 500.0


def poisson(rate: Column, point) -> Column:
    """The value of the Poisson distribution at point(j) for each part j: p(k) = p(k-1) * r / k, summed until it passes."""
    parts = F.greatest(F.lit(1), F.ceil(rate / PART).cast("int"))
    r = rate / parts
    last = F.ceil(r + 12 * F.sqrt(r) + 20).cast("int")  # the tail beyond is below 1e-16

    def draw(j: Column) -> Column:
        u = point(j)
        start = F.struct(F.exp(-r).alias("p"), F.exp(-r).alias("c"), F.when(F.exp(-r) < u, 1).otherwise(0).alias("n"))

        def step(s: Column, k: Column) -> Column:
            p = s["p"] * r / k
            return F.struct(p.alias("p"), (s["c"] + p).alias("c"), (s["n"] + F.when(s["c"] + p < u, 1).otherwise(0)).alias("n"))

        return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["n"])

    return F.aggregate(F.transform(F.sequence(F.lit(1), parts), draw), F.lit(0), lambda a, x: a + x)


def with_copies(docs: DataFrame, rate: DataFrame, seed: str) -> DataFrame:
    """docs with n_copies, by inverting the Poisson distribution of the source's rate at a hashed point."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    copies = poisson(F.col("rate"), lambda j: uniform(seed, j.cast("string"), name))
    right = rate.select(F.col("source").alias("_source"), "rate")
    joined = docs.join(right, F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.withColumn("n_copies", copies).drop("_source", "rate")


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: str = "mix", default: float = 1.0, details: bool = True
) -> DataFrame:
    """Every document as often as drawn, dealt over all partitions and sorted by order_key.

    All columns of docs stay; with details, copy (from 1), n_copies and order_key follow, and columns of
    docs with these names are left out. A null doc_id draws like the empty id. Repeated rows draw alike.
    """
    names = [c for c in docs.columns if not (details and c in ("copy", "n_copies", "order_key"))]
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "doc_id", "source")
    drawn = with_copies(base, cut(rates(docs, weights, total, default), "mix-rates"), seed).where("n_copies > 0")
    out = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    out = out.withColumn("order_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.col("doc_id"), F.col("copy")).cast("binary")))
    out = out.repartition("order_key").sortWithinPartitions("order_key", "doc_id", "copy")
    more = ["n_copies", "copy", "order_key"] if details else []
    return out.select(*[F.col("_row").getField(c).alias(c) for c in names], *more)
