"""Toxicity by a factorization machine over hashed terms.

Terms are the different lower-case words of a text and the beginnings of longer words.

score = sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>) over the different hashed terms of a text,
so two terms can weigh more (or less) together than the sum of both. Terms are first judged by their
association with the label (G-test); the machine is fitted on those that matter. It is fitted on a
bounded sample of the labelled rows, MAX_ROWS of them chosen by a hash of doc_id; scoring covers all
rows and whole texts and sees nothing but the text.

Null and empty texts have no terms and get the machine's base score. Rows of labels without a label
are ignored; a doc_id labelled more than once counts with its largest label. Without any labelled row
every score is 0.
"""

from __future__ import annotations

import pickle
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import columns, cut, map_batches, only

#: Most terms that the machine keeps, least association, length of a pair vector.
TERMS, LEAST_G, RANK = 8192, 12.0, 8
#: Bound of the labelled rows that the machine is fitted on; 12 bytes each when sent to all executors.
MAX_ROWS = 40_000
WORD = re.compile(r"[^\W\d_]+")
#: Letters in the beginnings of words that are terms as well.
BEGIN = (4, 6)
#: Words kept per Python worker; the table is emptied when full, which costs time only.
CACHE = 300_000


def terms_of(word: str) -> tuple[int, ...]:
    """Hashes of a word and of its beginnings, 31 bits each."""
    parts = [word, *[word[:n] + "*" for n in BEGIN if len(word) > n]]
    return tuple(zlib.crc32(p.encode()) & 0x7FFFFFFF for p in parts)


def hashed_terms(docs: DataFrame) -> DataFrame:
    """doc_id, toxic and the different hashed terms of each whole text."""

    def make():
        known: dict[str, tuple[int, ...]] = {}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, texts, toxic = columns(batch, "doc_id", "text", "toxic")
            out = []
            for t in texts:
                words = set(WORD.findall(t.lower())) if t else ()
                if len(known) > CACHE:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = terms_of(w)
                out.append(sorted({x for w in words for x in known[w]}))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int32())), pa.array(toxic, pa.int32())], names=["doc_id", "terms", "toxic"]
            )

        return step

    return map_batches(only(docs, "doc_id", "text", "toxic"), "doc_id bigint, terms array<int>, toxic int", make)


@dataclass
class Machine:
    """w0, and for each kept term its weight w and pair vector v."""

    w0: float
    slot: dict[int, int]  # term -> row of w and v
    w: np.ndarray
    v: np.ndarray

    def raw(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """Scores before the sigmoid; rows[i] is the text that slot terms[i] belongs to."""
        linear = np.bincount(rows, self.w[terms], minlength=n)
        pairs = np.zeros(n)
        for f in range(self.v.shape[1]):
            x = self.v[terms, f]
            pairs += np.bincount(rows, x, minlength=n) ** 2 - np.bincount(rows, x * x, minlength=n)
        return self.w0 + linear + pairs / 2

    def score(self, slots: list[set[int]]) -> np.ndarray:
        """Scores of texts, each given by the rows of its kept terms."""
        n = np.array([len(t) for t in slots], dtype=np.int64)
        flat = np.fromiter((x for t in slots for x in t), dtype=np.int64, count=int(n.sum()))
        return 1 / (1 + np.exp(-np.clip(self.raw(np.repeat(np.arange(len(slots)), n), flat, len(slots)), -30, 30)))


def fit(texts: list[list[int]], labels: np.ndarray, kept: list[int], epochs: int = 20, rate: float = 0.1, decay: float = 1e-4) -> Machine:
    """Adagrad on the logistic loss, in batches, from a fixed seed."""
    rng = np.random.default_rng(3)
    slot = {t: i for i, t in enumerate(kept)}
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3) if len(labels) else 1e-3
    m = Machine(float(np.log(share / (1 - share))), slot, np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), RANK)))
    if not len(kept) or not len(labels):
        return m
    rows = [np.array([slot[x] for x in t if x in slot], dtype=np.int64) for t in texts]
    g0, gw, gv = 1e-6, np.full(len(kept), 1e-6), np.full(m.v.shape, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), 256):
            part = order[k : k + 256]
            n = np.array([len(rows[i]) for i in part])
            at, terms = np.repeat(np.arange(len(part)), n), np.concatenate([rows[i] for i in part])
            p = 1 / (1 + np.exp(-np.clip(m.raw(at, terms, len(part)), -30, 30)))
            err = p - labels[part]
            d = err.sum() / len(part)
            g0 += d * d
            m.w0 -= rate * d / np.sqrt(g0)
            if not len(terms):
                continue
            used, where = np.unique(terms, return_inverse=True)
            e = err[at]
            dw = np.bincount(where, e) / len(part) + decay * m.w[used]
            sums = np.stack([np.bincount(at, m.v[terms, f], minlength=len(part)) for f in range(RANK)], axis=1)
            near = (sums[at] - m.v[terms]) * e[:, None]
            dv = np.stack([np.bincount(where, near[:, f]) for f in range(RANK)], axis=1) / len(part) + decay * m.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            m.v[used] -= rate * dv / np.sqrt(gv[used])
    return m


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def associated(known: DataFrame) -> list[int]:
    """The TERMS terms with the largest G statistic against the label, of those with LEAST_G; known has terms and toxic."""
    total = known.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    n, t = float(total["n"] or 0), float(total["t"] or 0)
    if not n or not t or t == n:
        return []
    counts = known.select(F.explode("terms").alias("term"), "toxic").groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("c"), F.sum("toxic").cast("double").alias("a"))
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0))
    a, c = F.col("a"), F.col("c")
    g = 2 * (part(a, c * t / n) + part(c - a, c * (n - t) / n) + part(t - a, (n - c) * t / n) + part((n - t) - (c - a), (n - c) * (n - t) / n))
    top = counts.where("c >= 3").withColumn("g", g).where(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "term").limit(TERMS)
    return [r["term"] for r in top.select("term").collect()]


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs, learnt from the labels that are not held out."""
    given = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    given = given.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    given = cut(given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS), "toxicity-labels")
    labelled = only(docs, "doc_id", "text").join(F.broadcast(given), "doc_id")  # at most MAX_ROWS rows
    known = cut(hashed_terms(labelled), "toxicity-known")
    kept = associated(known)

    def keep():
        mine = set(kept)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, terms, toxic = columns(batch, "doc_id", "terms", "toxic")
            few = [[x for x in t if x in mine] for t in terms]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(few, pa.list_(pa.int32())), pa.array(toxic, pa.int32())], names=["doc_id", "terms", "toxic"])

        return step

    few = map_batches(known.select("doc_id", "terms", "toxic"), "doc_id bigint, terms array<int>, toxic int", keep)
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id", "terms").limit(MAX_ROWS)

    def learn(rows: pa.Table) -> pa.Table:
        """The machine of at most MAX_ROWS rows, as its bytes: fitted on an executor, small enough for the driver."""
        rows = rows.sort_by([("at", "ascending")])
        m = fit(rows.column("terms").to_pylist(), rows.column("toxic").to_numpy().astype(float), kept)
        return pa.table({"machine": pa.array([pickle.dumps(m)], pa.binary())})

    ordered = few.select(F.lit(0).alias("one"), F.monotonically_increasing_id().alias("at"), "terms", "toxic")
    found = ordered.groupBy("one").applyInArrow(learn, "machine binary").collect()
    machine = pickle.loads(found[0]["machine"]) if found else None

    def make():
        slots: dict[str, tuple[int, ...]] = {}
        slot = machine.slot if machine else {}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, texts = columns(batch, "doc_id", "text")
            found = []
            for t in texts:
                words = set(WORD.findall(t.lower())) if t else ()
                if len(slots) > CACHE:
                    slots.clear()
                mine: set[int] = set()
                for w in words:
                    got = slots.get(w)
                    if got is None:
                        got = slots[w] = tuple(slot[x] for x in terms_of(w) if x in slot)
                    if got:
                        mine.update(got)
                found.append(mine)
            s = machine.score(found) if machine else np.zeros(len(texts))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

        return step

    scored = map_batches(only(docs, "doc_id", "text"), "doc_id bigint, score double, predicted int", make)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
