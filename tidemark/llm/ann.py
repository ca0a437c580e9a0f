"""Approximate nearest neighbours by largest inner product over a hierarchical k-means tree.

Vectors get one more component so that all have the same length; nearest points and largest inner
products are then the same thing. A k-means tree is fitted on one half of a bounded sample. Every vector
is filed under one leaf; a query walks the tree best-bin-first: a priority queue holds the nodes seen
so far by the distance of their centres, and leaves come out of it in order of promise. How many
leaves a query visits is widened, on the other half of the sample against brute force, until the recall
wished for is reached there; a query goes on until its leaves hold k + 1 vectors.

Equal vectors are filed once with their smallest ids, as no more of them can be in an answer, so
any number of copies is no burden; equal queries are asked once. Queries that begin in neighbouring leaves
form groups of bounded size. A vector is sent to the groups that visit its leaf, each group's vectors are
dealt into a few slices of bounded size, and a cell, one group and one slice, keeps the k + 1 best of each
of its queries: what comes out is in proportion to the queries. Scores are inner products of the original
vectors in double precision.

Vectors that are null or zero, or hold null or non-finite components, take no part, neither do those
whose length is not the most frequent one. Equal scores go to the smaller vec_id. Rows that repeat
a vec_id with the same vector count once. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Bound of the sample that the tree and the number of visits are fitted on; its queries.
SAMPLE, PROBES = 32_768, 256
#: Children of a node, and sample vectors in a leaf at most.
BRANCH, LEAF = 16, 48
#: Queries in a group at most; slices of a group's vectors at least; vectors in a slice, about; vectors scored at once.
GROUP, SLICES, SLICE, CHUNK = 4096, 8, 65_536, 8192
#: Scores in a block, of which only the largest is compared at first.
STRIDE = 32


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centers = x[rng.choice(len(x), size=k, replace=False)].copy()
    for _ in range(rounds):
        d = (centers**2).sum(1)[None, :] - 2 * x @ centers.T
        near = d.argmin(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


@dataclass
class Tree:
    """centers[i] of node i; children[i] its child nodes, none for a leaf; node 0 is the root."""

    centers: np.ndarray
    children: list[np.ndarray]
    longest: float  # squared length that every vector is filled up to

    @classmethod
    def fit(cls, x: np.ndarray, longest: float, seed: int = 7) -> Tree:
        rng = np.random.default_rng(seed)
        filled = cls._fill(x, longest)
        centers, children, todo = [filled.mean(0)], [np.empty(0, np.int64)], [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) <= LEAF or len(np.unique(filled[rows], axis=0)) <= 1:
                continue
            c = np.unique(_kmeans(filled[rows], min(BRANCH, len(rows)), rng), axis=0)
            near = ((c**2).sum(1)[None, :] - 2 * filled[rows] @ c.T).argmin(1)
            used = np.unique(near)
            if len(used) < 2:
                continue
            children[node] = np.arange(len(centers), len(centers) + len(used))
            for u in used:
                centers.append(c[u])
                children.append(np.empty(0, np.int64))
                todo.append((len(centers) - 1, rows[near == u]))
        return cls(np.array(centers), children, longest)

    @staticmethod
    def _fill(x: np.ndarray, longest: float) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(0.0, longest - (x**2).sum(1)))[:, None]])

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child on every level."""
        filled, at = self._fill(x, self.longest), np.zeros(len(x), dtype=np.int64)
        open_nodes = [0]
        while open_nodes:
            node = open_nodes.pop()
            kids = self.children[node]
            rows = np.nonzero(at == node)[0]
            if len(kids) and len(rows):
                c = self.centers[kids]
                at[rows] = kids[((c**2).sum(1)[None, :] - 2 * filled[rows] @ c.T).argmin(1)]
                open_nodes.extend(kids.tolist())
        return at

    def _far(self, q: np.ndarray) -> np.ndarray:
        unit = q * (math.sqrt(self.longest) / np.linalg.norm(q, axis=1))[:, None]
        c = self.centers
        return (c**2).sum(1)[None, :] - 2 * unit @ c[:, :-1].T

    def _walk(self, d: np.ndarray, begin: list[int], many: int, held: np.ndarray | None = None, least: int = 0) -> list[int]:
        heap, leaves, seen = [(d[i], i) for i in begin], [], 0
        heapq.heapify(heap)
        while heap and (len(leaves) < many or seen < least):
            _, node = heapq.heappop(heap)
            kids = self.children[node]
            if not len(kids):
                leaves.append(node)
                seen += int(held[node]) if held is not None else 0
            for k in kids.tolist():
                heapq.heappush(heap, (d[k], k))
        return leaves

    def visits(self, q: np.ndarray, many: int) -> list[list[int]]:
        """The first leaves of each query, best bin first."""
        return [self._walk(d, [0], many) for d in self._far(q)]

    def visited(self, q: np.ndarray, many: int, held: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """A leaf among the first of each query, and which nodes are the first `many` leaves it visits, more until they hold `least` vectors (held[node] each).

        A node comes out of the queue when the largest distance on its path does, so the leaves with smaller ones
        than the last are known without a queue; only those behind the same node as the last are walked.
        """
        far, ends = self._far(q), np.array([i for i, k in enumerate(self.children) if not len(k)])
        above, level = np.full(far.shape, -np.inf), [0]
        while level:
            below = []
            for node in level:
                if len(kids := self.children[node]):
                    above[:, kids] = np.maximum(far[:, node], above[:, node])[:, None]
                    below += kids.tolist()
            level = below
        walls, out = np.maximum(far, above)[:, ends], np.zeros(far.shape, dtype=bool)
        if many >= len(ends):
            out[:, ends] = True
            return ends[walls.argmin(1)], out
        last = np.partition(walls, many - 1, axis=1)[:, many - 1 : many]
        out[:, ends] = walls < last
        for i in range(len(q)):
            begin = np.nonzero((far[i] == last[i]) & (above[i] < last[i]))[0]
            out[i, self._walk(far[i], begin.tolist(), many - int(out[i].sum()))] = True
        for i in np.nonzero(out @ held < least)[0]:
            out[i, self._walk(far[i], [0], many, held, least)] = True
        return ends[walls.argmin(1)], out

    def leaves(self) -> int:
        return sum(1 for k in self.children if not len(k))


def calibrate(tree: Tree, held_out: np.ndarray, k: int, recall: float) -> int:
    """Leaves to visit so that probes find `recall` of their true k nearest, both among vectors that the tree was not fitted on."""
    if len(held_out) <= k:
        return tree.leaves()
    rng = np.random.default_rng(11)
    probes = rng.choice(len(held_out), size=min(PROBES, len(held_out)), replace=False)
    leaf = tree.file(held_out)
    scores = held_out[probes] @ held_out.T
    scores[np.arange(len(probes)), probes] = -np.inf
    kth = np.sort(scores, axis=1)[:, -k]
    place = np.zeros((len(probes), len(tree.children)), dtype=np.int64)
    for i, ls in enumerate(tree.visits(held_out[probes], tree.leaves())):
        place[i, ls] = np.arange(1, len(ls) + 1)
    needed = np.sort(np.concatenate([place[i][leaf[np.nonzero(scores[i] >= kth[i])[0]]] for i in range(len(probes))]))
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)])


def usable(vectors: DataFrame, dims: int | None = None) -> DataFrame:
    """vec_id and embedding (array of double) of the vectors that take part; dims: their length, the most frequent one if None."""
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0.0))
    if dims is None:
        most = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dims = most["d"] if most else 0
    return v.where(F.size("embedding") == F.lit(dims))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


def _bits(leaves: pa.ChunkedArray | pa.Array, least: int = 0) -> np.ndarray:
    """A row for each query, true at the leaves it visits, which come as bits or as lists; `least` columns or more."""
    if pa.types.is_binary(leaves.type):
        packed = np.frombuffer(b"".join(leaves.to_pylist()), dtype=np.uint8).reshape(len(leaves), -1)
        out = np.unpackbits(packed, axis=1).view(bool)
        return out if out.shape[1] >= least else np.pad(out, ((0, 0), (0, least - out.shape[1])))
    lists = leaves.to_pylist()
    out = np.zeros((len(lists), max([least, *(max(x, default=-1) + 1 for x in lists)])), dtype=bool)
    for i, x in enumerate(lists):
        out[i, x] = True
    return out


def _first(k: int, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row number, by row, score descending and id."""
    best = np.lexsort((ids, -scores, rows))
    rows = rows[best]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], ids[best][keep], scores[best][keep]


def _best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, seen: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, score) of each query's k best of the seen vectors, ties to smaller ids, scores summed in one fixed order.

    Columns are dealt into blocks; the k-th largest of the blocks' maxima is no more than the k-th largest score.
    """
    wide = -len(x) % STRIDE
    rough = np.full((len(q), len(x) + wide), -np.inf)
    rough[:, : len(x)] = q @ x.T
    rough[:, : len(x)][~seen] = -np.inf
    most = rough.reshape(len(q), STRIDE, -1).max(axis=1)
    if most.shape[1] > k:
        kth = np.partition(most, most.shape[1] - k, axis=1)[:, most.shape[1] - k]
        off = 4 * np.finfo(float).eps * x.shape[1] * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
        seen = seen & ~(rough[:, : len(x)] < (kth - off)[:, None])
    rows, cols = np.nonzero(seen)
    out = [_first(k, rows[a:b], ids[cols[a:b]], (x[cols[a:b]] * q[rows[a:b]]).sum(axis=1)) for a, b in _pieces(rows)]
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (rows, ids[:0], np.empty(0))


def _pieces(rows: np.ndarray) -> list[tuple[int, int]]:
    """Cuts of sorted row numbers between rows, so that few vectors are copied at once."""
    out, a = [], 0
    while a < len(rows):
        b = int(np.searchsorted(rows, rows[min(a + CHUNK, len(rows)) - 1], "right"))
        out.append((a, b))
        a = b
    return out


def _groups(asks: dict[int, int]) -> list[tuple[int, int, int]]:
    """(leaf, first group, groups): queries that begin in neighbouring leaves together up to GROUP; a larger leaf in parts."""
    out, group, room = [], -1, 0
    for leaf in sorted(asks):
        if asks[leaf] > room:
            group, room = group + 1, GROUP
        parts = max(1, math.ceil(asks[leaf] / GROUP))
        out.append((leaf, group, parts))
        group, room = group + parts - 1, room - asks[leaf] if parts == 1 else 0
    return out


_FOUND = pa.schema([("twin", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _meet(k: int):
    """A cell's vectors and queries -> the k best of each query, kept while chunks of vectors pass; leaves of queries as bits or lists."""

    def run(vs: pa.Table, qs: pa.Table) -> pa.Table:
        if not vs.num_rows or not qs.num_rows:
            return _FOUND.empty_table()
        x, ids, leaf = _matrix(vs.column("embedding")), vs.column("vec_id").to_numpy(), vs.column("leaf").to_numpy()
        order = np.argsort(leaf, kind="stable")
        x, ids, leaf = x[order], ids[order], leaf[order]
        twins, visited = qs.column("twin").to_numpy(), qs.column("leaves")
        q = _matrix(qs.column("embedding"))
        out_t, out_i, out_s = [], [], []
        for a in range(0, len(q), 256):
            part, bits = q[a : a + 256], _bits(visited.slice(a, 256), int(leaf[-1]) + 1)
            kept = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            for b in range(0, len(x), CHUNK):
                here, n = np.unique(leaf[b : b + CHUNK], return_counts=True)
                new = _best(part, x[b : b + CHUNK], ids[b : b + CHUNK], np.repeat(bits[:, here], n, axis=1), k)
                kept = _first(k, *(np.concatenate(c) for c in zip(kept, new)))
            for out, c in zip((out_t, out_i, out_s), (twins[a : a + 256][kept[0]], *kept[1:])):
                out.append(c)
        return pa.Table.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip((out_t, out_i, out_s), _FOUND)], schema=_FOUND)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = 0.97) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k nearest; a query is no answer to itself.

    vectors and queries have vec_id and embedding. recall is what the number of visits is calibrated to.
    """
    spark = vectors.sparkSession
    v = cut(usable(vectors), "ann-vectors")
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    stats = v.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("longest"), F.max(F.size("embedding")).alias("dims")).first()
    if not stats["n"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    sample = np.unique(_matrix(rows.column("embedding")), axis=0)
    sample = sample[np.random.default_rng(5).permutation(len(sample))]
    half = (len(sample) + 1) // 2
    tree = Tree.fit(sample[:half], float(stats["longest"]))
    many = calibrate(tree, sample[half:], k, recall)

    # the k + 1 smallest ids of each different vector: one of them may be the query itself
    first = Window.partitionBy("embedding").orderBy("vec_id")
    distinct = v.distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1).drop("_n")

    def filed(batches):
        for b in batches:
            if b.num_rows:
                leaf = tree.file(_matrix(b.column("embedding")))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(leaf)], names=["vec_id", "embedding", "leaf"])

    index = cut(distinct.mapInArrow(filed, "vec_id bigint, embedding array<double>, leaf bigint"), "ann-index")
    held = np.zeros(len(tree.children), dtype=np.int64)
    for r in index.groupBy("leaf").count().collect():  # no more than leaves, which the sample bounds
        held[r["leaf"]] = r["count"]

    asked = usable(queries, stats["dims"]).distinct()
    twins = asked.groupBy("embedding").agg(F.min("vec_id").alias("twin"))
    asked = cut(asked.join(twins, "embedding").select("vec_id", "twin", "embedding"), "ann-queries")

    def walks(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                b = whole.slice(a, 512)
                leaf, leaves = tree.visited(_matrix(b.column("embedding")), many, held, k + 1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("twin"), b.column("embedding"), pa.array(leaf, pa.int64()), pa.array([x.tobytes() for x in np.packbits(leaves & (held > 0), axis=1)], pa.binary())],
                    names=["twin", "embedding", "leaf", "leaves"],
                )

    walked = asked.where("vec_id = twin").select("twin", "embedding").mapInArrow(walks, "twin bigint, embedding array<double>, leaf bigint, leaves binary")
    walked = cut(walked, "ann-walks")
    asks = {r["leaf"]: r["count"] for r in walked.groupBy("leaf").count().collect()}  # no more than leaves
    groups = spark.createDataFrame(_groups(asks), "leaf bigint, first bigint, parts bigint")
    walked = walked.join(F.broadcast(groups), "leaf").withColumn("grp", F.col("first") + F.pmod(F.xxhash64("twin"), F.col("parts")))

    def visited(batches):
        for b in batches:
            if b.num_rows:
                grp, bits = b.column("grp").to_numpy(), _bits(b.column("leaves"))
                for g in np.unique(grp):
                    leaf = np.nonzero(bits[grp == g].any(axis=0))[0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), g), pa.int64()), pa.array(leaf, pa.int64())], names=["grp", "leaf"])

    needs = cut(walked.select("grp", "leaves").mapInArrow(visited, "grp bigint, leaf bigint").distinct(), "ann-needs")
    sizes = spark.createDataFrame([(i, n) for i, n in enumerate(held.tolist()) if n], "leaf bigint, n bigint")
    slices = needs.join(F.broadcast(sizes), "leaf").groupBy("grp").agg(F.greatest(F.lit(SLICES), F.ceil(F.sum("n") / SLICE)).cast("bigint").alias("slices"))
    slices = cut(slices, "ann-slices")

    zero = F.lit(0).cast("bigint")
    left = index.join(needs.join(slices, "grp"), "leaf").withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.col("slices"))).select("grp", "slice", "vec_id", "embedding", "leaf")
    right = walked.join(slices, "grp").withColumn("slice", F.explode(F.sequence(zero, F.col("slices") - 1))).select("grp", "slice", "twin", "embedding", "leaves")
    met = left.groupBy("grp", "slice").cogroup(right.groupBy("grp", "slice")).applyInArrow(_meet(k + 1), "twin bigint, vec_id bigint, score double")
    best = Window.partitionBy("twin").orderBy(F.desc("score"), "vec_id")
    met = met.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n")
    each = asked.select(F.col("vec_id").alias("query_id"), "twin").join(met, "twin").where("query_id <> vec_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
