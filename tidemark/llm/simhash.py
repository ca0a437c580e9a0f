"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if their balls of radius r share a variant. So
each distinct fingerprint stands for all its variants within r bits, and links are found where
variants meet. Sending 2081 variants (64 bits, r = 2) of each fingerprint through a shuffle would
move thousands of bytes per document. A variant is therefore addressed by its leading bits: a
fingerprint is sent once to each block of variants that its ball reaches, and the block's variants
are spelt out there, in memory, in bounded pieces. Each variant of each fingerprint is produced
exactly once.

Fingerprints that share a variant are linked to the least of them, never all with all: sharing a
variant already proves a distance of at most 2r, so stars lose no connection, and a group of
thousands gives thousands of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import columns, cut, drop, free, map_batches, only
from tidemark.llm.components import connected_components

#: Variants held at once by a task, and bits by which a piece with more of them is split.
PIECE, SPLIT = 500_000, 4
#: Rows of a partition that is sorted by block or token, about.
ROWS_EACH = 250_000


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined shingles of n words, repeats included; fewer words: the whole sequence."""
    import xxhash

    if not words:
        return np.empty(0, dtype=np.uint64)
    h64, whole = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= n:
        return np.array([h64(whole, 42)], dtype=np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - n + 1].tolist()
    return np.array([h64(whole[a:b], 42) for a, b in zip(starts, ends[n - 1 :].tolist())], dtype=np.uint64)


def majority(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; no hash: 0."""
    if not len(h):
        return 0
    h = h.astype("<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 4096):
        ones += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def simhash(text: str | None, shingle: int = 4) -> int:
    """64 majority bits over the hashes of a lower-cased text's word shingles; no word: 0."""
    # bytes: only A-Z change, only ASCII blanks split
    return majority(shingle_hashes(text.encode().lower().split() if text else [], shingle))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every whole text; null texts count as empty."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, texts = columns(batch, "doc_id", "text")
            fps = np.array([simhash(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps)], names=["doc_id", "fp"])

        return step

    return map_batches(only(docs, "doc_id", "text"), "doc_id bigint, fp bigint", make)


def flips(bits: int, upto: int) -> list[np.ndarray]:
    """For each count 0..upto the masks with so many of the low bits set."""
    return [
        np.array([sum(1 << b for b in c) for c in combinations(range(bits), k)], dtype=np.uint64) for k in range(upto + 1)
    ]


def address_bits(n: int, spare: int = 6, bits: int = 64) -> int:
    """Leading bits that address a block of variants, so that blocks stay at some ten thousand fingerprints at any size."""
    return max(4, min(bits // 2, math.ceil(math.log2(max(n, 2))) - spare))


def _send(lead: int, radius: int):
    """Batches of fp -> rows (block, fp): every block that the ball around fp reaches."""
    masks = np.concatenate(flips(lead, radius))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            block = (fp >> np.uint64(64 - lead))[:, None] ^ masks[None, :]
            return pa.RecordBatch.from_arrays(
                [pa.array(block.astype(np.int64).ravel()), pa.array(np.repeat(fp, len(masks)).view(np.int64))], names=["block", "fp"]
            )

        return step

    return make


def _pieces(at: np.ndarray, row: np.ndarray, fp: np.ndarray, lead: int, left: np.ndarray, radius: int) -> Iterator[tuple]:
    """Rows (variants of fp[row] that begin with the lead bits `at`, with `left` bits still to flip) in pieces of whole addresses.

    An address with too many variants is split by further bits, so each variant is spelt out in one piece only.
    """
    order = np.argsort(at, kind="stable")
    at, row, left = at[order], row[order], left[order]
    weight = np.cumsum([math.comb(64 - lead, k) for k in range(radius + 1)])[left]
    ends = np.concatenate([np.nonzero(at[1:] != at[:-1])[0] + 1, [len(at)]])
    total = np.concatenate([[0], np.cumsum(weight)])
    start = 0
    for end, after in zip(ends.tolist(), [*ends[1:].tolist(), None]):
        size = total[end] - total[start]
        if after is not None and total[after] - total[start] <= PIECE:
            continue
        cut = slice(start, end)
        start = end
        if size <= PIECE or lead + SPLIT > 60:
            yield at[cut], row[cut], lead, left[cut]
            continue
        shift = np.uint64(64 - lead - SPLIT)
        low = np.uint64((1 << SPLIT) - 1)
        parts = []
        for w, masks in enumerate(flips(SPLIT, radius)):
            able = left[cut] >= w
            bits = (fp[row[cut][able]] >> shift & low)[:, None] ^ masks[None, :]
            parts.append(((at[cut][able][:, None] | bits << shift).ravel(), np.repeat(row[cut][able], len(masks)), np.repeat(left[cut][able] - w, len(masks))))
        a, r, f = (np.concatenate(x) for x in zip(*parts))
        yield from _pieces(a, r, fp, lead + SPLIT, f, radius)


def _meetings(block: np.ndarray, fp: np.ndarray, lead: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(group, row) of the variants that several rows share; rows are those of whole blocks."""
    left = radius - np.bitwise_count((fp >> np.uint64(64 - lead)) ^ block).astype(np.int64)
    masks_of: dict[int, list[np.ndarray]] = {}
    for at, row, bits, room in _pieces(block << np.uint64(64 - lead), np.arange(len(fp)), fp, lead, left, radius):
        inner = masks_of.setdefault(bits, flips(64 - bits, radius))
        base = at | (fp[row] & np.uint64((1 << (64 - bits)) - 1))
        variants, owners = [], []
        for r in range(radius + 1):
            mine = np.nonzero(room == r)[0]
            masks = np.concatenate(inner[: r + 1])
            variants.append((base[mine][:, None] ^ masks[None, :]).ravel())
            owners.append(np.repeat(row[mine], len(masks)))
        v, o = np.concatenate(variants), np.concatenate(owners)
        ordered = np.sort(v)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            at_twice = np.minimum(np.searchsorted(twice, v), len(twice) - 1)
            hit = twice[at_twice] == v
            yield at_twice[hit], o[hit]


def _stars(group: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Links (owner, least owner of its group)."""
    order = np.lexsort((owner, group))
    group, owner = group[order], owner[order]
    first = np.concatenate([[True], group[1:] != group[:-1]])
    least = owner[np.nonzero(first)[0]][np.cumsum(first) - 1]
    pairs = np.stack([owner, least], axis=1)[owner != least]
    return np.unique(pairs, axis=0) if len(pairs) else np.empty((0, 2), dtype=np.int64)


def _by_whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by block, regrouped so that no block is torn."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        whole = int(np.searchsorted(cols[0], cols[0][-1]))  # the last block may go on in the next batch
        if whole:
            held.append([c[:whole] for c in cols])
            yield [np.concatenate(c) for c in zip(*held)]
            held = []
        held.append([c[whole:] for c in cols])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _links(pairs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    pairs = [p for p in pairs if len(p)]
    if pairs:
        out = np.unique(np.concatenate(pairs), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0].copy()), pa.array(out[:, 1].copy())], names=["a", "b"])


def ball_links(fps: DataFrame, radius: int = 2, n: int | None = None) -> DataFrame:
    """a, b: links between the distinct fingerprints in column fp that span every group within 2*radius bits.

    For any two fingerprints at most 2*radius bits apart, both are linked to one third (or one to the
    other), whose distance to each is within 2*radius too.
    """
    n = fps.count() if n is None else n
    lead = address_bits(n)
    sent_each = sum(math.comb(lead, k) for k in range(radius + 1))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, fp in _by_whole_blocks(batches):
            found = [_stars(g, fp[o]) for g, o in _meetings(block.view(np.uint64), fp.view(np.uint64), lead, radius)]
            near = [p[np.bitwise_count((p[:, 0] ^ p[:, 1]).view(np.uint64)) <= 2 * radius] for p in found]  # verify
            yield from _links(near)

    sent = map_batches(fps.select("fp"), "block bigint, fp bigint", _send(lead, radius))
    dealt = sent.repartition(max(32, math.ceil(n * sent_each / ROWS_EACH)), "block").sortWithinPartitions("block")
    return dealt.mapInArrow(meet, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs.

    component_id is the smallest doc_id among the rows whose fingerprints are reachable over links
    of at most 2*radius differing bits. Null and wordless texts have fingerprint zero. Rows with a
    null doc_id keep it; they link others but are no component_id unless nothing else is there.
    Repeated rows stay repeated. An empty table gives an empty one.
    """
    prints = cut(fingerprints(docs, shingle), "simhash")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    links = cut(ball_links(nodes, radius).distinct(), "simhash-links")
    labels = connected_components(links)
    classed = nodes.join(labels, nodes.fp == labels.node, "left").select(
        nodes.fp.alias("fp"), "least", F.coalesce("label", nodes.fp).alias("label")
    )
    classed = cut(classed, "simhash-classes")
    drop(links)
    ids = cut(classed.groupBy("label").agg(F.min("least").alias("component_id")), "simhash-ids")
    by_print = cut(classed.join(ids, "label").select("fp", "component_id"), "simhash-by-print")
    out = prints.join(by_print, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: The near-copy stage: words of a shingle and least Jaccard similarity.
SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Buckets of up to so many texts give all their pairs at once; in larger ones texts meet in cells of at most two
#: times CELL texts.
SMALL, CELL = 8, 1000
#: Different texts, about, and shingles at most from which the order of shingles is made.
ORDER_TEXTS, ORDER_SHINGLES = 20_000, 100_000
#: Bits of the maps of a text's shingles that bound similarities: of every text, and of those that meet in cells.
MAP_BITS, CELL_BITS = 2048, 8192


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with k1 and k2, together 128 bits that stand for the text."""
    return docs.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")})


def _distinct_hashes(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes((text or "").encode().split(), SHINGLE_WORDS))


def _map_of(grams: np.ndarray, bits: int) -> np.ndarray:
    """A map of so many bits, in longs, with a bit set for each shingle."""
    on = np.zeros(bits, dtype=bool)
    on[(grams.view(np.uint64) >> np.uint64(17)) % np.uint64(bits)] = True
    return np.packbits(on).view(np.int64)


def _common_shingles(keyed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (ascending) that several different texts of a bounded sample hold, and their counts there.

    They order the shingles of a text, rare ones first: any fixed order gives the same links, with this one hot
    passages seldom stand in a prefix. Those in more than SMALL texts are also known to have large buckets.
    """
    n = keyed.count()
    some = keyed.where(F.pmod("k1", F.lit(max(1, math.ceil(n / ORDER_TEXTS)))) == 0).dropDuplicates(["k1", "k2"]).repartition(64, "k1")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([_distinct_hashes(t) for t in columns(batch, "text")[0]]).view(np.int64))], names=["gram"])

        return step

    seen = map_batches(some.select("text"), "gram bigint", make).groupBy("gram").count().where("count > 2")
    rows = seen.orderBy(F.desc("count"), "gram").limit(ORDER_SHINGLES).toPandas().sort_values("gram")
    return rows["gram"].to_numpy(dtype=np.int64), rows["count"].to_numpy(dtype=np.int64)


def _prefix(grams: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set in the common order, so many that sets of SIMILARITY share one of theirs; and their counts."""
    place = np.zeros(len(grams), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        place = np.where(common[at] == grams, counts[at], 0)
    length = len(grams) - math.ceil(SIMILARITY * len(grams) - 1e-9) + 1
    first = np.lexsort((grams, place))[:length]
    return grams[first], place[first]


def _profiles(keyed: DataFrame, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """doc_id, k1, k2 of each row; fp, size, prefix, hot (tokens known to have large buckets) and map unless its task has met the text before."""

    def make():
        seen: set[int] = set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, k1, k2, texts = columns(batch, "doc_id", "k1", "k2", "text")
            made = []
            for key, t in zip(zip(k1, k2), texts):
                if key in seen:
                    made.append((None,) * 5)
                    continue
                if len(seen) < 50_000:
                    seen.add(key)
                h = shingle_hashes(t.encode().split(), SHINGLE_WORDS)
                grams = np.unique(h).view(np.int64)
                first, place = _prefix(np.sort(grams), common, counts)
                made.append((int(np.uint64(majority(h)).astype(np.int64)), len(grams), first, place > SMALL, _map_of(grams, MAP_BITS)))
            types = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((ids, k1, k2, *zip(*made)), types)], names=["doc_id", "k1", "k2", "fp", "size", "prefix", "hot", "map"])

        return step

    shape = "doc_id bigint, k1 bigint, k2 bigint, fp bigint, size bigint, prefix array<bigint>, hot array<boolean>, map array<bigint>"
    return map_batches(keyed.select("doc_id", "k1", "k2", "text"), shape, make)


def _can_reach(size_a: np.ndarray, left_a: np.ndarray, size_b: np.ndarray, left_b: np.ndarray) -> np.ndarray:
    """Whether two sets can be SIMILARITY alike if their first common shingle has so many left from it on in each."""
    return np.minimum(left_a, left_b) * (1 + SIMILARITY) >= SIMILARITY * (size_a + size_b) - 1e-6


def _pair_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)


def _open_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, id, size, left) by token -> pairs of small buckets (large false: a, b), rows of large ones (large true: token, id, size, left).

    A bucket that outgrows SMALL passes through row by row, so no more than a batch is held.
    """
    held: list[np.ndarray] | None = None  # rows of the last token so far, if they are few
    passing = None  # the token whose rows pass through
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if held is not None:
            cols = [np.concatenate(c) for c in zip(held, cols)]
        token, node, size, left = cols
        if not len(token):
            continue
        begin = np.concatenate([[True], token[1:] != token[:-1]])
        first = np.nonzero(begin)[0]
        count = np.diff(np.concatenate([first, [len(token)]]))[np.cumsum(begin) - 1]
        large = count > SMALL
        if passing is not None:
            large |= token == passing
        last = token == token[-1]
        passing = token[-1] if large[-1] else None
        ready = np.ones(len(token), dtype=bool) if passing is not None else ~last
        held = None if passing is not None else [c[last] for c in cols]
        yield from _small_pairs(token, node, size, left, ~large & ready)
        out = large & ready
        if out.any():
            yield _bucket_rows(np.ones(int(out.sum()), dtype=bool), *(c[out] for c in cols))
    if held is not None and len(held[0]):
        yield from _small_pairs(*held, np.ones(len(held[0]), dtype=bool))


def _bucket_rows(large, a, b, c, d) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (large, a, b, c, d)], names=["large", "token", "id", "size", "left"])


def _small_pairs(token, node, size, left, use) -> Iterator[pa.RecordBatch]:
    token, node, size, left = (x[use] for x in (token, node, size, left))
    found = []
    for off in range(1, SMALL):
        i = np.nonzero(token[off:] == token[:-off])[0]
        if not len(i):
            break
        good = i[_can_reach(size[i], left[i], size[i + off], left[i + off])]
        found.append((node[good], node[good + off]))
    if found and sum(len(x) for x, _ in found):
        pairs = _pair_rows(*(np.concatenate(x) for x in zip(*found)))
        zero = np.zeros(len(pairs), dtype=np.int64)
        yield _bucket_rows(np.zeros(len(pairs), dtype=bool), pairs[:, 0].copy(), pairs[:, 1].copy(), zero, zero)


def _cell_pairs(every: bool):
    """Whole cells (cell, side, id, size, left, label, map) -> candidate pairs a, b of different labels.

    Rows of side 0 have one label in common and meet only those of side 1; rows of side 2 meet all of the cell, of side 3 those of
    side 4. Pairs that the sizes, the places of the token or the maps of shingles exclude are no candidates. With
    every, all candidates come out. Else a star for each of the best placed texts, and for each text of side 1 its best
    partner: once these are verified and joined, few candidates of different labels are left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, side, node, size, left, label, maps in _by_whole_blocks(batches):
            ends = np.concatenate([np.nonzero(cell[1:] != cell[:-1])[0] + 1, [len(cell)]])
            start, found = 0, []
            for end in ends.tolist():
                here = slice(start, end)
                start = end
                words = np.stack(maps[here]).view(np.uint64)
                found += _meet_cell(side[here], node[here], size[here], left[here], label[here], words, every)
            if found:
                yield from _links([_pair_rows(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))])

    return run


def _meet_cell(side, node, size, left, label, words, every) -> list[tuple[np.ndarray, np.ndarray]]:
    one = np.nonzero((side == 0) | (side == 2) | (side == 3))[0]
    two = np.nonzero((side == 1) | (side == 2) | (side == 4))[0]
    if not len(one) or not len(two):
        return []
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    likeness = np.zeros((len(one), len(two)), dtype=np.float32)
    for k in range(0, len(one), 16):
        i, j = one[k : k + 16][:, None], two[None, :]
        both = np.bitwise_count(words[i[:, 0]][:, None, :] & words[two][None, :, :]).sum(axis=2, dtype=np.int64)
        # a bit of one map that the other lacks is a shingle that the other lacks
        most = np.minimum(size[i] - (ones[i] - both), size[j] - (ones[j] - both))
        fits = (label[i] != label[j]) & _can_reach(size[i], left[i], size[j], left[j]) & (most * (1 + SIMILARITY) >= SIMILARITY * (size[i] + size[j]) - 1e-6)
        likeness[k : k + 16] = np.where(fits, both / np.maximum(1, ones[i] + ones[j] - both) + 1e-6, 0)
    if every:
        x, y = np.nonzero(likeness)
    elif side[one[0]] == 0:
        y = np.nonzero(likeness.any(axis=0))[0]
        x = likeness[:, y].argmax(axis=0)
    else:
        x, y = _best_stars(likeness, one, two)
    return [(node[one[x]], node[two[y]])] if len(x) else []


def _best_stars(likeness: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars around the texts with most candidates, until every text with a candidate is in one."""
    same = one[0] == two[0]  # a cell that meets itself
    open_two, xs, ys = np.ones(len(two), dtype=bool), [], []
    for c in np.argsort(-(likeness > 0).sum(axis=1), kind="stable").tolist():
        if same and not open_two[c]:
            continue
        near = np.nonzero((likeness[c] > 0) & open_two)[0]
        if not len(near):
            continue
        xs.append(np.full(len(near), c))
        ys.append(near)
        open_two[near] = False
        if same:
            open_two[c] = False
    # a text whose candidates are all in other stars joins its best one
    lone = np.nonzero((likeness > 0).any(axis=0) & open_two)[0]
    xs.append(likeness[:, lone].argmax(axis=0))
    ys.append(lone)
    return np.concatenate(xs), np.concatenate(ys)


#: Rows up to which a table of texts' hashes is broadcast; a larger one is joined by a shuffle.
SMALL_TABLE = 100_000


def _few(df: DataFrame) -> DataFrame:
    """df for a join: broadcast if its size, which is looked at, allows."""
    return F.broadcast(df) if df.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE else df.hint("merge")


def _grams(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, grams (different shingle hashes) and a map of them of the wanted texts (id, k1, k2), stored."""
    chosen = keyed.join(_few(wanted), ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("id", "text")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, texts = columns(batch, "id", "text")
            grams = [_distinct_hashes(t).view(np.int64) for t in texts]
            longs = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(grams, longs), pa.array([_map_of(g, CELL_BITS) for g in grams], longs)], names=["id", "grams", "map"])

        return step

    return cut(map_batches(chosen, "id bigint, grams array<bigint>, map array<bigint>", make), "near-grams")


def _within_reach(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that can be SIMILARITY alike by their sizes and maps: a bit that only one map has is a shingle that only one text has."""
    m = nodes.select("id", "size", "map", F.aggregate("map", F.lit(0), lambda s, x: s + F.bit_count(x)).alias("ones"))
    both = pairs.join(m.select(*[F.col(c).alias(f"{c}_a") for c in m.columns]), F.col("a") == F.col("id_a"))
    both = both.join(m.select(*[F.col(c).alias(f"{c}_b") for c in m.columns]), F.col("b") == F.col("id_b"))
    same = F.aggregate(F.zip_with("map_a", "map_b", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)
    most = F.least(F.col("size_a") - F.col("ones_a") + same, F.col("size_b") - F.col("ones_b") + same)
    return both.where(most * (1 + SIMILARITY) >= SIMILARITY * (F.col("size_a") + F.col("size_b")) - 1e-6).select("a", "b")


def _by_size(large: DataFrame) -> DataFrame:
    """Rows of large buckets, parted by size: token, id, size, left of those that can have a partner.

    Alike sets have sizes in a ratio of SIMILARITY at least, so in the same class of sizes or the next; and the
    token must stand early enough in the smaller one (`starts`) for the larger one to be within its reach.
    """
    reach = F.col("left") * (1 + SIMILARITY) / SIMILARITY - F.col("size") + 1e-6
    step = F.floor(F.log("size") / F.log(F.lit(1 / SIMILARITY)))
    rows = large.select("token", "id", "size", "left", reach.alias("reach"), F.explode(F.array(step, step - 1)).alias("class"), step.alias("own"))
    rows = rows.withColumn("starts", (F.col("class") == F.col("own")) & (F.col("reach") >= F.col("size")))
    first = F.when(F.col("starts"), F.col("size"))
    per = rows.groupBy("token", "class").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("least"), F.max(F.when(F.col("starts"), F.col("reach"))).alias("far"))
    near = rows.join(per.where("n > 1 AND least IS NOT NULL"), ["token", "class"]).where("starts OR (least <= reach AND size <= far)")
    return near.select(F.xxhash64("token", "class").alias("token"), "id", "size", "left")


def _alike(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """The pairs whose shingle sets are SIMILARITY alike, stored; only sets of texts in a pair are moved."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    g = grams.select("id", "grams").join(_few(ids), "id", "left_semi")
    both = g.withColumnsRenamed({"id": "a", "grams": "ga"}).join(_few(pairs), "a").join(g.withColumnsRenamed({"id": "b", "grams": "gb"}), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    return cut(both.where(shared >= SIMILARITY * (F.size("ga") + F.size("gb") - shared) - 1e-9).select("a", "b"), "near-links")


def _cells(large: DataFrame, labels: DataFrame, grams: DataFrame) -> DataFrame:
    """Rows of large buckets that hold several labels, dealt into cells in which every two of different labels meet.

    The texts of a bucket's most frequent label meet only the others, so a bucket of one big group and few others is
    passed through once.
    """
    l = large.join(labels, large["id"] == labels["node"], "left").select("token", "id", "size", "left", F.coalesce("label", "id").alias("label"))
    l = cut(l, "near-large")
    each = l.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
    per = each.groupBy("token").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("all")).where("m.n < all")
    per = per.select("token", F.col("m.label").alias("main"), F.ceil(F.col("m.n") / CELL).alias("mains"), F.ceil((F.col("all") - F.col("m.n")) / CELL).alias("others"))
    l = l.join(per, "token").join(grams.select("id", "map"), "id")
    is_main, part = F.col("label") == F.col("main"), F.xxhash64("id")
    zero = F.lit(0).cast("bigint")
    at = lambda kind, x, y, side: F.struct(F.xxhash64("token", F.lit(kind), x, y).alias("cell"), F.lit(side).cast("bigint").alias("side") if isinstance(side, int) else side.cast("bigint").alias("side"))
    p, q = F.pmod(part, F.col("mains")), F.pmod(part, F.col("others"))
    of_main = F.transform(F.sequence(zero, F.col("others") - 1), lambda y: at(0, p, y, 0))
    of_other = F.concat(
        F.transform(F.sequence(zero, F.col("mains") - 1), lambda x: at(0, x, q, 1)),
        F.transform(F.sequence(zero, F.col("others") - 1), lambda y: at(1, F.least(q, y), F.greatest(q, y), F.when(q == y, 2).when(q < y, 3).otherwise(4))),
    )
    l = l.withColumn("c", F.explode(F.when(is_main, of_main).otherwise(of_other)))
    return l.select("c.cell", "c.side", "id", "size", "left", "label", "map")


def _links_in_large(large: DataFrame, grams: DataFrame, links: DataFrame) -> DataFrame:
    """links and those between texts of large buckets that are still in different groups: first by stars, then all that is left."""
    for every in (False, True):
        labels = connected_components(links)
        cells = _cells(large, labels, grams).repartition("cell").sortWithinPartitions("cell", "side", "id")
        pairs = cut(cells.mapInArrow(_cell_pairs(every), "a bigint, b bigint").distinct(), "near-pairs")
        if not pairs.limit(1).count():
            break
        links = cut(links.union(_alike(pairs, grams)), "near-links")
        drop(pairs)
    return links


def near_copy_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of the texts of docs (doc_id, text with a word).

    nodes: id, k1, k2, least (smallest doc_id) of every different text. links: a, b, ids of texts whose sets of
    five-word shingles are at least 0.8 alike, by Jaccard; they span every group of such texts, none is missed.

    Texts meet first where variants of their fingerprints meet (ball hashing): that joins most copies. What
    fingerprints tell apart meets by a prefix filter: with the shingles of all texts in one order, two texts of
    similarity 0.8 share one of their first fifth. Every candidate is verified on the shingles.
    """
    keyed = _keyed(docs)
    common, counts = _common_shingles(keyed)
    rows = _profiles(keyed, common, counts)
    per = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), *[F.first(c, ignorenulls=True).alias(c) for c in ("fp", "size", "prefix", "hot", "map")])
    nodes = cut(per.withColumn("id", F.monotonically_increasing_id()), "near-nodes")

    prints = cut(nodes.groupBy("fp").agg(F.min("id").alias("rep")), "near-prints")
    balls = ball_links(prints).distinct()
    ball_pairs = balls.join(prints.withColumnsRenamed({"fp": "a", "rep": "ra"}), "a").join(prints.withColumnsRenamed({"fp": "b", "rep": "rb"}), "b").select("ra", "rb")
    same_print = nodes.select("id", "fp").join(prints, "fp").where("id <> rep").select("id", "rep")
    met = ball_pairs.union(same_print).select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b"))

    tokens = nodes.select("id", "size", F.posexplode(F.arrays_zip("prefix", "hot")).alias("pos", "t"))
    tokens = tokens.select(F.col("t.prefix").alias("token"), "id", "size", (F.col("size") - F.col("pos")).alias("left"), F.col("t.hot").alias("hot"))
    shape = "large boolean, token bigint, id bigint, size bigint, left bigint"
    # a bucket known to be large needs no counting: its rows are not brought together here
    known = tokens.where("hot").select(F.lit(True).alias("large"), "token", "id", "size", "left")
    many = nodes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    dealt = tokens.where("NOT hot").drop("hot").repartition(max(32, math.ceil(many / ROWS_EACH)), "token").sortWithinPartitions("token")
    buckets = cut(dealt.mapInArrow(_open_buckets, shape).union(known), "near-buckets")
    small = buckets.where("NOT large").select(F.col("token").alias("a"), F.col("id").alias("b"))
    pairs = cut(_within_reach(met.union(small).distinct(), nodes), "near-pairs")
    large = cut(_by_size(buckets.where("large")), "near-large")
    drop(buckets)
    free(docs.sparkSession)

    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(large.select("id")).distinct()
    grams = _grams(keyed, cut(nodes.select("id", "k1", "k2").join(wanted, "id"), "near-wanted"))
    links = _alike(pairs, grams)
    drop(pairs)
    if large.limit(1).count():
        links = _links_in_large(large, grams, links)
    drop(grams)
    drop(large)
    free(docs.sparkSession)
    return nodes.select("id", "k1", "k2", "least"), links


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs without copies: of each group of equal or near-equal texts the row of the smallest doc_id stays.

    Texts are near-equal if their sets of five-word shingles have a Jaccard similarity of 0.8 or more;
    groups are connected over such links, and no link is missed (see near_copy_links). Texts without a
    word, and null texts, are no copies of anything. A null doc_id comes last; of rows that repeat both
    doc_id and text one stays. Two texts count as equal if 128 bits of hashes are.
    """
    has_word = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    named = docs.where(has_word).select("doc_id", "text")
    nodes, links = near_copy_links(named)
    labels = connected_components(links)
    nodes = cut(nodes.join(labels, nodes["id"] == labels["node"], "left").select("k1", "k2", "least", "id", F.coalesce("label", "id").alias("label")), "near-groups")
    order = F.struct(F.col("least").isNull(), F.col("least"), F.col("id"))
    heads = nodes.groupBy("label").agg(F.min_by(F.struct("k1", "k2", "least"), order).alias("h")).select("h.*")
    heads = cut(heads, "near-heads")
    # all rows but those that stay; usually the smaller part
    rows = cut(_keyed(named).select("doc_id", "k1", "k2"), "near-rows")
    same = F.col("doc_id").eqNullSafe(F.col("least"))
    stays = rows.join(heads.withColumn("head", F.lit(True)), ["k1", "k2"], "left").withColumn("stays", F.coalesce(F.col("head") & same, F.lit(False)))
    stays = cut(stays.groupBy("doc_id", "k1", "k2").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")), "near-stays")
    twice = stays.where("stays AND n > 1").limit(1).count()
    gone = stays.where("NOT stays").select(F.col("doc_id").alias("_g"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    gone = _few(gone)
    names = docs.columns
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "doc_id", "text").withColumn("_word", has_word)
    d = _keyed(d.withColumn("text", F.when(F.col("_word"), F.col("text"))))
    out = d.join(gone, d["_word"] & (d["k1"] == gone["_k1"]) & (d["k2"] == gone["_k2"]) & d["doc_id"].eqNullSafe(gone["_g"]), "left_anti")
    if twice:
        out = out.where("_word").dropDuplicates(["doc_id", "k1", "k2"]).unionByName(out.where("NOT _word"))
    return out.select(*[F.col("_row").getField(c).alias(c) for c in names])
