"""Removal of repeated passages: seeds from winnowed anchors, extension, maximal repeats.

A window is `length` consecutive words. A window's anchor is the least hash among its k-word
grams, so equal windows have the same anchor at the same place, wherever they stand (winnowing).

1. Seed: blocks of documents send the distinct anchors they hold, packed into one row per block
   and hash range; ranges answer which anchors also occur in another block. Anchors that occur
   once end here, with all windows around them.
2. Extend: an anchor that occurs twice is extended both ways, as far as windows keep it as their
   anchor, and each window around it is compared, word by word, with the earliest one that begins like
   it. This is done within a block first; what is the earliest there goes on, as the words themselves, to
   the anchor's range: first among neighbouring blocks, then among all. A passage in a third of all documents
   is so neither gathered nor paired: each step sends on one copy of it.
3. Repeats: windows with an earlier occurrence are joined to maximal runs of words, which go.

"Earlier" is a smaller doc_id, or an earlier start in the same document. Rows that repeat a doc_id
count as different documents in a fixed order; a null doc_id comes after all others. Null, empty
and short texts lose nothing. Hashes only bring windows together: words decide. Blocks and ranges are cut by
bytes of text; a document is never torn.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents and bytes of text in a block, about; bytes for each hash range; partitions whose blocks are compared first;
#: bytes of text hashed at once.
BLOCK, BLOCK_BYTES, RANGE_BYTES, NEAR, CHUNK = 4096, 4 << 20, 8 << 20, 64, 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_LAST = np.iinfo(np.int64).max
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to the powers 0..n-1 and minus those, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, math.ceil(math.log2(n)))
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Block:
    """The documents of one block in their order, with hashes of word sequences."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").to_pylist()
        texts = table.column("text").to_pylist()
        rows = table.column("row").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, rows[i]))
        self.ids = [ids[i] for i in order]
        self.words = [(texts[i] or "").encode().split() for i in order]
        self.counts = np.array([len(w) for w in self.words], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])  # the block's index of each document's first word

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of n words from each word of the block, and whether they are words of one document."""
        total = int(self.first[-1])
        out = np.zeros(total, dtype=np.uint64)
        room = np.repeat(self.first[1:], self.counts) - np.arange(total) >= n
        start, docs = 0, len(self.words)
        while start < docs:
            end, size, parts = start, 0, []
            while end < docs and (end == start or size < CHUNK):
                parts.append(b" ".join(self.words[end]))
                size += len(parts[-1]) + 1
                end += 1
            a, b = int(self.first[start]), int(self.first[end])
            if b > a:
                text = b" ".join(p for p in parts if p) + b" "
                raw = np.frombuffer(text, dtype=np.uint8)
                up, down = _powers(len(raw) + 1)
                # add 1 to each byte, so that a leading NUL counts as well
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1])])
                ends = np.nonzero(raw == 32)[0]
                starts = np.concatenate([[0], ends[:-1] + 1])
                ok = np.nonzero(room[a:b])[0]
                out[a + ok] = _mix((sums[ends[ok + n - 1]] - sums[starts[ok]]) * down[starts[ok]])
            start = end
        return out, room

    def windows(self, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows, and for each the word at which its anchor starts."""
        at = np.nonzero(np.repeat(self.first[1:], self.counts) - np.arange(self.first[-1]) >= length)[0]
        g, _ = self.grams(k)
        span = length - k + 1
        anchor = np.empty(len(at), dtype=np.int64)
        if len(at):
            view = np.lib.stride_tricks.sliding_window_view(g, span)
            for c in range(0, len(at), 1 << 17):
                part = at[c : c + (1 << 17)]
                anchor[c : c + (1 << 17)] = part + view[part].argmin(axis=1)
        self.gram = g
        return at, anchor


def _ranges(h: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash range, and where each range starts in that order."""
    r = ((h >> np.uint64(32)) % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(r, kind="stable")
    return order, np.searchsorted(r[order], np.arange(ranges + 1))


def window_hashes(codes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A hash of the `length` codes from each start: equal sequences have equal ones."""
    up, _ = _powers(length)
    out = np.zeros(len(starts), dtype=np.uint64)
    for k in range(length):
        out += _mix(codes[starts + k].astype(np.uint64) + np.uint64(1)) * up[k]
    return _mix(out)


def first_equal(codes: np.ndarray, starts: np.ndarray, length: int, hashing=window_hashes) -> np.ndarray:
    """For each window, in order, the index of the first window with the same words (codes of words)."""
    hashes = hashing(codes, starts, length)
    first, todo = np.arange(len(starts)), np.arange(len(starts))
    while len(todo):
        _, index, inverse = np.unique(hashes[todo], return_index=True, return_inverse=True)
        lead = todo[index][inverse]
        same = np.ones(len(todo), dtype=bool)
        for k in range(length):
            same &= codes[starts[todo] + k] == codes[starts[lead] + k]
        first[todo[same]] = lead[same]
        todo = todo[~same]  # equal hash, other words
    return first


def _runs(at: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of windows that start one word after the other and share the keys."""
    if not len(at):
        return np.zeros(1, dtype=np.int64)
    new = at[1:] != at[:-1] + 1
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.concatenate([[0], np.nonzero(new)[0] + 1, [len(at)]])


_PACKET = pa.schema([("range", pa.int32()), ("near", pa.int64()), ("block", pa.int64()), ("kind", pa.int8()), ("words", pa.binary()), ("ids", pa.binary()), ("starts", pa.binary()), ("counts", pa.binary())])
_PACKET_SQL = "range int, near bigint, block bigint, kind tinyint, words binary, ids binary, starts binary, counts binary"
_REPLY = pa.schema([("block", pa.int64()), ("range", pa.int32()), ("bits", pa.binary())])
_REPLY_SQL = "block bigint, range int, bits binary"
#: Kinds of packets: anchors or windows to compare, and windows that are known to have an earlier occurrence.
_ASK, _LATER = 0, 1


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _steps(a: np.ndarray) -> bytes:
    return np.diff(a, prepend=0).astype(np.int32).tobytes()


def _seeds(blk: Block, length: int, k: int):
    at, anchor = blk.windows(length, k)
    places = np.unique(anchor)
    hashes, inverse, times = np.unique(blk.gram[places], return_inverse=True, return_counts=True)
    return at, anchor, places, hashes, inverse, times


def _blocked(docs: DataFrame) -> DataFrame:
    """doc_id, text, row, near (a few neighbouring partitions) and block (some neighbouring rows) of every row."""

    def run(batches):
        part = TaskContext.get().partitionId()
        block, rows, size = part << 32, 0, 0
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(pc.cast(b.column("text"), pa.binary())), 0).to_pylist()
            blocks = []
            for n in sizes:
                if rows and (rows >= BLOCK or size + n > BLOCK_BYTES):
                    block, rows, size = block + 1, 0, 0
                rows, size = rows + 1, size + n
                blocks.append(block)
            near = pa.array([part // NEAR] * b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, near, pa.array(blocks, pa.int64())], names=["doc_id", "text", "row", "near", "block"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, "doc_id bigint, text string, row bigint, near bigint, block bigint")


def repeats(docs: DataFrame, length: int = 20, k: int = 8, text_out: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text, and removed [start, end) word runs)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(8, math.ceil(size / RANGE_BYTES))
    base = _blocked(docs)

    def place(table: pa.Table) -> tuple[int, int]:
        return table.column("near")[0].as_py(), table.column("block")[0].as_py()

    def send_seeds(table: pa.Table) -> pa.Table:
        blk, (near, block) = Block(table), place(table)
        *_, hashes, _, _ = _seeds(blk, length, k)
        order, cuts = _ranges(hashes, ranges)
        h = hashes[order]
        return _rows(_PACKET, [(r, near, block, _ASK, h[a:b].tobytes(), b"", b"", b"") for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a])

    def shared_seeds(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x, dtype=np.uint64) for x in table.column("words").to_pylist()]
        _, inverse, times = np.unique(np.concatenate(blobs), return_inverse=True, return_counts=True)
        flag, rows, at = times[inverse] > 1, [], 0
        for r, block, x in zip(table.column("range").to_pylist(), table.column("block").to_pylist(), blobs):
            rows.append((block, r, np.packbits(flag[at : at + len(x)]).tobytes()))
            at += len(x)
        return _rows(_REPLY, rows)

    def send_windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(_PACKET, [])
        blk, (near, block) = Block(table), place(table)
        at, anchor, places, hashes, inverse, times = _seeds(blk, length, k)
        shared = times > 1
        order, cuts = _ranges(hashes, ranges)
        for r, bits in zip(replies.column("range").to_pylist(), replies.column("bits").to_pylist()):
            a, b = cuts[r], cuts[r + 1]
            shared[order[a:b]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        alive = np.zeros(int(blk.first[-1]) + 1, dtype=bool)
        alive[places[shared[inverse]]] = True
        some = alive[anchor]
        at, anchor = at[some], anchor[some]
        known: dict[bytes, int] = {}
        codes = np.fromiter((known.setdefault(w, len(known)) for words in blk.words for w in words), dtype=np.int64, count=int(blk.first[-1]))
        earliest = first_equal(codes, at, length) == np.arange(len(at))
        again, at, anchor = at[~earliest], at[earliest], anchor[earliest]  # an earlier one is in this block
        flat = [w for words in blk.words for w in words]
        ids = np.array([_LAST if i is None else i for i in blk.ids], dtype=np.int64)
        bounds = _runs(at, anchor)
        starts, counts = at[bounds[:-1]], np.diff(bounds)
        owner = ids[np.searchsorted(blk.first, starts, side="right") - 1]
        order, cuts = _ranges(blk.gram[anchor[bounds[:-1]]], ranges)
        rows = []
        for r, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                mine = order[a:b]
                text = b"\n".join(b" ".join(flat[x : x + n + length - 1]) for x, n in zip(starts[mine].tolist(), counts[mine].tolist()))
                rows.append((r, near, block, _ASK, text, owner[mine].tobytes(), starts[mine].astype(np.int32).tobytes(), counts[mine].astype(np.int32).tobytes()))
        if len(again):
            rows.append((block % ranges, near, block, _LATER, b"", b"", _steps(again), b""))
        return _rows(_PACKET, rows)

    def compare(table: pa.Table) -> tuple[list, list]:
        """Rows on windows that have an earlier occurrence here, and rows that hold the others."""
        later_rows, sent = [], []
        for r, near, block, kind, *rest in zip(*(table.column(c).to_pylist() for c in _PACKET.names)):
            if kind == _LATER:
                later_rows.append((r, near, block, _LATER, b"", b"", rest[2], b""))
            else:
                sent.append((r, near, block, rest[0].split(b"\n"), np.frombuffer(rest[1], np.int64), np.frombuffer(rest[2], np.int32), np.frombuffer(rest[3], np.int32)))
        if not sent:
            return later_rows, []
        known: dict[bytes, int] = {}
        codes = np.fromiter((known.setdefault(w, len(known)) for x in sent for run in x[3] for w in run.split(b" ")), dtype=np.int64)
        counts = np.concatenate([x[6] for x in sent]).astype(np.int64)
        sizes = counts + length - 1
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        spread = lambda x: np.repeat(x, counts)  # noqa: E731  from runs to windows
        at = spread(np.cumsum(sizes) - sizes) + inner
        start = spread(np.concatenate([x[5] for x in sent]).astype(np.int64)) + inner
        ids = spread(np.concatenate([x[4] for x in sent]))
        block = spread(np.repeat(np.array([x[2] for x in sent]), [len(x[5]) for x in sent]))
        order = np.lexsort((start, block, ids))
        later = np.zeros(len(at), dtype=bool)
        later[order] = first_equal(codes, at[order], length) != np.arange(len(at))
        rest, end, run = [], 0, 0
        for r, near, blk, runs, owner, first, n in sent:
            mine = slice(end, end + int(n.sum()))
            end = mine.stop
            flag, s = later[mine], start[mine]
            if flag.any():
                later_rows.append((r, near, blk, _LATER, b"", b"", _steps(np.sort(s[flag])), b""))
            open_at, of_run, s, i = np.nonzero(~flag)[0], np.repeat(np.arange(len(n)), n), s[~flag], inner[mine][~flag]
            of_run = of_run[open_at]
            bounds = _runs(s, of_run)
            if len(s):
                lead, size_of = bounds[:-1], np.diff(bounds)
                text = b"\n".join(
                    runs[x] if c == n[x] else b" ".join(runs[x].split(b" ")[a : a + c + length - 1]) for x, a, c in zip(of_run[lead].tolist(), i[lead].tolist(), size_of.tolist())
                )
                rest.append((r, near, blk, _ASK, text, owner[of_run[lead]].tobytes(), s[lead].astype(np.int32).tobytes(), size_of.astype(np.int32).tobytes()))
        return later_rows, rest

    def among_neighbours(table: pa.Table) -> pa.Table:
        later, rest = compare(table)
        return _rows(_PACKET, later + rest)

    def among_all(table: pa.Table) -> pa.Table:
        return _rows(_REPLY, [(row[2], row[0], row[6]) for row in compare(table)[0]])

    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    more = [("kept_text", pa.string()), ("removed", pa.list_(pa.list_(pa.int64())))] if text_out else []
    shape = pa.schema(fields + more)
    sql = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept_text string, removed array<array<bigint>>" if text_out else "")

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(shape, [])
        blk = Block(table)
        edge = np.zeros(int(blk.first[-1]) + 1, dtype=np.int32)
        for bits in replies.column("bits").to_pylist():
            starts = np.cumsum(np.frombuffer(bits, np.int32))
            edge[starts] += 1
            edge[starts + length] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        rows = []
        for d, words in enumerate(blk.words):
            mine = gone[blk.first[d] : blk.first[d + 1]]
            removed = int(mine.sum())
            kept = b" ".join(words if not removed else [w for w, g in zip(words, mine.tolist()) if not g])
            row = (blk.ids[d], len(words), removed, hashlib.sha256(kept).hexdigest())
            if text_out:
                turn = np.diff(np.concatenate([[0], mine.astype(np.int8), [0]]))
                row += (kept.decode(), [list(map(int, x)) for x in zip(np.nonzero(turn == 1)[0], np.nonzero(turn == -1)[0])])
            rows.append(row)
        return _rows(shape, rows)

    # One plan: the exchange of texts by block is made once and read by all three steps.
    seeds = base.groupBy("block").applyInArrow(send_seeds, _PACKET_SQL)
    known = seeds.groupBy("range").applyInArrow(shared_seeds, _REPLY_SQL)
    sent = base.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(send_windows, _PACKET_SQL)
    near = sent.groupBy("range", "near").applyInArrow(among_neighbours, _PACKET_SQL)
    later = near.groupBy("range").applyInArrow(among_all, _REPLY_SQL)
    return base.groupBy("block").cogroup(later.groupBy("block")).applyInArrow(remove, sql)
