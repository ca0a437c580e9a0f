"""Token counts by prefix dynamic programming over a sentencepiece BPE model.

For BPE the encoding of a text is the one split into pieces in which every two neighbouring
pieces stay apart when their joined surface is encoded alone. So the last piece of every prefix
follows from the last pieces of shorter prefixes, and one pass over a text yields the exact token
count of *every* prefix. Texts are cut where no piece of the vocabulary can cross (before a run
of spaces and around characters that no longer piece contains), so tables are kept per segment and
joined by running sums; budget and truncation questions are then lookups.

Runs of spaces are the exception to the pair rule, as the pieces of such runs tie in score. They are also the
last pieces to be merged, so a run of any length has a count of its own, from one table by run length, and the
word behind it takes the last space or not, as it does when it stands alone.

Null and empty texts have no tokens. Repeated rows give repeated rows. Length is not limited.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import columns, map_batches, only

#: Segments kept per Python worker; the table is emptied when full, which costs time only.
CACHE = 200_000
#: Segments longer than this are not kept.
LONG = 256
SPACE = "▁"
LATIN = "A-Za-z\\u00c0-\\u024f"


class PrefixCounter:
    """Token counts of every prefix of a text, for one sentencepiece BPE model."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.score: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
                self.score[sp.id_to_piece(i)] = sp.get_score(i)
        inner = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        # A text may be cut between two characters that are neighbours in no piece. Checked here
        # once: before a space run, around a line feed, and between Latin letters and the rest.
        letter = lambda c: bool(re.match(f"[{LATIN}]", c))
        crossed = any(letter(x[0]) != letter(x[1]) and x[0] != SPACE for x in inner)
        self.can_cut = not crossed and not any("\n" in x or (x[1] == SPACE != x[0]) for x in inner)
        self.segment = re.compile(rf" *[{LATIN}]+| *[^{LATIN} \n]+|\n| +" if self.can_cut else r"(?s).+")
        #: Pieces by their characters from the last to the first; None marks a whole piece.
        self.endings: dict = {}
        for piece in self.score:
            if len(piece) == 1 or self.merge(piece) == [piece]:
                node = self.endings
                for c in reversed(piece):
                    node = node.setdefault(c, {})
                node[None] = piece
        runs = [p for p in self.score if set(p) == {SPACE} and len(p) > 1]
        others = [v for p, v in self.score.items() if set(p) != {SPACE}]
        #: Whether runs of spaces are merged after all else, leftmost first.
        self.runs_last = self.can_cut and len({self.score[p] for p in runs}) <= 1 and all(self.score[p] < min(others) for p in runs)
        self.run_lengths = {len(p) for p in runs}
        #: Tokens of a run by its length, and the pieces of the longest run so far.
        self.run_counts, self.run_pieces = array("q", [0]), []
        self.tables: dict[str, tuple[tuple[int, ...], tuple[bool, ...]]] = {}
        self.totals: dict[str, int] = {}
        self.apart: dict[str, dict[str, bool]] = {}

    def merge(self, text: str) -> list[str]:
        """Plain BPE of a short surface: the best-scored neighbouring pair first, leftmost on ties."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stay_apart(self, left: str, right: str) -> bool:
        if len(self.apart) >= CACHE:
            self.apart.clear()
        known = self.apart.setdefault(left, {})
        if right not in known:
            known[right] = self.merge(left + right) == [left, right]
        return known[right]

    def run(self, n: int) -> int:
        """Tokens of n spaces: each further space joins the pieces at the end, as merges are made from the left."""
        pieces = self.run_pieces
        while len(self.run_counts) <= n:
            pieces.append(1)
            while len(pieces) > 1 and pieces[-2] + pieces[-1] in self.run_lengths:
                pieces[-2:] = [pieces[-2] + pieces[-1]]
            self.run_counts.append(len(pieces))
        return self.run_counts[n]

    def table(self, surface: str) -> tuple[int, ...]:
        """Token counts after 0, 1, 2, ... characters of a segment (spaces already written as U+2581)."""
        word = surface.lstrip(SPACE)
        lead = len(surface) - len(word)
        if lead < 2:
            return self.prefixes(surface)[0]
        if not self.runs_last:
            return tuple([0] + [self.whole(surface[:i]) for i in range(1, len(surface) + 1)])
        return tuple([self.run(i) for i in range(lead + 1)] + [self.behind_run(lead, n, alone) for n, alone in zip(*(x[2:] for x in self.prefixes(SPACE + word)))])

    def total(self, surface: str) -> int:
        """The last entry of the table, without the table of a run of spaces."""
        word = surface.lstrip(SPACE)
        lead = len(surface) - len(word)
        if lead < 2:
            return self.prefixes(surface)[0][-1]
        if not self.runs_last:
            return self.whole(surface)
        return self.behind_run(lead, *(x[-1] for x in self.prefixes(SPACE + word))) if word else self.run(lead)

    def behind_run(self, lead: int, n: int, alone: bool) -> int:
        """Tokens of lead spaces and a word that has n tokens with one space, alone if that space is a token."""
        return self.run(lead) + n - 1 if alone else self.run(lead - 1) + n

    def prefixes(self, surface: str) -> tuple[tuple[int, ...], tuple[bool, ...]]:
        """For every prefix of a segment with at most one space in front: its tokens, and whether the first one is that space."""
        got = self.tables.get(surface)
        if got is not None:
            return got
        apart, endings = self.apart, self.endings
        last, counts, alone = [""], [0], [False]
        for i in range(len(surface)):
            node, j, found = endings, i, ""
            while j >= 0 and (node := node.get(surface[j])) is not None:
                piece = node.get(None)
                if piece is not None:
                    if not j:
                        found = piece
                        break
                    before = last[j]
                    known = apart.get(before)
                    ok = known.get(piece) if known is not None else None
                    if ok if ok is not None else self.stay_apart(before, piece):
                        found = piece
                        break
                j -= 1
            if found:
                counts.append(counts[j] + 1)
                alone.append(alone[j] if j else found == SPACE)
            else:  # a character outside the vocabulary: one token for each of its bytes
                found = surface[i]
                counts.append(counts[i] + len(found.encode()))
                alone.append(alone[i])
            last.append(found)
        if len(self.tables) >= CACHE:
            self.tables.clear()
        out = (tuple(counts), tuple(alone))
        if len(surface) <= LONG:
            self.tables[surface] = out
        return out

    def whole(self, surface: str) -> int:
        """The library's count of a segment that begins with a space; it puts the first one in front itself."""
        text = surface[1:].replace(SPACE, " ")
        return len(self.sp.encode(text)) if text else self.tokens(self.merge(surface))

    def tokens(self, parts: list[str]) -> int:
        return sum(1 if p in self.score else len(p.encode()) for p in parts)

    def surfaces(self, text: str) -> list[str]:
        """The segments of a text as the model sees them: a space in front, spaces as U+2581."""
        if not text:
            return []
        return [s.replace(" ", SPACE) for s in self.segment.findall(" " + text.replace(SPACE, " "))]

    def count(self, text: str) -> int:
        """The last prefix count, by running sums over the segments' tables."""
        if not text:
            return 0
        totals, n = self.totals, 0
        for raw in self.segment.findall(" " + text.replace(SPACE, " ")):
            got = totals.get(raw)
            if got is None:
                got = self.total(raw.replace(" ", SPACE))
                if len(totals) >= CACHE:
                    totals.clear()
                if len(raw) <= LONG:
                    totals[raw] = got
            n += got
        return n

    def prefix_counts(self, text: str) -> np.ndarray:
        """Exact token counts of text[:0], text[:1], ..., text[:len(text)]."""
        out, base = [0], 0
        for k, s in enumerate(self.surfaces(text)):
            t = self.table(s)
            # the model's own leading space is not a character of the text
            out.extend(base + c for c in t[2 if k == 0 else 1 :])
            base += t[-1]
        return np.array(out, dtype=np.int64)

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix such that neither it nor a shorter prefix needs more than budget tokens."""
        over = np.nonzero(self.prefix_counts(text) > budget)[0]
        return text if not len(over) else text[: int(over[0]) - 1]


_COUNTERS: dict[int, PrefixCounter] = {}


def counter(model: bytes) -> PrefixCounter:
    """One counter for each model in a Python process, so that its tables outlive a task."""
    if (key := hash(model)) not in _COUNTERS:
        _COUNTERS[key] = PrefixCounter(model)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, model: bytes, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than limit tokens) of every whole text."""

    def make():
        c = counter(model)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, texts = columns(batch, "doc_id", "text")
            n = [c.count(t) if t else 0 for t in texts]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

        return step

    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return map_batches(only(docs, "doc_id", "text"), schema, make)


def truncate_to_budget(docs: DataFrame, model: bytes, budget: int) -> DataFrame:
    """doc_id and the longest leading part of each text that keeps within a token budget."""

    def make():
        c = counter(model)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, texts = columns(batch, "doc_id", "text")
            cut = [None if t is None else c.truncate(t, budget) for t in texts]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cut, pa.string())], names=["doc_id", "text"])

        return step

    return map_batches(only(docs, "doc_id", "text"), "doc_id bigint, text string", make)
