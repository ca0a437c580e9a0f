"""Byte-level BPE with a pair occurrence index.

The words of a batch that are not known yet are laid out together. An index maps each
neighbouring pair to all its positions in that layout; a heap gives the active ranks in ascending
order, and applying one rank merges every occurrence at once and updates only the index entries of
the touched neighbours. The outcome for each word equals merging it alone, as the smallest rank of
the whole layout is also the smallest of each word that holds it. Known words are kept in two
generations, so that frequent ones stay when rare ones go.

The tokenizer file (tokenizers JSON: BPE model, end-of-word suffix, byte-level pre-tokenizer) is a
parameter. Added tokens in a text are found before anything else, as that library does. Null and
empty texts have no tokens and decode to the empty text. Repeated rows give repeated rows.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import columns, map_batches, only

#: Words of a generation in a Python worker; when it is full, the one before goes, which costs time only.
CACHE = 150_000
#: No Unicode version differs in what comes before.
BEYOND = re.compile("[\u0370-\U0010ffff]")
SPACES = [chr(c) for c in range(0x3001) if regex.match(r"\p{White_Space}", chr(c))]


def byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def blanks_as_listed(pattern: str) -> str:
    r"""\s as Unicode's White_Space, without the separators U+001C to U+001F that Python adds."""
    return pattern.replace(r"\s", r"\p{White_Space}")


def near_pattern(pattern: str) -> re.Pattern | None:
    r"""The pattern for texts without BEYOND, \p{..} spelt out for the faster engine; None where the two might not agree."""
    bare = re.sub(r"\\p\{\w+\}", "", pattern)
    if not re.fullmatch(r"(?:[\w' |+]|\[\^?\])*", bare):
        return None

    def spelt(m: re.Match) -> str:
        one = regex.compile(m[0])
        return "".join(re.escape(chr(c)) for c in range(0x370) if one.match(chr(c)))

    if re.search(r"\\p", re.sub(r"\[[^]]*\]", "", pattern)):
        return None
    return re.compile(re.sub(r"\\p\{\w+\}", spelt, pattern))


@functools.cache
def unassigned() -> re.Pattern:
    """Characters that this Python's Unicode tables lack: only here can other engines' classes differ."""
    import sys
    import unicodedata

    spans: list[list[int]] = []
    for c in range(0x80, sys.maxunicode + 1):
        if unicodedata.category(chr(c)) == "Cn":
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]")


class PairIndexBPE:
    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("a BPE model without prefix marks or byte fallback is needed")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.text_of = {i: t for t, i in self.vocab.items()}
        # left, right and merged symbol by rank; ranks of the pairs of a left symbol by right one, and the other way
        self.merges: list[tuple[int, int, int]] = []
        self.after: dict[int, dict[int, int]] = {}
        self.before: dict[int, dict[int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right = self.vocab[a], self.vocab[b]
            self.merges.append((left, right, self.vocab[a + b]))
            self.after.setdefault(left, {})[right] = r
            self.before.setdefault(right, {})[left] = r
        self.added: dict[str, int] = {}
        for t in spec.get("added_tokens") or []:
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError("only plain added tokens are supported")
            self.added[t["content"]] = t["id"]
            self.text_of[t["id"]] = t["content"]
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.steps = self._normalizers(spec["normalizer"])
        self.word = self._pattern(spec["pre_tokenizer"])
        self.near = near_pattern(self.word.pattern) or self.word
        if not any(self.word.search(c) or self.word.fullmatch(f"{x}{c}{x}") for c in SPACES for x in "a1!"):
            # words hold no white space, so turning white space into a space leaves them as they are
            self.steps = [x for x in self.steps if x[0] != "Replace" or x[1].pattern != r"\p{White_Space}+" or x[2] not in SPACES]
        if spec.get("decoder") is not None:
            raise ValueError("decoders are not supported: tokens are joined by spaces")
        letters = byte_letters()
        # codes: a byte, 256 + the last byte of a word, 512 between words
        self.symbols = np.array([self.vocab[c] for c in letters] + [self.vocab[c + self.suffix] for c in letters] + [-1])
        self.first = np.array([[self.after.get(a, {}).get(b, -1) for b in self.symbols.tolist()] for a in self.symbols.tolist()], dtype=np.int32)
        self.library = tokenizer_json
        self._pre = None
        self.known: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    @staticmethod
    def _normalizers(spec: dict | None) -> list[tuple]:
        found = []
        for n in spec["normalizers"] if spec and spec["type"] == "Sequence" else [spec] if spec else []:
            if n["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase"):
                found.append((n["type"],))
            elif n["type"] == "Replace":
                p = n["pattern"]
                found.append(("Replace", regex.compile(blanks_as_listed(p["Regex"]) if "Regex" in p else regex.escape(p["String"])), n["content"]))
            else:
                raise ValueError(f"normalizer {n['type']} is not supported")
        return found

    @staticmethod
    def _pattern(spec: dict) -> regex.Pattern:
        parts = spec["pretokenizers"] if spec["type"] == "Sequence" else [spec]
        split = [p for p in parts if p["type"] == "Split"]
        level = [p for p in parts if p["type"] == "ByteLevel"]
        if len(parts) != 2 or not split or not level or level[0]["use_regex"] or level[0]["add_prefix_space"] or split[0]["behavior"] != "Removed" or not split[0]["invert"]:
            raise ValueError("the pre-tokenizer must be a removing inverted split, then bytes")
        return regex.compile(blanks_as_listed(split[0]["pattern"]["Regex"]))

    def normalize(self, text: str) -> str:
        for kind, *rest in self.steps:
            if kind == "Replace":
                text = rest[0].sub(rest[1], text)
            elif kind == "Lowercase":
                # letter by letter, without the final-sigma rule of whole words
                text = text.lower() if "Σ" not in text else "σ".join(t.lower() for t in text.split("Σ"))
            elif not text.isascii():
                text = unicodedata.normalize(kind, text)
        return text

    def words(self, text: str) -> list[str]:
        """Normalize and split a text without added tokens."""
        if text.isascii() or not BEYOND.search(text) or not unassigned().search(text):
            text = self.normalize(text)
            return (self.word if BEYOND.search(text) else self.near).findall(text)
        # letters of other Unicode versions: the classes of the tokenizers library decide
        if self._pre is None:
            from tokenizers import Tokenizer

            self._pre = Tokenizer.from_str(self.library)
            self._back = {c: b for b, c in enumerate(byte_letters())}
        text = self._pre.normalizer.normalize_str(text)
        found = self._pre.pre_tokenizer.pre_tokenize_str(text)
        return [bytes(self._back[c] for c in w).decode() for w, _ in found]

    def pieces(self, text: str | None) -> list[str]:
        """The words of a text; an added token stands in the list behind a space, which no word holds."""
        if not text:
            return []
        if self.split_added is None or not any(a in text for a in self.added):
            return self.words(text)
        out: list[str] = []
        for part in self.split_added.split(text):
            if part in self.added:
                out.append(" " + part)
            elif part:
                out += self.words(part)
        return out

    def learn(self, words: list[str]) -> None:
        """Encode these words together through the pair occurrence index and keep the results."""
        # A symbol -1, which is in no pair, stands around words; what was merged into its left neighbour becomes -2.
        # No byte of UTF-8 is 255.
        code = np.frombuffer(b"\xff".join([b"", *(w.encode() for w in words), b""]), dtype=np.uint8).astype(np.int64)
        around = np.nonzero(code == 255)[0]
        code[around[1:] - 1] += 256
        code[around] = 512
        ranks = self.first[code[:-1], code[1:]]
        places = np.nonzero(ranks >= 0)[0]
        places = places[np.argsort(ranks[places], kind="stable")]
        active, begin = np.unique(ranks[places], return_index=True)
        heap, places = active.tolist(), places.tolist()  # in ascending order, which is a heap
        where = {r: places[a:b] for r, a, b in zip(heap, begin.tolist(), [*begin.tolist()[1:], len(places)])}
        sym, n = self.symbols[code].tolist(), len(code)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        merges, after, before, none = self.merges, self.after, self.before, {}
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            rank = pop(heap)
            found = where.pop(rank)
            left, right, made = merges[rank]
            follow, lead = after.get(made, none), before.get(made, none)
            if left == right:
                found.sort()  # only these overlap: the leftmost first
            for i in found:
                j = nxt[i]
                if sym[i] != left or sym[j] != right:
                    continue  # a neighbour was merged meanwhile
                k = nxt[j]
                sym[i], sym[j], nxt[i], prv[k] = made, -2, k, i
                if follow and (r := follow.get(sym[k])) is not None:
                    if r in where:
                        where[r].append(i)
                    else:
                        where[r] = [i]
                        push(heap, r)
                if lead and (r := lead.get(sym[h := prv[i]])) is not None:
                    if r in where:
                        where[r].append(h)
                    else:
                        where[r] = [h]
                        push(heap, r)
        ids = np.array(sym)
        ids = ids[ids != -2]
        around = np.nonzero(ids == -1)[0].tolist()
        raw, text_of, known = ids.astype("<u4").tobytes(), self.text_of, self.known
        texts = [text_of.get(i) for i in ids.tolist()]
        for w, a, b in zip(words, around, around[1:]):
            known[w] = (raw[4 * a + 4 : 4 * b], " ".join(texts[a + 1 : b]))

    def encode_batch(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text, of each text."""
        split = [self.pieces(t) for t in texts]
        if len(self.known) >= CACHE:
            self.known, self.older = {}, self.known
        known, older, new = self.known, self.older, []
        for w in set().union(*split).difference(known):
            if w in older:
                known[w] = older[w]
            elif w[0] == " ":
                known[w] = (struct.pack("<I", self.added[w[1:]]), w[1:])
            else:
                new.append(w)
        if new:
            self.learn(new)
        out = []
        for ws in split:
            got = [known[w] for w in ws]
            out.append((b"".join([g[0] for g in got]), " ".join([g[1] for g in got])))
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.text_of[i] for i in ids if i in self.text_of)


_ENCODERS: dict[int, PairIndexBPE] = {}


def encoder(tokenizer_json: str) -> PairIndexBPE:
    """One encoder for each tokenizer in a Python process, so that its words outlive a task."""
    if (key := hash(tokenizer_json)) not in _ENCODERS:
        _ENCODERS[key] = PairIndexBPE(tokenizer_json)
    return _ENCODERS[key]


#: Texts encoded together; their unknown words form one layout.
GROUP = 256


def _coded(docs: DataFrame, tokenizer_json: str, schema: str, make_columns) -> DataFrame:
    def make():
        enc = encoder(tokenizer_json)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, texts = columns(batch, "doc_id", "text")
            rows = []
            for k in range(0, len(texts), GROUP):
                rows += [make_columns(*x) for x in enc.encode_batch(texts[k : k + GROUP])]
            cols = [pa.array(ids, pa.int64())]
            for name, kind in (f.split(" ") for f in schema.split(", ")[1:]):
                at = len(cols) - 1
                kinds = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
                cols.append(pa.array([r[at] for r in rows], kinds[kind]))
            return pa.RecordBatch.from_arrays(cols, names=[f.split(" ")[0] for f in schema.split(", ")])

        return step

    return map_batches(only(docs, "doc_id", "text"), schema, make)


def encode(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """doc_id, ids and the decoded text of every whole text."""
    schema = "doc_id bigint, n_tokens bigint, ids array<int>, decoded string"
    return _coded(docs, tokenizer_json, schema, lambda raw, text: (len(raw) // 4, np.frombuffer(raw, dtype="<i4"), text))


def digest(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of decoded text, without sending either out."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _coded(
        docs, tokenizer_json, schema, lambda raw, text: (len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    )
