"""Secret scans through a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query of trigrams that any match must contain is
derived. One pass over the texts writes the postings of just those trigrams; intersecting and
uniting postings by document gives each rule's candidates, and only candidates are verified with the
expression. A rule without mandatory trigrams (a run of hex digits) scans every text.

Postings carry doc_id and two hashes of the text, so repeated rows share theirs. Null texts are
empty and have no spans; a null doc_id is kept. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the least length of the match or of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The three base rules, in the order in which ties are listed.
BASE_RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
)
#: Rules of this operator's own for well-known public key formats.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


# Trigram queries: None (no condition), or ("and" | "or", parts) over trigrams.
def _all(parts: list) -> object:
    parts = [p for p in parts if p is not None]
    flat = sorted({q for p in parts for q in (p[1] if isinstance(p, tuple) and p[0] == "and" else [p])}, key=repr)
    return None if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _any(parts: list) -> object:
    if any(p is None for p in parts):
        return None
    # a part that asks for more than another one adds nothing
    asks = {p: frozenset(p[1] if isinstance(p, tuple) and p[0] == "and" else [p]) for p in set(parts)}
    unique = sorted((p for p, a in asks.items() if not any(b < a for b in asks.values())), key=repr)
    return unique[0] if len(unique) == 1 else ("or", tuple(unique))


def _of_strings(strings: set[str]) -> object:
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in strings]) if strings else None


#: Most strings that a part of an expression is spelt out as, and most letters that a class is.
SPELT, LETTERS = 64, 8


def _spell(tokens) -> tuple[set[str] | None, object]:
    """All strings that the tokens can match, lower-cased, if they are few, else None; and their query."""
    whole, runs, open_run = {""}, [], {""}
    for op, arg in tokens:
        part, query = _one(op, arg)
        runs.append(query)
        if part is not None and len(open_run) * len(part) <= SPELT:
            open_run = {a + b for a, b in product(open_run, part)}
            whole = {a + b for a, b in product(whole, part)} if whole is not None and len(whole) * len(part) <= SPELT else None
        else:
            runs.append(_of_strings(open_run))
            open_run, whole = part if part is not None else {""}, None
    runs.append(_of_strings(open_run))
    return whole, _all(runs)


def _one(op, arg) -> tuple[set[str] | None, object]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, None
    if op is sre.IN:
        letters: set[str] = set()
        for o, a in arg:
            if o is sre.LITERAL:
                letters.add(chr(a).lower())
            elif o is sre.RANGE and a[1] - a[0] < LETTERS:
                letters |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None, None
        return (letters, None) if len(letters) <= LETTERS else (None, None)
    if op is sre.SUBPATTERN:
        return _spell(arg[3])
    if op is sre.BRANCH:
        parts = [_spell(b) for b in arg[1]]
        whole = set().union(*[p for p, _ in parts]) if all(p is not None for p, _ in parts) else None
        return (whole, None) if whole is not None and len(whole) <= SPELT else (None, _any([q for _, q in parts]))
    if op is sre.MAX_REPEAT:
        low, high, inner = arg
        part, query = _spell(inner)
        if part is not None and high <= 4 and len(part) ** int(high) <= SPELT:
            return {"".join(x) for n in range(low, int(high) + 1) for x in product(part, repeat=n)}, None
        return None, _all([query, _of_strings(part) if part is not None else None]) if low else None
    return None, None


def trigram_query(pattern: str) -> object:
    """The trigrams (of the lower-cased text) that a match of pattern cannot do without."""
    return _spell(list(sre_parser.parse(pattern)))[1]


def trigrams(query: object) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of a rule's matches, leftmost and not overlapping, by adding up the pieces between them."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.transform(F.split(text, rule.pattern, -1), lambda p: F.char_length(p))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,ok:boolean>>").alias("out"))
    steps = F.zip_with(between, found, lambda g, m: F.struct(g.alias("gap"), m.alias("found")))
    steps = F.zip_with(steps, group, lambda x, g: F.struct(x["gap"].alias("gap"), x["found"].alias("found"), g.alias("group")))

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + x["gap"]
        b = a + F.char_length(x["found"])
        one = F.struct(a.alias("start"), b.alias("end"), (F.char_length(x["group"]) >= rule.least).alias("ok"))
        return F.when(x["found"].isNull(), s).otherwise(F.struct(b.alias("at"), F.concat(s["out"], F.array(one)).alias("out")))

    every = F.aggregate(steps, start, step, lambda s: s["out"])
    return F.filter(every, lambda x: x["ok"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (kind, start, end; by start, then rule order) of every row of docs."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    grams = sorted(set().union(*map(trigrams, queries.values())))
    place = {g: i for i, g in enumerate(grams)}
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.hash("text")})
    low = keyed.select("doc_id", "k1", "k2", F.lower("text").alias("low"))
    held = F.filter(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for g, i in place.items()]), lambda x: x.isNotNull())
    postings = low.select(F.explode(held).alias("gram"), "doc_id", "k1", "k2")

    words = range((len(grams) + 61) // 62)
    bit = lambda w: F.bit_or(F.when(F.floor(F.col("gram") / 62) == w, F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("gram") % 62).cast("int"))).otherwise(F.lit(0).cast("bigint")))
    found = postings.groupBy("doc_id", "k1", "k2").agg(*[bit(w).alias(f"m{w}") for w in words])

    def holds(query) -> Column:
        if isinstance(query, str):
            i = place[query]
            return F.col(f"m{i // 62}").bitwiseAND(F.lit(1 << (i % 62)).cast("bigint")) != 0
        return reduce(lambda a, b: a & b if query[0] == "and" else a | b, map(holds, query[1]))

    asked = [r for r in rules if queries[r.kind] is not None]
    kinds = F.filter(F.array(*[F.when(holds(queries[r.kind]), F.lit(r.kind)) for r in asked]), lambda x: x.isNotNull())
    candidates = found.select(F.col("doc_id").alias("c_id"), F.col("k1").alias("c1"), F.col("k2").alias("c2"), kinds.alias("kinds")).where(F.size("kinds") > 0)
    candidates = cut(candidates, "secret-candidates")

    d = keyed.join(candidates, keyed.doc_id.eqNullSafe(candidates.c_id) & (keyed.k1 == candidates.c1) & (keyed.k2 == candidates.c2), "left")
    none = F.array().cast("array<struct<start:int,end:int,ok:boolean>>")
    for r in rules:
        spans = spans_of(F.col("text"), r)
        d = d.withColumn(f"s_{r.kind}", F.when(F.array_contains("kinds", r.kind), spans).otherwise(none) if queries[r.kind] is not None else spans)
    one = lambda i, r: F.transform(f"s_{r.kind}", lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("order"), x["end"].alias("end"), F.lit(r.kind).alias("kind")))
    return d.select("doc_id", F.array_sort(F.concat(*[one(i, r) for i, r in enumerate(rules)])).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the SHA-256 of the base spans, and all spans as text."""
    d = scan(docs)
    line = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin([r.kind for r in BASE_RULES]))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return d.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
