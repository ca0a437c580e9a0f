"""Quality rules by distribution divergence, in DataFrame functions only.

Each text is compared with a reference of its language: the shares of character classes, and of
the language's most common words, over all documents of that language. The measure is the
Jensen-Shannon distance (square root of the divergence in bits, 0 to 1). Short texts have noisy
histograms, so each rule asks for a minimum length, and its limit is widened by a term that falls
with length. Base rules on word count and repeated three-word windows come first.

Null texts count as empty. A null language, and one with fewer than LEAST_REFERENCE words in all, is compared with
the reference of all rows. There may be any number of languages. Repeated rows give repeated rows; no row is ever
dropped by `measure`. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, cut

#: Common words kept for each language; words that a language must have for a reference of its own.
COMMON, LEAST_REFERENCE = 16, 2000
#: Rows of a table with a row for each language up to which it is broadcast; beyond, it is joined by a shuffle.
SMALL_TABLE = 100_000
#: Buckets for the first, coarse count of words.
BUCKETS = 4096
#: Least words for the word rule, least characters for the character rule.
LEAST_WORDS, LEAST_CHARS = 50, 200
#: Limits of the two distances for long texts, and how they widen: limit + SLACK / sqrt(length).
WORD_LIMIT, CHAR_LIMIT = 0.22, 0.21
WORD_SLACK, CHAR_SLACK = 1.2, 1.5
#: Few repeated windows are looked up one by one; more are found by sorting. Both ways are exact.
FEW = 64
ALL = "*"  # the reference of all rows; those of languages have "=" in front


def flat(text: Column) -> Column:
    """The text with every ASCII blank as a space."""
    text = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words_of(flat_text: Column) -> Column:
    return F.array_remove(F.split(flat_text, " "), "")


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)


def base_columns(docs: DataFrame) -> DataFrame:
    """docs with _words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("_flat", flat(F.col("text"))).withColumn("_words", words_of(F.col("_flat")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    d = d.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.char_length(F.replace("_flat", F.lit(" "), F.lit(""))).cast("bigint"),
            "n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("bigint"),
            "_lines": lines,
            # one hash for each three-word window
            "_h": F.when(
                F.size("_words") >= 3,
                F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))),
            ).otherwise(F.array().cast("array<bigint>")),
        }
    )
    d = d.withColumns(
        {"n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"), "_s": F.sort_array("_h"), "_n": F.size("_h")}
    )
    d = d.withColumn("_d", F.array_distinct(F.filter("_s", lambda x, i: x == F.get("_s", i - 1))))
    d = d.withColumn("_t", F.when(F.size("_d") > FEW, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    by_sort = F.sort_array(
        F.transform(
            F.filter("_t", lambda x, k: (x["h"] == F.get("_t", k - 1)["h"]) | F.coalesce(x["h"] == F.get("_t", k + 1)["h"], F.lit(False))),
            lambda x: x["i"],
        )
    )
    by_look = F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.array_contains("_d", F.get("_h", i)))
    none = F.array().cast("array<int>")
    d = d.withColumn("_p", F.when(F.size("_d") == 0, none).when(F.size("_d") <= FEW, by_look).otherwise(by_sort))
    reach = F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1), p + 3) - p).cast("bigint"))
    d = d.withColumn("n_repeat_words", _total(reach))
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return d.drop("_lines", "_h", "_s", "_n", "_d", "_t", "_p", "_flat")


def _small(df: DataFrame) -> DataFrame:
    """df for a join: broadcast if its size, which is looked at, allows."""
    return F.broadcast(df) if df.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE else df.hint("merge")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def common_words(docs: DataFrame) -> DataFrame:
    """ref, words, counts, total: the COMMON most frequent words of each language with a reference and of all rows, exactly.

    Words are first counted by hash bucket; only words of a language's fullest buckets are then counted one by
    one. A word outside cannot be more frequent than its bucket, so the outcome is checked and the choice widened
    until it is proven. total: all words. The table is stored.
    """
    texts = docs.select("lang", words_of(flat(F.col("text"))).alias("words"))
    coarse = texts.select("lang", F.explode("words").alias("word")).groupBy("lang", _bucket(F.col("word")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    coarse = cut(coarse, "quality-coarse")
    per = coarse.groupBy("lang").agg(F.sum("n").alias("total"))
    own = per.where((F.col("total") >= LEAST_REFERENCE) & F.col("lang").isNotNull()).select("lang", F.concat(F.lit("="), "lang").alias("ref"), "total")
    everything = per.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total")).select(F.lit(ALL).alias("ref"), "total")
    refs = cut(own.unionByName(everything, allowMissingColumns=True), "quality-refs")
    buckets = coarse.join(refs.where("lang IS NOT NULL").select("lang", "ref"), "lang").select("ref", "bucket", "n")
    buckets = buckets.unionByName(coarse.groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("ref", F.lit(ALL)))
    full = F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("n"), "bucket"))
    buckets = cut(buckets.withColumn("place", full), "quality-buckets")
    found, still_open, take = None, refs.select("ref"), 2 * COMMON
    while True:
        mine = buckets.join(still_open, "ref", "left_semi")
        chosen = mine.where(F.col("place") <= take).select("ref", "bucket")
        rest = mine.where(F.col("place") > take).groupBy("ref").agg(F.max("n").alias("rest"))
        of_all = [r["bucket"] for r in chosen.where(F.col("ref") == ALL).collect()]  # no more than BUCKETS
        own = chosen.where(F.col("ref") != ALL).select(F.substr("ref", F.lit(2)).alias("lang"), "bucket", F.lit(True).alias("mine"))
        words = texts.select("lang", F.explode("words").alias("word")).withColumn("bucket", _bucket(F.col("word")))
        few = words.join(_small(own), ["lang", "bucket"], "left").where(F.col("mine") | F.col("bucket").isin(of_all))
        few = cut(few.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "quality-words")
        by_ref = few.select(F.concat(F.lit("="), "lang").alias("ref"), "word", "n").union(few.groupBy("word").agg(F.sum("n")).select(F.lit(ALL), "word", "sum(n)"))
        by_ref = by_ref.withColumn("bucket", _bucket(F.col("word"))).join(chosen, ["ref", "bucket"], "left_semi")
        top = by_ref.withColumn("place", F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("n"), "word"))).where(F.col("place") <= COMMON)
        top = top.groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("place", "word", "n"))).alias("top"))
        out = refs.join(still_open, "ref", "left_semi").join(top, "ref", "left").join(rest, "ref", "left")
        out = out.withColumn("top", F.coalesce("top", F.array().cast("array<struct<place:int,word:string,n:bigint>>")))
        proven = F.col("rest").isNull() | ((F.size("top") == COMMON) & (F.element_at("top", -1)["n"] > F.col("rest")))
        if take < BUCKETS:
            proven = F.coalesce(proven, F.lit(False))
        out = cut(out.select("ref", F.transform("top", lambda x: x["word"]).alias("words"), F.transform("top", lambda x: x["n"]).alias("counts"), "total", proven.alias("proven")), "quality-common")
        good = out.where("proven").drop("proven")
        found = good if found is None else found.unionByName(good)
        still_open = out.where("NOT proven").select("ref")
        if not still_open.limit(1).count():
            return found
        take *= 4


def _shares(counts: Column) -> Column:
    whole = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.transform(counts, lambda x: F.when(whole > 0, x / whole).otherwise(F.lit(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two share arrays: sqrt of the divergence in bits."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    both = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / 2))


def histograms(docs: DataFrame, common: DataFrame) -> DataFrame:
    """docs with _ref (its reference), _chars and _common (counts as double arrays)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.char_length(text)
    without = lambda c: size - F.char_length(F.regexp_replace(text, c, ""))
    own = common.where(F.col("ref") != ALL).select(F.col("ref").alias("_own_ref"), F.col("words").alias("_own"))
    rest = common.where(F.col("ref") == ALL).select("words").first()["words"]
    d = docs.join(_small(own), F.concat(F.lit("="), docs["lang"]) == own["_own_ref"], "left")
    d = d.withColumns({"_ref": F.coalesce("_own_ref", F.lit(ALL)), "_list": F.coalesce("_own", F.array(*map(F.lit, rest)).cast("array<string>"))}).drop("_own_ref", "_own")
    d = d.withColumn("_at", F.filter(F.transform("_words", lambda w: F.array_position("_list", w)), lambda x: x > 0))
    hits = F.transform(F.sequence(F.lit(1).cast("bigint"), F.lit(COMMON).cast("bigint")), lambda k: F.size(F.filter("_at", lambda x: x == k)).cast("double"))
    d = d.withColumns(
        {
            "_lower": without(r"\p{Ll}+"),
            "_upper": without(r"\p{Lu}+"),
            "_digit": without(r"\p{Nd}+"),
            "_common": F.concat(hits, F.array((F.size("_words") - F.size("_at")).cast("double"))),
        }
    )
    blank = size - F.col("word_chars")
    other = F.col("word_chars") - F.col("_lower") - F.col("_upper") - F.col("_digit") - F.col("n_symbols")
    classes = ["_lower", "_upper", "_digit", "n_symbols"]
    d = d.withColumn("_chars", F.array(*[F.col(c).cast("double") for c in classes], blank.cast("double"), other.cast("double")))
    return d.drop("_list", "_at", "_lower", "_upper", "_digit")


def references(hist: DataFrame, common: DataFrame) -> DataFrame:
    """ref, ref_chars, ref_common: shares over all documents of a language ('*': over all rows)."""
    sums = [F.sum(F.get("_chars", F.lit(i))).alias(f"c{i}") for i in range(6)]
    per = hist.groupBy(F.col("_ref").alias("ref")).agg(*sums)
    whole = per.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(6)]).withColumn("ref", F.lit(ALL))
    chars = per.where(F.col("ref") != ALL).unionByName(whole).select("ref", _shares(F.array(*[F.coalesce(f"c{i}", F.lit(0.0)) for i in range(6)])).alias("ref_chars"))
    counts = F.transform("counts", lambda x: x.cast("double"))
    rest = F.col("total").cast("double") - F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    filled = F.concat(counts, F.array_repeat(F.lit(0.0), F.lit(COMMON) - F.size("counts")), F.array(rest))
    return chars.join(common.select("ref", _shares(filled).alias("ref_common")), "ref")


def verdicts(hist: DataFrame, refs: DataFrame) -> DataFrame:
    """hist with char_distance, word_distance and kept."""
    right = refs.select(F.col("ref").alias("_r"), "ref_chars", "ref_common")
    d = hist.join(_small(right), hist["_ref"] == right["_r"], "left").drop("_r")
    chars = F.aggregate("_chars", F.lit(0.0), lambda s, x: s + x)
    d = d.withColumns(
        {
            "char_distance": js_distance(_shares(F.col("_chars")), F.col("ref_chars")),
            "word_distance": js_distance(_shares(F.col("_common")), F.col("ref_common")),
            "_len": chars,
        }
    )
    n = F.col("n_words").cast("double")
    odd_words = (F.col("n_words") >= LEAST_WORDS) & (F.col("word_distance") > WORD_LIMIT + WORD_SLACK / F.sqrt(F.greatest(n, F.lit(1.0))))
    odd_chars = (F.col("_len") >= LEAST_CHARS) & (F.col("char_distance") > CHAR_LIMIT + CHAR_SLACK / F.sqrt(F.greatest(F.col("_len"), F.lit(1.0))))
    d = d.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd_words, F.lit(False)) & ~F.coalesce(odd_chars, F.lit(False)))
    return d.drop("ref_chars", "ref_common", "_len", "_chars", "_common", "_ref")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the five base counts, base_failed, both distances and kept, for every row."""
    docs = docs.select("doc_id", "text", "lang")
    common = common_words(docs)
    hist = histograms(base_columns(docs), common)
    hist = cut(hist.select("doc_id", *COUNTS, "base_failed", "_ref", "_chars", "_common"), "quality-histograms")
    refs = cut(references(hist, common), "quality-references")
    return verdicts(hist, refs).select("doc_id", *COUNTS, "base_failed", "char_distance", "word_distance", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with their columns unchanged.

    A verdict follows from text and language alone, so rejected rows are found by hashes of the text
    and the language, and only those are stored. They grow with docs, so the join shuffles at every size.
    """
    named = docs.select("text", "lang").withColumns({"_k1": F.xxhash64("text"), "_k2": F.hash("text")})
    common = common_words(docs)
    hist = histograms(base_columns(named), common)
    hist = cut(hist.select("_k1", "_k2", "lang", "n_words", "base_failed", "_ref", "_chars", "_common"), "quality-histograms")
    refs = cut(references(hist, common), "quality-references")
    gone = verdicts(hist, refs).where("NOT kept").select(F.col("_k1").alias("_g1"), F.col("_k2").alias("_g2"), F.col("lang").alias("_gl")).distinct()
    gone = cut(gone, "quality-rejected").hint("merge")
    same = (F.xxhash64(docs["text"]) == gone["_g1"]) & (F.hash(docs["text"]) == gone["_g2"]) & docs["lang"].eqNullSafe(gone["_gl"])
    return docs.join(gone, same, "left_anti")
