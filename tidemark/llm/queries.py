"""The registered queries of the corpus operators, and their SQL where SQL can express them.

Each query applies its operator to the whole intended table. Paths of tokenizer files are
parameters; the files themselves are read on the driver, as executors may not have them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, mixing, pii, quality, secrets, simhash, sqltext, substring, tokencount, toxicity
from tidemark.llm.common import table

#: Production parameters. The key would come from a secret store; it is a parameter of the operator.
PII_KEY, MIX_SEED = "surrogate-key-1", "mix-1"


def _tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_text(path: str | None = None) -> str:
    with open(path or _tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=2)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(table(spark, sf_dir, "documents"), PII_KEY, count=True)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), seed=MIX_SEED)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op8_token_counts(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    with open(model_path or _tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), model, limit=4096)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(table(spark, sf_dir, "documents"), length=20)


def op10_bpe_codec(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), tokenizer_text(tokenizer_path))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_quality_rules,
        op3_toxicity,
        op4_pii_surrogates,
        op5_source_mixing,
        op6_secret_scan,
        op7_nearest_neighbours,
        op8_token_counts,
        op9_substring_dedup,
        op10_bpe_codec,
    )
}

#: What SQL cannot express is tested against brute force: hashes and model files (1, 4, 8, 10), a fitted
#: model (3), an approximate search (7), and the references of the quality rules (2), built in two steps.
SQL: dict[str, str] = {
    "op5_source_mixing": sqltext.mixing(MIX_SEED, mixing.DIGITS),
    "op6_secret_scan": sqltext.secrets(secrets.RULES),
    "op9_substring_dedup": sqltext.SUBSTRING,
}
