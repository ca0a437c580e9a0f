"""From documents to token ids: quality rules, near-dedup, surrogates, mixing, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() writes each stage's result to the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, mixing, pii, quality, simhash
from tidemark.llm.common import cut, table
from tidemark.llm.queries import MIX_SEED, PII_KEY, tokenizer_text


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules or the divergence from their language's reference reject go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal or near-equal texts stays."""
    return simhash.drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in text is replaced by surrogates; n_chars follows the new text."""
    out = pii.replace_entities(docs, PII_KEY)
    if "n_chars" in docs.columns:
        from pyspark.sql import functions as F

        out = out.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get equal target shares; a row stands as often as drawn, in global random order."""
    return mixing.mix(docs, seed=MIX_SEED, details=False)


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and the text that they decode to."""
    return bpe.encode(docs, tokenizer_text()).select("doc_id", "n_tokens", "ids", "decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("pii surrogates", personal_data),
    ("poisson mixing", mix_sources),
    ("bpe encoding", encode_ids),
]

#: SQL cannot express near-dedup over hashed features, keyed surrogates' collision rounds or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if (name, stage) != STAGES[-1]:
            docs = cut(docs, name.replace(" ", "-"))
    return docs
