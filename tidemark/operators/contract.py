"""The raw export contract as tables of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import parse_period, parse_queries, parse_share
from tidemark.operators.series import month_continuity

NBSP = "\u00a0"


class ContractError(ValueError):
    """Raised by require(); carries the violations."""


def row_violations(rows: DataFrame) -> DataFrame:
    """source, check, raw: one row per breach of a raw row (source, raw_period, raw_queries, raw_share, raw_title).

    Checks: schema, period-format, thousands-separator, number-format, range, decimal-separator.
    """
    period, queries, share, title = (F.coalesce(F.col(c), F.lit("")) for c in ("raw_period", "raw_queries", "raw_share", "raw_title"))
    q, s = F.trim(queries), F.trim(share)
    nbsp = q.contains(NBSP)
    good_period = parse_period(period).isNotNull()
    grouped = q.rlike(r"^[0-9]{1,3}( [0-9]{3})*$")
    point = s.contains(".")
    share_ok = s.rlike(r"^[0-9]+(,[0-9]+)?$")
    found = [
        F.when(F.trim(title) != "", F.struct(F.lit("schema").alias("check"), title.alias("raw"))),
        F.when(~good_period, F.struct(F.lit("period-format").alias("check"), period.alias("raw"))),
        F.when(good_period & nbsp, F.struct(F.lit("thousands-separator").alias("check"), queries.alias("raw"))),
        F.when(good_period & ~nbsp & ~grouped, F.struct(F.lit("number-format").alias("check"), queries.alias("raw"))),
        F.when(good_period & ~nbsp & parse_queries(queries).isNull(), F.struct(F.lit("range").alias("check"), queries.alias("raw"))),
        F.when(good_period & point, F.struct(F.lit("decimal-separator").alias("check"), share.alias("raw"))),
        F.when(good_period & ~point & ~share_ok, F.struct(F.lit("number-format").alias("check"), share.alias("raw"))),
        F.when(good_period & share_ok & ~F.coalesce(parse_share(share).between(0, 100), F.lit(False)), F.struct(F.lit("range").alias("check"), share.alias("raw"))),
    ]
    return rows.select("source", F.explode(F.array_compact(F.array(*found))).alias("v")).select("source", "v.check", "v.raw")


def parsed(rows: DataFrame) -> DataFrame:
    """source, period, queries, share_pct of raw rows."""
    return rows.select("source", parse_period(F.col("raw_period")).alias("period"), parse_queries(F.col("raw_queries")).alias("queries"), parse_share(F.col("raw_share")).alias("share_pct"))


def continuity_violations(rows: DataFrame) -> DataFrame:
    """source, check 'continuity', raw: duplicated and missing months of raw rows."""
    m = parsed(rows).where("period IS NOT NULL").select(F.col("source").alias("phrase"), "period", F.lit(0).alias("queries"))
    return month_continuity(m).select(F.col("phrase").alias("source"), F.lit("continuity").alias("check"), F.col("period").cast("string").alias("raw"))


def contract_violations(rows: DataFrame) -> DataFrame:
    return row_violations(rows).unionByName(continuity_violations(rows))


def file_violations(files: DataFrame) -> DataFrame:
    """source, check of files read as binaryFile (path, content): 'bom' and 'line-endings'."""
    bom = F.when(~F.hex("content").startswith("EFBBBF"), F.lit("bom"))
    ends = F.when(F.instr(F.decode("content", "ISO-8859-1"), "\n") > 0, F.lit("line-endings"))
    return files.select(F.col("path").alias("source"), F.explode(F.array_compact(F.array(bom, ends))).alias("check"))


def require(violations: DataFrame) -> None:
    """Raise ContractError if there is a violation."""
    some = violations.limit(5).collect()
    if some:
        raise ContractError("; ".join(str(r.asDict()) for r in some))
