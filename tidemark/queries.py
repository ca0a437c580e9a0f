"""The registered queries of the time-series operators, over the driver's tables, each with its SQL.

Keys of `orders` stand in for search phrases (79 full months), event types for daily series, documents
and parts for short texts, labelled embeddings for clusters, parts bought together for the phrase graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import calendar, display, scores
from tidemark.operators import breaks, contract, forecast, graph, ranking, series, short_term, stitch, text, vectors
from tidemark.plans import showcase
from tidemark.sources import runs
from tidemark.sources.artifact import translate
from tidemark.streaming import signals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The partial last month of orders is cut off.
BEFORE = "2001-08-01"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.monthly_counts(_table(spark, sf_dir, "orders"), F.col("o_orderpriority"), F.col("o_orderdate"), BEFORE)


def phrases_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen phrases (priority/status), months without orders filled with 0."""
    key = F.concat_ws("/", "o_orderpriority", "o_orderstatus")
    return series.fill_months(series.monthly_counts(_table(spark, sf_dir, "orders"), key, F.col("o_orderdate"), BEFORE))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderstatus").alias("topic"), F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("phrase")).distinct()


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark, sf_dir).where(F.col("phrase").startswith("5")).select("phrase")


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.daily_counts(_table(spark, sf_dir, "events"), F.col("event_type"), F.col("ts"))


M = f"""m AS (SELECT o_orderpriority AS phrase, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, count(*) AS queries
  FROM orders WHERE o_orderdate < DATE '{BEFORE}' GROUP BY 1, 2)"""
M15 = f"""r0 AS (SELECT o_orderpriority || '/' || o_orderstatus AS phrase, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, count(*) AS c
  FROM orders WHERE o_orderdate < DATE '{BEFORE}' GROUP BY 1, 2),
g0 AS (SELECT phrase, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS period FROM (SELECT phrase, min(period) AS a, max(period) AS b FROM r0 GROUP BY 1)),
m AS (SELECT g0.phrase, g0.period, CAST(coalesce(c, 0) AS BIGINT) AS queries FROM g0 LEFT JOIN r0 USING (phrase, period))"""
M5 = M15.replace("o_orderpriority || '/' || o_orderstatus AS phrase", "o_orderpriority AS phrase")
C15 = "cl AS (SELECT DISTINCT o_orderstatus AS topic, o_orderpriority || '/' || o_orderstatus AS phrase FROM orders)"
D = "d AS (SELECT event_type AS phrase, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS count FROM events GROUP BY 1, 2)"
PROFILE = "prof AS (SELECT phrase, CAST(month(period) AS INT) AS month, avg(CAST(queries AS DOUBLE)) AS mean FROM m GROUP BY 1, 2)"
AMP = "amp AS (SELECT phrase, CASE WHEN min(mean) <= 0 THEN CAST(0 AS DOUBLE) ELSE max(mean) / min(mean) END AS amplitude FROM prof GROUP BY 1)"
PEAK = """peak AS (SELECT p.phrase, CASE WHEN n >= 24 AND amplitude >= 2 THEN top END AS peak, last
  FROM (SELECT phrase, arg_max(month, (mean, -month)) AS top FROM prof GROUP BY 1) p
  JOIN (SELECT phrase, count(*) AS n, max(period) AS last FROM m GROUP BY 1) USING (phrase) JOIN amp USING (phrase))"""
GROWTH = """rn AS (SELECT phrase, CAST(queries AS DOUBLE) AS q, row_number() OVER (PARTITION BY phrase ORDER BY period DESC) AS rn FROM m),
gr0 AS (SELECT phrase, sum(q) FILTER (WHERE rn <= 3) / 3 AS actual, sum(q) FILTER (WHERE rn BETWEEN 13 AND 15) / 3 AS forecast,
  avg(q) FILTER (WHERE rn > 3) AS base, count(*) AS n FROM rn GROUP BY 1),
gr AS (SELECT phrase, actual / forecast AS score, actual / forecast >= 1.5 AS is_growth, forecast, actual, base FROM gr0 WHERE n >= 24 AND forecast > 0)"""
AGE = """l12 AS (SELECT phrase, period, CAST(queries AS DOUBLE) AS q, lag(CAST(queries AS DOUBLE), 12) OVER (PARTITION BY phrase ORDER BY period) AS ago FROM m),
l12r AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY period DESC) AS rn, coalesce(ago > 0 AND q >= 1.5 * ago, false) AS ok FROM l12),
age AS (SELECT phrase, CAST(nullif(coalesce(min(rn) FILTER (WHERE NOT ok) - 1, count(*)), 0) AS INT) AS age FROM l12r GROUP BY 1)"""
CLASS = "CASE WHEN score >= 1.5 THEN 'GROWING' WHEN score <= CAST(1 AS DOUBLE) / 1.5 THEN 'FALLING' WHEN amplitude >= 2 THEN 'SEASONAL' ELSE 'STABLE' END"
ORDER = "CASE klass WHEN 'GROWING' THEN 0 WHEN 'SEASONAL' THEN 1 WHEN 'FALLING' THEN 2 ELSE 3 END"
RECORDS = f"rec AS (SELECT phrase, score, base, amplitude, age, {CLASS} AS klass FROM gr JOIN amp USING (phrase) JOIN age USING (phrase))"
RSCORE = """CASE WHEN klass = 'GROWING' THEN CAST(0.5 AS DOUBLE) * (1 - 1 / score) + CAST(0.3 AS DOUBLE) * least(log10(1 + base) / log10(CAST(1000001 AS DOUBLE)), 1)
  + CAST(0.2 AS DOUBLE) / coalesce(age, 1) ELSE CAST(0 AS DOUBLE) END"""
RANKED = f"""rk AS (SELECT *, row_number() OVER (ORDER BY {ORDER}, rscore DESC, phrase) AS rank FROM (SELECT *, {RSCORE} AS rscore FROM rec))"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


# Series


@query(_with(M) + "SELECT * FROM m")
def monthly_series(spark, sf):
    return orders_monthly(spark, sf)


@query(_with(M15) + "SELECT * FROM m")
def monthly_series_filled(spark, sf):
    return phrases_monthly(spark, sf)


@query(
    f"""WITH r AS (SELECT DISTINCT o_orderpriority || '/' || o_orderstatus AS phrase, CAST(date_trunc('month', o_orderdate) AS DATE) AS period FROM orders WHERE o_orderdate < DATE '{BEFORE}' AND o_orderdate NOT BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-04-30 23:59:59'),
k AS (SELECT *, year(period) * 12 + month(period) - lag(year(period) * 12 + month(period)) OVER (PARTITION BY phrase ORDER BY period) AS step FROM r)
SELECT phrase, period, CASE WHEN step = 0 THEN 'duplicate' ELSE 'gap' END AS "check", CAST(greatest(step - 1, 0) AS BIGINT) AS missing FROM k WHERE step <> 1"""
)
def month_continuity(spark, sf):
    o = _table(spark, sf, "orders").where("o_orderdate NOT BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-04-30 23:59:59'")
    return series.month_continuity(series.monthly_counts(o, F.concat_ws("/", "o_orderpriority", "o_orderstatus"), F.col("o_orderdate"), BEFORE))


@query(_with(M, PROFILE) + "SELECT phrase, month, round(mean, 6) AS mean FROM prof")
def monthly_profile(spark, sf):
    return series.monthly_profile(orders_monthly(spark, sf)).select("phrase", "month", r6("mean"))


@query(_with(M, PROFILE, AMP) + "SELECT phrase, round(amplitude, 6) AS amplitude FROM amp")
def seasonal_amplitude(spark, sf):
    return series.seasonal_amplitude(orders_monthly(spark, sf)).select("phrase", r6("amplitude"))


@query(_with(M15, PROFILE, AMP, PEAK) + "SELECT phrase, peak FROM peak")
def peak_month(spark, sf):
    return series.peak_month(phrases_monthly(spark, sf))


@query(_with(M15, GROWTH) + "SELECT phrase, round(score, 6) AS score, is_growth, round(forecast, 6) AS forecast, round(actual, 6) AS actual, round(base, 6) AS base FROM gr")
def growth_score(spark, sf):
    return series.growth_score(phrases_monthly(spark, sf)).select("phrase", r6("score"), "is_growth", r6("forecast"), r6("actual"), r6("base"))


@query(
    f"""WITH r AS (SELECT o_orderpriority AS phrase, CAST(date_trunc('month', o_orderdate) AS DATE) AS period FROM orders WHERE o_orderdate < DATE '{BEFORE}'),
n AS (SELECT phrase, count(DISTINCT period) AS n FROM r WHERE period >= CASE left(phrase, 1) WHEN '1' THEN DATE '2000-08-01' WHEN '2' THEN DATE '2000-01-01' ELSE DATE '1995-01-01' END GROUP BY 1)
SELECT phrase, CASE WHEN n - 12 < 3 THEN 'window' ELSE 'history' END AS "check" FROM n WHERE n < 24"""
)
def growth_violations(spark, sf):
    start = F.when(F.left("phrase", F.lit(1)) == "1", F.lit("2000-08-01")).when(F.left("phrase", F.lit(1)) == "2", F.lit("2000-01-01")).otherwise(F.lit("1995-01-01")).cast("date")
    return series.growth_violations(orders_monthly(spark, sf).where(F.col("period") >= start))


@query(_with(M15, AGE) + "SELECT phrase, age FROM age")
def growth_age(spark, sf):
    return series.growth_age(phrases_monthly(spark, sf))


@query(
    _with(M15, PROFILE, AMP, GROWTH, AGE, RECORDS)
    + """SELECT phrase, klass, CASE WHEN klass = 'GROWING' THEN round(1 - 1 / score, 6) END AS anomaly,
CASE WHEN klass = 'GROWING' THEN round(least(log10(1 + base) / log10(CAST(1000001 AS DOUBLE)), 1), 6) END AS volume,
CASE WHEN klass = 'GROWING' THEN round(CAST(1 AS DOUBLE) / coalesce(age, 1), 6) END AS freshness FROM rec"""
)
def score_components(spark, sf):
    return ranking.score_components(ranking.phrase_records(phrases_monthly(spark, sf))).select("phrase", "klass", r6("anomaly"), r6("volume"), r6("freshness"))


@query(_with(M, PROFILE, AMP, GROWTH, AGE, RECORDS) + "SELECT phrase, klass, round(score, 6) AS score, round(amplitude, 6) AS amplitude FROM rec")
def classify(spark, sf):
    r = ranking.phrase_records(orders_monthly(spark, sf))
    return r.select("phrase", scores.classify(F.col("score"), F.col("amplitude")).alias("klass"), r6("score"), r6("amplitude"))


_SHOW = "SELECT rank, phrase, klass, round(rscore, 6) AS rank_score, round(score, 6) AS score, round(amplitude, 6) AS amplitude, age FROM rk"


@query(_with(M15, PROFILE, AMP, GROWTH, AGE, RECORDS, RANKED) + _SHOW)
def rank_showcase(spark, sf):
    return showcase.ranked(phrases_monthly(spark, sf)).select("rank", "phrase", "klass", r6("rank_score"), r6("score"), r6("amplitude"), "age")


@query(
    _with(M15, PROFILE, AMP, GROWTH, AGE, RECORDS, RANKED)
    + "SELECT rank, phrase, klass FROM (SELECT *, row_number() OVER (PARTITION BY klass ORDER BY rank) AS n FROM rk) WHERE n <= 5"
)
def top_per_class(spark, sf):
    return ranking.top_per_class(showcase.ranked(phrases_monthly(spark, sf))).select("rank", "phrase", "klass")


WINDOW = """pw AS (SELECT phrase, peak, CAST((peak - 2 - 1 + 12) % 12 + 1 AS INT) AS order_month, last, CAST((peak - month(last) + 12) % 12 AS INT) AS months_to_peak, 2 AS lead FROM peak),
pw2 AS (SELECT *, CAST((order_month - month(last) + 12) % 12 AS INT) AS months_to_order FROM pw),
pw3 AS (SELECT phrase, peak, order_month, months_to_order, months_to_peak, CAST(last + to_months(months_to_order) AS DATE) AS order_period, CAST(last + to_months(months_to_peak) AS DATE) AS peak_period, CAST(lead AS INT) AS lead, months_to_peak >= lead AS on_time FROM pw2)"""


@query(_with(M15, PROFILE, AMP, PEAK, WINDOW) + "SELECT * FROM pw3")
def purchase_window(spark, sf):
    return ranking.purchase_window(phrases_monthly(spark, sf))


# Niches

FLAGS = "rec15 AS (SELECT *, phrase LIKE '5%' AS filtered_out FROM rec)"
RANKED_F = RANKED.replace("FROM rec)", "FROM rec15 WHERE NOT filtered_out)")
NICHE = f"""mem AS (SELECT cl.topic, rk.* FROM cl JOIN rk USING (phrase)),
dom AS (SELECT topic, arg_max(klass, (n, -({ORDER}))) AS dk FROM (SELECT topic, klass, count(*) AS n FROM mem GROUP BY 1, 2) GROUP BY 1),
shr AS (SELECT topic, avg(CAST(filtered_out AS DOUBLE)) AS filtered_share FROM cl JOIN rec15 USING (phrase) GROUP BY 1),
ni AS (SELECT topic, min(dk) AS klass, median(rscore) FILTER (WHERE klass = dk) AS score, count(*) AS n_phrases,
  CAST(floor(median(coalesce(age, 1)) FILTER (WHERE klass = 'GROWING')) AS INT) AS age, list(phrase ORDER BY rank)[1:5] AS phrases FROM mem JOIN dom USING (topic) GROUP BY 1),
nic AS (SELECT ni.*, coalesce(filtered_share, 0) AS filtered_share FROM ni LEFT JOIN shr USING (topic))"""
_NICHE = _with(M15, C15, PROFILE, AMP, GROWTH, AGE, RECORDS, FLAGS, RANKED_F, NICHE)


@query(_with(M15, C15, PROFILE, AMP, GROWTH, AGE, RECORDS, FLAGS, RANKED_F, NICHE) + "SELECT topic, dk AS klass FROM dom")
def niche_dominant_class(spark, sf):
    r = showcase.with_filter(phrases_monthly(spark, sf), filtered(spark, sf))
    return ranking.dominant_class(clusters(spark, sf).join(ranking.rank_showcase(r), "phrase"))


@query(_NICHE + "SELECT topic, klass, round(score, 6) AS score, n_phrases, age, array_to_string(phrases, ',') AS phrases, round(filtered_share, 6) AS filtered_share FROM nic")
def niche_build(spark, sf):
    n = showcase.niches(phrases_monthly(spark, sf), clusters(spark, sf), filtered(spark, sf))
    return n.select("topic", "klass", r6("score"), "n_phrases", "age", F.array_join("phrases", ",").alias("phrases"), r6("filtered_share"))


@query(_NICHE + f"SELECT topic, klass, row_number() OVER (ORDER BY {ORDER}, score DESC, topic) AS place FROM nic")
def niche_order(spark, sf):
    return ranking.niche_order(showcase.niches(phrases_monthly(spark, sf), clusters(spark, sf), filtered(spark, sf))).select("topic", "klass", "place")


NSERIES = "m2 AS (SELECT topic AS phrase, period, avg(CAST(queries AS DOUBLE)) AS queries FROM cl JOIN m USING (phrase) GROUP BY 1, 2)"


@query(_with(M15, C15, NSERIES) + "SELECT phrase, period, round(queries, 6) AS queries FROM m2")
def niche_series(spark, sf):
    return ranking.niche_series(clusters(spark, sf), phrases_monthly(spark, sf)).select("phrase", "period", r6("queries"))


SOURCING = """np AS (SELECT phrase, CAST(month(period) AS INT) AS month, avg(queries) AS mean FROM m2 GROUP BY 1, 2),
na AS (SELECT phrase, CASE WHEN min(mean) <= 0 THEN CAST(0 AS DOUBLE) ELSE max(mean) / min(mean) END AS amplitude, arg_max(month, (mean, -month)) AS top FROM np GROUP BY 1),
nl AS (SELECT phrase AS topic, amplitude, CASE WHEN amplitude >= 2 THEN (top - month(last) + 12) % 12 >= 2 END AS on_time FROM na JOIN (SELECT phrase, max(period) AS last FROM m2 GROUP BY 1) USING (phrase)),
so AS (SELECT topic, klass, score AS trend, CASE WHEN amplitude < 2 THEN CAST(0 AS DOUBLE) ELSE least(log10(amplitude) / 2, 1) END AS seasonal,
  coalesce(CAST(on_time AS DOUBLE), 0) AS "window", CASE WHEN klass = 'GROWING' AND age IS NOT NULL THEN (1 - filtered_share) / age ELSE 1 - filtered_share END AS stability FROM nic JOIN nl USING (topic)),
so2 AS (SELECT *, CAST(0.4 AS DOUBLE) * trend + CAST(0.2 AS DOUBLE) * seasonal + CAST(0.2 AS DOUBLE) * "window" + CAST(0.2 AS DOUBLE) * stability AS score FROM so)"""


@query(
    _NICHE
    + ", "
    + NSERIES
    + ", "
    + SOURCING
    + f""" SELECT topic, klass, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round("window", 6) AS "window", round(stability, 6) AS stability, round(score, 6) AS score,
row_number() OVER (ORDER BY score DESC, {ORDER}, topic) AS place FROM so2"""
)
def sourcing_score(spark, sf):
    s = showcase.sourcing(phrases_monthly(spark, sf), clusters(spark, sf), filtered(spark, sf))
    return s.select("topic", "klass", r6("trend"), r6("seasonal"), r6("window"), r6("stability"), r6("score"), "place")


@query("SELECT s_nationkey AS topic, round(avg(CASE WHEN len(list_intersect(string_split(lower(p_name), ' '), ['red', 'blue'])) > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS intent_share FROM (SELECT p_partkey % 25 AS s_nationkey, p_name FROM part) GROUP BY 1")
def intent_share(spark, sf):
    p = _table(spark, sf, "part").select((F.col("p_partkey") % 25).alias("topic"), F.split(F.lower("p_name"), " ").alias("lemmas"))
    return ranking.intent_share(p, ("red", "blue")).select("topic", r6("intent_share"))


# Stitching and contract

W = """w AS (SELECT phrase, 0 AS window_id, period, queries FROM m WHERE period < DATE '1998-06-01'
UNION ALL SELECT phrase, 1, period, queries + CASE WHEN left(phrase, 1) = '3' AND period = DATE '1998-04-01' THEN 1 ELSE 0 END FROM m WHERE period >= DATE '1998-03-01')"""


def windows(spark, sf) -> DataFrame:
    m = series.fill_months(orders_monthly(spark, sf))
    a = m.where("period < DATE '1998-06-01'").select("phrase", F.lit(0).alias("window_id"), "period", "queries")
    odd = F.when(F.col("phrase").startswith("3") & (F.col("period") == F.lit("1998-04-01").cast("date")), 1).otherwise(0)
    return a.union(m.where("period >= DATE '1998-03-01'").select("phrase", F.lit(1), "period", F.col("queries") + odd))


@query(_with(M5, W) + "SELECT phrase, period, min(queries) AS lo, max(queries) AS hi FROM w GROUP BY 1, 2 HAVING min(queries) <> max(queries)")
def overlap_mismatch(spark, sf):
    return stitch.overlap_mismatch(windows(spark, sf))


@query(
    _with(M5, W)
    + """SELECT phrase, period, min(queries) AS queries, CAST(NULL AS VARCHAR) AS error FROM w WHERE left(phrase, 1) <> '3' GROUP BY 1, 2
UNION ALL SELECT DISTINCT phrase, CAST(NULL AS DATE), CAST(NULL AS BIGINT), 'mismatch' FROM w WHERE left(phrase, 1) = '3'"""
)
def window_stitch(spark, sf):
    return stitch.stitch(windows(spark, sf))


RU = "['" + "', '".join(calendar.MONTHS) + "']"


def raw_rows(spark, sf) -> DataFrame:
    """Raw export rows written out from the monthly series, some of them broken."""
    m = orders_monthly(spark, sf)
    k = calendar.month_key(F.col("period"))
    name = F.element_at(F.array(*map(F.lit, calendar.MONTHS)), F.month("period"))
    q = F.replace(F.format_number((F.col("queries") * 1000).cast("double"), 0), F.lit(","), F.lit(" "))
    return m.where(k % 17 != 0).select(
        F.col("phrase").alias("source"),
        F.when(k % 13 == 0, F.lit("нет")).otherwise(F.concat(name, F.lit(" "), F.year("period").cast("string"))).alias("raw_period"),
        F.when(k % 11 == 0, F.replace(q, F.lit(" "), F.lit(contract.NBSP))).when(k % 7 == 0, F.concat(q, F.lit("x"))).otherwise(q).alias("raw_queries"),
        F.when(k % 5 == 0, F.lit("0.5")).when(k % 19 == 0, F.lit("101,5")).otherwise(F.lit("0,0115")).alias("raw_share"),
        F.when(k % 23 == 0, F.lit("title")).otherwise(F.lit("")).alias("raw_title"),
    )


RAW = f"""raw AS (SELECT phrase AS source, k, CASE WHEN k % 13 = 0 THEN 'нет' ELSE {RU}[month(period)] || ' ' || CAST(year(period) AS VARCHAR) END AS p,
CASE WHEN k % 11 = 0 THEN replace(q, ' ', chr(160)) WHEN k % 7 = 0 THEN q || 'x' ELSE q END AS q, CASE WHEN k % 5 = 0 THEN '0.5' WHEN k % 19 = 0 THEN '101,5' ELSE '0,0115' END AS s,
CASE WHEN k % 23 = 0 THEN 'title' ELSE '' END AS t, period FROM (SELECT phrase, period, year(period) * 12 + month(period) - 1 AS k, replace(format('{{:,}}', queries * 1000), ',', ' ') AS q FROM m) WHERE k % 17 <> 0)"""


@query(
    _with(M, RAW)
    + """SELECT source, 'schema' AS "check", t AS raw FROM raw WHERE t <> '' UNION ALL
SELECT source, 'period-format', p FROM raw WHERE k % 13 = 0 UNION ALL
SELECT source, 'thousands-separator', q FROM raw WHERE k % 13 <> 0 AND contains(q, chr(160)) UNION ALL
SELECT source, 'number-format', q FROM raw WHERE k % 13 <> 0 AND NOT contains(q, chr(160)) AND NOT regexp_matches(q, '^[0-9]{1,3}( [0-9]{3})*$') UNION ALL
SELECT source, 'range', q FROM raw WHERE k % 13 <> 0 AND NOT contains(q, chr(160)) AND NOT regexp_matches(replace(q, ' ', ''), '^[0-9]+$') UNION ALL
SELECT source, 'decimal-separator', s FROM raw WHERE k % 13 <> 0 AND contains(s, '.') UNION ALL
SELECT source, 'range', s FROM raw WHERE k % 13 <> 0 AND s = '101,5' UNION ALL
SELECT source, 'continuity', CAST(period AS VARCHAR) FROM (SELECT source, period, k - lag(k) OVER (PARTITION BY source ORDER BY k) AS step FROM raw WHERE k % 13 <> 0) WHERE step <> 1"""
)
def contract_violations(spark, sf):
    return contract.contract_violations(raw_rows(spark, sf))


@query(_with(M, RAW) + "SELECT source, p AS raw_period, CASE WHEN k % 13 <> 0 THEN period END AS period FROM raw")
def parse_period(spark, sf):
    return raw_rows(spark, sf).select("source", "raw_period", calendar.parse_period(F.col("raw_period")).alias("period"))


@query(_with(M, RAW) + "SELECT source, p AS raw_period, q AS raw_queries, CASE WHEN regexp_matches(replace(q, ' ', ''), '^[0-9]+$') THEN CAST(replace(q, ' ', '') AS BIGINT) END AS queries, CASE WHEN s = '0.5' THEN NULL ELSE CAST(replace(s, ',', '.') AS DOUBLE) END AS share FROM raw")
def parse_queries(spark, sf):
    return raw_rows(spark, sf).select("source", "raw_period", "raw_queries", calendar.parse_queries(F.col("raw_queries")).alias("queries"), calendar.parse_share(F.col("raw_share")).alias("share"))


@query(
    _with(M)
    + """SELECT phrase, period, period >= DATE '1998-01-01' AND period <= DATE '2000-12-01' AND false AS valid, CAST(date_trunc('month', period) - INTERVAL 60 MONTH AS DATE) AS first_day, CAST(date_trunc('month', period) - INTERVAL 1 DAY AS DATE) AS last_day FROM m"""
)
def request_window(spark, sf):
    m = orders_monthly(spark, sf)
    a, b = calendar.default_window(F.col("period"))
    return m.select("phrase", "period", calendar.window_is_valid(a, b, F.col("period")).alias("valid"), a.alias("first_day"), b.alias("last_day"))


# Daily

WEEKS = """wk0 AS (SELECT *, CAST(date_trunc('week', day) AS DATE) AS week, CAST(isodow(day) - 1 AS INT) AS weekday FROM d),
wk1 AS (SELECT *, count(*) OVER (PARTITION BY phrase, week) AS n7, sum(count) OVER (PARTITION BY phrase, week) AS week_sum FROM wk0),
wk AS (SELECT *, count * 7 / week_sum AS share FROM wk1 WHERE n7 = 7 AND week_sum <> 0)"""
SPIKES = """sp0 AS (SELECT *, count(*) OVER (PARTITION BY phrase, weekday) AS nw, sum(share) OVER (PARTITION BY phrase, weekday) AS sw FROM wk),
sp1 AS (SELECT *, (week_sum - count) / 6 * CASE WHEN nw > 1 THEN (sw - share) / (nw - 1) END AS expected FROM sp0),
sp AS (SELECT phrase, day, count, expected, count / expected AS ratio FROM sp1 WHERE expected > 0)"""


@query(_with(D) + "SELECT * FROM d")
def daily_series(spark, sf):
    return events_daily(spark, sf)


@query(_with(D, WEEKS) + "SELECT phrase, weekday, round(p / avg(p) OVER (PARTITION BY phrase), 6) AS profile FROM (SELECT phrase, weekday, avg(share) AS p FROM wk GROUP BY 1, 2)")
def weekday_profile(spark, sf):
    return short_term.weekday_profile(events_daily(spark, sf)).select("phrase", "weekday", r6("profile"))


@query(_with(D) + "SELECT phrase, weekday, round(p / avg(p) OVER (PARTITION BY phrase), 6) AS profile FROM (SELECT phrase, CAST(isodow(day) - 1 AS INT) AS weekday, avg(count) AS p FROM d GROUP BY 1, 2)")
def empirical_weekday_profile(spark, sf):
    return short_term.empirical_weekday_profile(events_daily(spark, sf)).select("phrase", "weekday", r6("profile"))


@query(
    _with(D)
    + """SELECT phrase, lo = hi AND k = 7 AND n = days AND days = span AS balanced FROM (SELECT phrase, min(c) AS lo, max(c) AS hi, count(*) AS k FROM (SELECT phrase, isodow(day) AS w, count(*) AS c FROM d WHERE day >= DATE '2024-01-03' OR phrase <> 'click' GROUP BY 1, 2) GROUP BY 1)
JOIN (SELECT phrase, count(*) AS n, count(DISTINCT day) AS days, max(day) - min(day) + 1 AS span FROM d WHERE day >= DATE '2024-01-03' OR phrase <> 'click' GROUP BY 1) USING (phrase)"""
)
def weekday_balance(spark, sf):
    return short_term.weekday_balance(events_daily(spark, sf).where("day >= DATE '2024-01-03' OR phrase <> 'click'"))


@query(_with(D, WEEKS, SPIKES) + "SELECT phrase, day, count, round(expected, 6) AS expected, round(ratio, 6) AS ratio FROM sp WHERE ratio >= 1.05")
def detect_spikes(spark, sf):
    return short_term.detect_spikes(events_daily(spark, sf), 1.05).select("phrase", "day", "count", r6("expected"), r6("ratio"))


@query(
    _with(D, WEEKS, SPIKES)
    + """, re AS (SELECT phrase, max(day) AS measured_through, count(*) AS n_days FROM d GROUP BY 1)
SELECT phrase, measured_through, n_days, coalesce(s, '') AS spikes FROM re LEFT JOIN (SELECT phrase, string_agg(CAST(day AS VARCHAR), ',' ORDER BY ratio DESC, day) AS s FROM sp JOIN re USING (phrase) WHERE ratio >= 1.02 AND day > measured_through - 10 GROUP BY 1) USING (phrase)"""
)
def short_term_report(spark, sf):
    r = short_term.short_term_report(events_daily(spark, sf), 10, 1.02)
    return r.select("phrase", "measured_through", "n_days", F.array_join(F.transform("spikes", lambda x: x["day"].cast("string")), ",").alias("spikes"))


ACF = """ac0 AS (SELECT phrase, count - avg(count) OVER (PARTITION BY phrase) AS x, row_number() OVER (PARTITION BY phrase ORDER BY day) AS i, count(*) OVER (PARTITION BY phrase) AS n FROM d),
ac AS (SELECT a.phrase, b.i - a.i AS lag, sum(a.x * b.x) / min(c0) AS acf, min(a.n) AS n FROM ac0 a JOIN ac0 b ON a.phrase = b.phrase AND b.i - a.i BETWEEN 1 AND 14 JOIN (SELECT phrase, sum(x * x) AS c0 FROM ac0 GROUP BY 1) c ON c.phrase = a.phrase GROUP BY 1, 2)"""


@query(_with(D, ACF) + "SELECT phrase, CAST(lag AS INT) AS lag, round(acf, 6) AS acf FROM ac")
def acf_lag(spark, sf):
    return short_term.autocorrelation(events_daily(spark, sf)).select("phrase", "lag", r6("acf"))


@query(_with(D, ACF) + "SELECT phrase, CAST(lag AS INT) AS lag, round(n * (n + 2) * sum(acf * acf / (n - lag)) OVER (PARTITION BY phrase ORDER BY lag), 6) AS q FROM ac")
def ljung_box_q(spark, sf):
    return short_term.ljung_box(events_daily(spark, sf)).select("phrase", "lag", r6("q"))


@query("SELECT event_type AS phrase, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM events GROUP BY 1, 2")
def weekly_blocks(spark, sf):
    return signals.weekly_counts(_table(spark, sf, "events"))


# Breaks

LEVEL = """rm0 AS (SELECT phrase, period, queries, CASE WHEN count(*) OVER f = 12 THEN median(CAST(queries AS DOUBLE)) OVER f END AS lv FROM m WINDOW f AS (PARTITION BY phrase ORDER BY period ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)),
rm AS (SELECT phrase, period, queries, coalesce(first_value(lv IGNORE NULLS) OVER (PARTITION BY phrase ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(lv IGNORE NULLS) OVER (PARTITION BY phrase ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS level FROM rm0)"""
RESID = """lg AS (SELECT phrase, period, ln(1 + CAST(queries AS DOUBLE)) AS l FROM m),
lv0 AS (SELECT *, CASE WHEN count(*) OVER f = 12 THEN median(l) OVER f END AS v FROM lg WINDOW f AS (PARTITION BY phrase ORDER BY period ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)),
lv1 AS (SELECT *, l - coalesce(first_value(v IGNORE NULLS) OVER (PARTITION BY phrase ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(v IGNORE NULLS) OVER (PARTITION BY phrase ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS dev FROM lv0),
pf AS (SELECT phrase, month(period) AS mo, CASE WHEN count(dev) < 2 THEN 0 ELSE median(dev) END AS p FROM lv1 GROUP BY 1, 2),
rs AS (SELECT lv1.phrase, period, l - p AS resid FROM lv1 JOIN pf ON lv1.phrase = pf.phrase AND month(period) = mo)"""
DEV = """dv0 AS (SELECT *, CASE WHEN count(*) OVER f = 13 THEN median(resid) OVER f END AS v FROM rs WINDOW f AS (PARTITION BY phrase ORDER BY period ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
dv AS (SELECT phrase, period, resid, resid - coalesce(first_value(v IGNORE NULLS) OVER (PARTITION BY phrase ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(v IGNORE NULLS) OVER (PARTITION BY phrase ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS deviation FROM dv0)"""
RUNS = """md AS (SELECT phrase, median(deviation) AS med FROM dv GROUP BY 1), ma AS (SELECT phrase, median(abs(deviation - med)) AS mad FROM dv JOIN md USING (phrase) GROUP BY 1),
fl AS (SELECT dv.*, row_number() OVER (PARTITION BY dv.phrase ORDER BY period) - 1 AS idx, mad > 0 AND abs(deviation - med) / (1.4826 * nullif(mad, 0)) > 3.5 AND abs(deviation - med) >= 0.3 AS spike FROM dv JOIN md USING (phrase) JOIN ma USING (phrase))"""


@query(_with(M15, LEVEL) + "SELECT phrase, period, queries, round(level, 6) AS level FROM rm")
def rolling_median(spark, sf):
    return breaks.rolling_median(phrases_monthly(spark, sf)).select("phrase", "period", "queries", r6("level"))


@query(_with(M15, RESID) + "SELECT phrase, period, round(resid, 6) AS resid FROM rs")
def deseasonalize_log(spark, sf):
    return breaks.deseasonalize_log(phrases_monthly(spark, sf)).select("phrase", "period", r6("resid"))


@query(_with(M15, RESID, DEV) + "SELECT phrase, period, round(deviation, 6) AS deviation FROM dv")
def local_deviation(spark, sf):
    return breaks.local_deviation(breaks.deseasonalize_log(phrases_monthly(spark, sf))).select("phrase", "period", r6("deviation"))


@query(_with(M15, RESID, DEV, RUNS) + "SELECT phrase, min(idx) AS start, count(*) AS length FROM (SELECT *, idx - row_number() OVER (PARTITION BY phrase ORDER BY idx) AS island FROM fl WHERE spike) GROUP BY phrase, island")
def spike_runs(spark, sf):
    return breaks.spike_runs(breaks.local_deviation(breaks.deseasonalize_log(phrases_monthly(spark, sf)))).select("phrase", "start", "length")


@query(
    _with(M15, RESID, DEV, RUNS)
    + """, nb AS (SELECT *, last_value(CASE WHEN NOT spike THEN resid END IGNORE NULLS) OVER (PARTITION BY phrase ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS le,
first_value(CASE WHEN NOT spike THEN resid END IGNORE NULLS) OVER (PARTITION BY phrase ORDER BY period ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ri FROM fl)
SELECT phrase, period, round(CASE WHEN spike THEN coalesce((le + ri) / 2, le, ri, resid) ELSE resid END, 6) AS cleaned FROM nb"""
)
def replaced_spikes(spark, sf):
    d = breaks.local_deviation(breaks.deseasonalize_log(phrases_monthly(spark, sf)))
    return breaks.replace_spikes(d).select("phrase", "period", r6("cleaned"))


KNOWN = ["1996-03-01", "1998-07-01", "2000-05-01"]


@query(
    _with(M15, RESID, DEV, RUNS)
    + f""", st AS (SELECT phrase, period AS brk FROM fl WHERE spike), kn AS (SELECT DISTINCT m.phrase, CAST(unnest(['{"', '".join(KNOWN)}']) AS DATE) AS known FROM m)
SELECT phrase, known, coalesce(bool_or(abs((year(brk) * 12 + month(brk)) - (year(known) * 12 + month(known))) <= 1), false) AS covered FROM kn LEFT JOIN st USING (phrase) GROUP BY 1, 2"""
)
def known_dates_coverage(spark, sf):
    m = phrases_monthly(spark, sf)
    flagged = breaks.spike_flags(breaks.local_deviation(breaks.deseasonalize_log(m))).where("spike").select("phrase", F.col("period").alias("at"))
    known = m.select("phrase").distinct().select("phrase", F.explode(F.array(*[F.lit(k).cast("date") for k in KNOWN])).alias("known"))
    return ranking.break_known_dates(flagged, known)


@query()
def break_points(spark, sf):
    return breaks.break_points(phrases_monthly(spark, sf))


@query()
def classify_breaks(spark, sf):
    return breaks.handling(breaks.classify_breaks(phrases_monthly(spark, sf)))


@query()
def breaks_report(spark, sf):
    return breaks.breaks_report(breaks.classify_breaks(phrases_monthly(spark, sf)))


CUTS = "ct AS (SELECT DISTINCT phrase, DATE '1999-06-01' AS brk FROM m WHERE left(phrase, 1) IN ('1', '2'))"


@query(_with(M, CUTS) + "SELECT m.phrase, m.period, m.queries, CAST(coalesce(period > brk, false) AS INT) AS post_break FROM m LEFT JOIN ct USING (phrase)")
def break_dummy(spark, sf):
    m = orders_monthly(spark, sf)
    return breaks.add_dummy(m, m.where("left(phrase, 1) IN ('1', '2')").select("phrase", F.lit("1999-06-01").cast("date").alias("at")))


@query(_with(M, CUTS) + "SELECT m.phrase, m.period, m.queries FROM m LEFT JOIN ct USING (phrase) WHERE brk IS NULL OR period > brk")
def break_truncate(spark, sf):
    m = orders_monthly(spark, sf)
    return breaks.truncate_at(m, m.where("left(phrase, 1) IN ('1', '2')").select("phrase", F.lit("1999-06-01").cast("date").alias("at")))


# Backtest (79 months: the initial window is 48, which gives two folds)

FOLDS = """ix AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY period) - 1 AS idx FROM m),
fo AS (SELECT phrase, CAST(fold AS INT) AS fold, CAST(idx AS INT) AS idx, period, queries, CASE WHEN idx < 48 + fold * 12 THEN 'train' ELSE 'test' END AS part FROM ix, (VALUES (0), (1)) v(fold) WHERE idx < 60 + fold * 12),
nv AS (SELECT t.phrase, t.fold, t.idx, t.period, CAST(t.queries AS DOUBLE) AS actual, CAST(s.queries AS DOUBLE) AS forecast FROM fo t JOIN fo s ON s.phrase = t.phrase AND s.fold = t.fold AND s.part = 'train' AND s.idx = t.idx - 12 WHERE t.part = 'test'),
ms AS (SELECT phrase, fold, mae / scale AS mase FROM (SELECT phrase, fold, avg(abs(actual - forecast)) AS mae FROM nv GROUP BY 1, 2)
 JOIN (SELECT phrase, fold, avg(abs(q - l)) AS scale FROM (SELECT phrase, fold, queries AS q, lag(queries) OVER (PARTITION BY phrase, fold ORDER BY idx) AS l FROM fo WHERE part = 'train') GROUP BY 1, 2) USING (phrase, fold))"""


def folds(spark, sf) -> DataFrame:
    return series.expanding_folds(orders_monthly(spark, sf), 48)


@query(_with(M, FOLDS) + "SELECT * FROM fo")
def expanding_folds(spark, sf):
    return folds(spark, sf)


@query(_with(M, FOLDS) + "SELECT * FROM nv")
def seasonal_naive(spark, sf):
    return series.seasonal_naive(folds(spark, sf))


@query(_with(M, FOLDS) + "SELECT phrase, fold, round(mase, 6) AS mase FROM ms")
def mase_naive(spark, sf):
    f = folds(spark, sf)
    return series.mase(f, series.seasonal_naive(f)).select("phrase", "fold", r6("mase"))


@query(
    _with(M, FOLDS)
    + """, tb AS (SELECT phrase, 'naive' AS model, median(mase) AS mm FROM ms GROUP BY 1 UNION ALL
SELECT phrase, 'mean', median(mase) FROM (SELECT a.phrase, a.fold, avg(abs(actual - mu)) / min(scale) AS mase FROM nv a JOIN (SELECT phrase, fold, avg(CAST(queries AS DOUBLE)) AS mu FROM fo WHERE part = 'train' GROUP BY 1, 2) b USING (phrase, fold)
JOIN (SELECT phrase, fold, avg(abs(q - l)) AS scale FROM (SELECT phrase, fold, queries AS q, lag(queries) OVER (PARTITION BY phrase, fold ORDER BY idx) AS l FROM fo WHERE part = 'train') GROUP BY 1, 2) USING (phrase, fold) GROUP BY 1, 2) GROUP BY 1)
SELECT t.model, round(median(t.mm), 6) AS mase_median, round(avg(CASE WHEN t.mm < b.mm THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS win_rate_vs_baseline, count(*) AS n_phrases FROM tb t JOIN tb b ON b.phrase = t.phrase AND b.model = 'naive' GROUP BY 1"""
)
def backtest_summary(spark, sf):
    f = folds(spark, sf)
    test = series.seasonal_naive(f)
    mean = f.where("part = 'train'").groupBy("phrase", "fold").agg(F.avg(F.col("queries").cast("double")).alias("mu"))
    flat = test.join(mean, ["phrase", "fold"]).withColumn("forecast", F.col("mu"))
    both = series.mase(f, test).withColumn("model", F.lit("naive")).unionByName(series.mase(f, flat).withColumn("model", F.lit("mean")))
    return series.backtest_summary(forecast.backtest_table(both), "naive").select("model", r6("mase_median"), r6("win_rate_vs_baseline"), "n_phrases")


@query()
def backtest_models(spark, sf):
    return forecast.backtest(orders_monthly(spark, sf), initial=48)


@query()
def theta(spark, sf):
    return forecast.backtest(orders_monthly(spark, sf), ("theta",), initial=48)


@query()
def auto_ets(spark, sf):
    return forecast.ets_structure(orders_monthly(spark, sf))


@query()
def auto_arima(spark, sf):
    return forecast.backtest(orders_monthly(spark, sf), ("auto_arima",), initial=48)


@query()
def ets_stability(spark, sf):
    return forecast.stability(orders_monthly(spark, sf))


@query()
def ic_grid(spark, sf):
    return forecast.ic_grid(events_daily(spark, sf))


@query()
def ic_deltas(spark, sf):
    return forecast.ic_deltas(forecast.ic_grid(events_daily(spark, sf)))


@query()
def season_detectors(spark, sf):
    return forecast.detectors(events_daily(spark, sf))


@query()
def weekly_verdict(spark, sf):
    return forecast.weekly_verdict(events_daily(spark, sf))


@query(_with(M) + "SELECT phrase, period, queries FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY period DESC) AS rn FROM m) WHERE rn > 6")
def tail_drop(spark, sf):
    return series.truncate_tail(orders_monthly(spark, sf), 6).select("phrase", "period", "queries")


@query(_with(D) + "SELECT phrase, day, count FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY day DESC) AS rn FROM d) WHERE rn <= 14")
def suffix_window(spark, sf):
    return series.suffix_days(events_daily(spark, sf), 14).select("phrase", "day", F.col("count").cast("double").alias("count"))


# Vectors and similarity

VEC = """vc AS (SELECT phrase, month AS pos, mean AS value FROM prof), pr AS (SELECT a.phrase AS a, b.phrase AS b, corr(a.value, b.value) AS similarity FROM vc a JOIN vc b ON a.pos = b.pos AND a.phrase < b.phrase GROUP BY 1, 2)"""


def profile_vectors(spark, sf) -> DataFrame:
    return series.monthly_profile(phrases_monthly(spark, sf)).select("phrase", F.col("month").alias("pos"), F.col("mean").alias("value"))


@query(_with(M15, PROFILE, VEC) + "SELECT a, b, round(similarity, 6) AS similarity FROM pr")
def pairwise_similarity(spark, sf):
    return text.pairwise_similarity(profile_vectors(spark, sf)).select("a", "b", r6("similarity"))


@query(
    _with(M15, PROFILE, VEC)
    + ", bo AS (SELECT a AS phrase, b AS other, round(similarity, 9) AS s FROM pr UNION ALL SELECT b, a, round(similarity, 9) FROM pr) SELECT phrase, arg_max(other, s) AS nearest FROM bo GROUP BY 1"
)
def nearest_neighbors(spark, sf):
    return text.nearest_neighbors(text.pairwise_similarity(profile_vectors(spark, sf)))


@query(_with(M15, PROFILE) + "SELECT phrase, month, round((mean - avg(mean) OVER p) / nullif(stddev_pop(mean) OVER p, 0), 6) AS z FROM prof WINDOW p AS (PARTITION BY phrase)")
def zscore_block(spark, sf):
    v = profile_vectors(spark, sf).groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"))
    z = v.select("phrase", F.transform("v", lambda x: x["pos"]).alias("pos"), scores.zscores(F.transform("v", lambda x: x["value"])).alias("z"))
    return z.select("phrase", F.explode(F.arrays_zip("pos", "z")).alias("x")).select("phrase", F.col("x.pos").alias("month"), F.round("x.z", 6).alias("z"))


V2 = f"""wv AS (SELECT o_orderpriority AS phrase, 'sp7' AS block, CAST(isodow(o_orderdate) - 1 AS INT) AS pos, CAST(count(*) AS DOUBLE) AS value FROM orders WHERE o_orderdate < DATE '{BEFORE}' GROUP BY 1, 2, 3),
vec AS (SELECT * FROM wv UNION ALL SELECT phrase, 'sp12', month, mean FROM prof),
zv AS (SELECT *, (value - avg(value) OVER p) / nullif(stddev_pop(value) OVER p, 0) AS z FROM vec WINDOW p AS (PARTITION BY phrase, block)),
s2 AS (SELECT a.phrase AS a, b.phrase AS b, corr(a.z, b.z) FILTER (WHERE a.block = 'sp7') AS sp7, corr(a.z, b.z) FILTER (WHERE a.block = 'sp12') AS sp12, corr(a.z, b.z) AS combined
 FROM zv a JOIN zv b ON a.block = b.block AND a.pos = b.pos AND a.phrase < b.phrase GROUP BY 1, 2)"""


def season_vectors(spark, sf) -> DataFrame:
    o = _table(spark, sf, "orders").where(f"o_orderdate < DATE '{BEFORE}'")
    week = o.groupBy(F.col("o_orderpriority").alias("phrase"), F.weekday(F.col("o_orderdate").cast("date")).alias("pos")).agg(F.count(F.lit(1)).alias("value"))
    month = series.monthly_profile(orders_monthly(spark, sf)).select("phrase", F.col("month").alias("pos"), F.col("mean").alias("value"))
    return vectors.blocks(week, month)


@query(_with(M, PROFILE, V2) + "SELECT a, b, round(sp7, 6) AS sp7, round(sp12, 6) AS sp12, round(combined, 6) AS combined FROM s2")
def combined_similarity(spark, sf):
    return vectors.similarities(season_vectors(spark, sf)).select("a", "b", r6("sp7"), r6("sp12"), r6("combined"))


@query(_with(M, PROFILE, V2) + "SELECT string_agg(a || ' <-> ' || b, ';' ORDER BY round(combined, 9) DESC, a || ' <-> ' || b) AS pairs FROM s2")
def structure_fingerprint(spark, sf):
    return vectors.fingerprint(vectors.similarities(season_vectors(spark, sf))).select(F.array_join("pairs", ";").alias("pairs"))


@query(
    _with(M, PROFILE, V2)
    + """, bo AS (SELECT a AS phrase, b AS other, round(sp7, 9) AS u, round(combined, 9) AS v FROM s2 UNION ALL SELECT b, a, round(sp7, 9), round(combined, 9) FROM s2),
n AS (SELECT phrase, arg_max(other, u) AS x, arg_max(other, v) AS y FROM bo GROUP BY 1) SELECT phrase, x = y AS preserved, false AS undefined_in_both, false AS undefined_in_either FROM n"""
)
def neighbour_preserved(spark, sf):
    s = vectors.similarities(season_vectors(spark, sf))
    return vectors.preserved(vectors.neighbours(s, "sp7"), vectors.neighbours(s))


@query(_with(M, PROFILE, V2) + "SELECT phrase, block, round(max(value) - min(value), 6) AS range, round(stddev_pop(value), 6) AS std, arg_max(pos, (value, -pos)) AS argmax, round(max(value), 6) AS top FROM vec GROUP BY 1, 2")
def seasonal_discrimination(spark, sf):
    return vectors.discrimination(season_vectors(spark, sf)).select("phrase", "block", r6("range"), r6("std"), "argmax", r6("top"))


@query(
    _with(M)
    + """, cy AS (SELECT phrase, CAST(queries AS DOUBLE) AS q, row_number() OVER (PARTITION BY phrase ORDER BY period DESC) - 1 AS rn FROM m)
SELECT a.phrase, round(corr(a.q, b.q), 6) AS corr, round(avg(abs(a.q - b.q)), 6) AS mae, round(avg(abs(a.q - b.q)) / (max(a.q) - min(a.q)), 6) AS mae_rel FROM cy a JOIN cy b ON a.phrase = b.phrase AND a.rn = b.rn + 12 WHERE b.rn < 12 GROUP BY 1"""
)
def cycle_agreement(spark, sf):
    return vectors.cycle_agreement(orders_monthly(spark, sf)).select("phrase", r6("corr"), r6("mae"), r6("mae_rel"))


@query()
def simulated_flips(spark, sf):
    return forecast.structure_flips(events_daily(spark, sf))


@query()
def kmeans_seed_agreement(spark, sf):
    return text.multi_seed_kmeans(labelled_vectors(spark, sf).select("id", "embedding"), 5)


@query(
    """SELECT phrase, count(*) AS runs FROM (SELECT DISTINCT o_orderpriority || '/' || CAST(o_custkey % 50 AS VARCHAR) AS phrase, o_orderstatus AS run_dir FROM orders) GROUP BY 1 HAVING count(*) > 1"""
)
def duplicate_phrases(spark, sf):
    o = _table(spark, sf, "orders")
    return series.duplicate_phrases(o.select(F.concat_ws("/", "o_orderpriority", (F.col("o_custkey") % 50).cast("string")).alias("phrase"), F.col("o_orderstatus").alias("run_dir")))


@query()
def results_block(spark, sf):
    t = forecast.backtest_table(forecast.backtest(orders_monthly(spark, sf), initial=48))
    return forecast.results_block(series.backtest_summary(t, "naive"))


# EDA


@query(
    _with(M15)
    + """, q AS (SELECT phrase, quantile_cont(CAST(queries AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(queries AS DOUBLE), 0.75) AS q3 FROM m GROUP BY 1)
SELECT phrase, count(*) AS n, CAST(min(queries) AS DOUBLE) AS lo, CAST(max(queries) AS DOUBLE) AS hi, round(median(CAST(queries AS DOUBLE)), 6) AS median, round(stddev_samp(queries) / avg(queries), 6) AS cv, round(min(q1), 6) AS q1, round(min(q3), 6) AS q3,
count(*) FILTER (WHERE queries < q1 - 1.5 * (q3 - q1) OR queries > q3 + 1.5 * (q3 - q1)) AS outliers FROM m JOIN q USING (phrase) GROUP BY 1"""
)
def eda_summary(spark, sf):
    return series.eda_summary(phrases_monthly(spark, sf)).select("phrase", "n", "lo", "hi", r6("median"), r6("cv"), r6("q1"), r6("q3"), "outliers")


@query(_with(M15) + "SELECT phrase, CAST(quarter(period) AS INT) AS quarter, round(avg(CAST(queries AS DOUBLE)), 6) AS mean FROM m GROUP BY 1, 2")
def quarter_means(spark, sf):
    return series.quarter_means(phrases_monthly(spark, sf)).select("phrase", "quarter", r6("mean"))


@query(_with(M15, AGE) + "SELECT phrase, round(corr(q, ago), 6) AS corr FROM l12 WHERE ago IS NOT NULL GROUP BY 1")
def year_over_year_corr(spark, sf):
    return series.year_over_year(phrases_monthly(spark, sf)).select("phrase", r6("corr"))


# Text and clusters

TOK = "regexp_extract_all(lower(p_name), '[а-яёa-z]+(?:-[а-яёa-z]+)*')"


@query(f"SELECT p_partkey AS id, array_to_string({TOK}, ' ') AS tokens FROM part")
def tokens(spark, sf):
    return _table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(text.tokens(F.col("p_name")), " ").alias("tokens"))


TFIDF = f"""tk AS (SELECT doc, term, count(*) AS tf FROM (SELECT p_partkey AS doc, unnest({TOK}) AS term FROM part) GROUP BY 1, 2),
wt AS (SELECT doc, term, (1 + ln(CAST(tf AS DOUBLE))) * (ln((CAST(1 AS DOUBLE) + (SELECT count(*) FROM part)) / (1 + df)) + 1) AS w FROM tk JOIN (SELECT term, count(*) AS df FROM tk GROUP BY 1) USING (term)),
ti AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS weight FROM wt)"""


def part_tfidf(spark, sf) -> DataFrame:
    return text.tfidf(_table(spark, sf, "part").select(F.col("p_partkey").alias("doc"), text.tokens(F.col("p_name")).alias("tokens")))


@query(_with(TFIDF) + "SELECT doc, term, round(weight, 6) AS weight FROM ti")
def tfidf(spark, sf):
    return part_tfidf(spark, sf).select("doc", "term", r6("weight"))


@query(
    _with(TFIDF)
    + """, mt AS (SELECT p_brand AS cluster, term, round(sum(weight) / min(n), 9) AS mean FROM ti JOIN part ON doc = p_partkey JOIN (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) USING (p_brand) GROUP BY 1, 2)
SELECT cluster, term, round(mean, 6) AS mean, place FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY mean DESC, term) AS place FROM mt) WHERE place <= 5"""
)
def cluster_terms(spark, sf):
    brand = _table(spark, sf, "part").select(F.col("p_partkey").alias("doc"), F.col("p_brand").alias("cluster"))
    return text.mean_tfidf(part_tfidf(spark, sf), brand).select("cluster", "term", r6("mean"), "place")


@query(
    f"""WITH n AS (SELECT p_brand AS cluster, lemma, count(*) AS n FROM (SELECT p_brand, unnest({TOK}) AS lemma FROM part) GROUP BY 1, 2)
SELECT cluster, string_agg(lemma, ', ' ORDER BY r) AS label FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, lemma) AS r FROM n) WHERE r <= 3 GROUP BY 1"""
)
def top_lemmas(spark, sf):
    return text.top_lemmas(_table(spark, sf, "part").select(F.col("p_brand").alias("cluster"), text.tokens(F.col("p_name")).alias("lemmas")))


def labelled_vectors(spark, sf) -> DataFrame:
    return _table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), "embedding")


@query(
    """WITH e AS (SELECT vec_id AS id, label AS cluster, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
d AS (SELECT a.id, a.cluster, b.cluster AS other, avg(list_distance(a.v, b.v)) AS d FROM e a JOIN e b ON a.id <> b.id GROUP BY 1, 2, 3),
s AS (SELECT id, cluster, max(d) FILTER (WHERE cluster = other) AS own, min(d) FILTER (WHERE cluster <> other) AS near FROM d GROUP BY 1, 2)
SELECT id, cluster, round(CASE WHEN own IS NULL OR near IS NULL THEN 0 ELSE (near - own) / greatest(own, near) END, 6) AS s FROM s"""
)
def silhouette(spark, sf):
    return text.silhouette(labelled_vectors(spark, sf)).select("id", "cluster", r6("s"))


@query(
    """WITH e AS (SELECT vec_id AS id, label AS cluster, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
c0 AS (SELECT cluster, pos, avg(x) AS m FROM (SELECT cluster, unnest(v) AS x, unnest(range(len(v))) AS pos FROM e) GROUP BY 1, 2), c AS (SELECT cluster, list(m ORDER BY pos) AS c FROM c0 GROUP BY 1)
SELECT cluster, place, id FROM (SELECT e.cluster, e.id, row_number() OVER (PARTITION BY e.cluster ORDER BY round(list_distance(v, c), 9), id) AS place FROM e JOIN c USING (cluster)) WHERE place <= 3"""
)
def centroid_nearest(spark, sf):
    return text.centroid_nearest(labelled_vectors(spark, sf))


@query(
    """WITH c AS (SELECT label AS a, vec_id % 7 AS b, CAST(count(*) AS DOUBLE) AS n FROM embeddings GROUP BY 1, 2),
j AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS t FROM c), a AS (SELECT sum(n * (n - 1) / 2) AS ai FROM (SELECT a, sum(n) AS n FROM c GROUP BY 1)), b AS (SELECT sum(n * (n - 1) / 2) AS bj FROM (SELECT b, sum(n) AS n FROM c GROUP BY 1))
SELECT round((ij - ai * bj / (t * (t - 1) / 2)) / ((ai + bj) / 2 - ai * bj / (t * (t - 1) / 2)), 6) AS ari FROM j, a, b"""
)
def adjusted_rand(spark, sf):
    return text.adjusted_rand(_table(spark, sf, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 7).alias("b"))).select(r6("ari"))


@query()
def kmeans(spark, sf):
    return text.kmeans(labelled_vectors(spark, sf).select("id", "embedding"), 10)


# Graph

EDGES = """it AS (SELECT DISTINCT l_orderkey AS basket, CAST(l_partkey AS VARCHAR) AS item FROM lineitem), ed AS (SELECT a.item AS src, b.item AS dst, count(*) AS frequency FROM it a JOIN it b ON a.basket = b.basket AND a.item <> b.item GROUP BY 1, 2)"""


def part_edges(spark, sf) -> DataFrame:
    return graph.co_occurrence(_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").cast("string").alias("item")))


@query(_with(EDGES) + "SELECT * FROM ed")
def edges(spark, sf):
    return part_edges(spark, sf)


@query(
    _with(EDGES)
    + ", d0 AS (SELECT '1' AS phrase, 0 AS depth), d1 AS (SELECT DISTINCT dst AS phrase, 1 AS depth FROM ed WHERE src = '1'), d2 AS (SELECT DISTINCT dst AS phrase, 2 AS depth FROM ed JOIN d1 ON src = d1.phrase) SELECT phrase, CAST(min(depth) AS INT) AS depth FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2) GROUP BY 1"
)
def bfs_depth(spark, sf):
    return graph.bfs_depth(part_edges(spark, sf), spark.createDataFrame([("1",)], "phrase string"), 2)


@query(
    "WITH RECURSIVE "
    + EDGES.replace("ed AS (", "ed AS MATERIALIZED (")
    + """, walk(n, phrase, depth, seen) AS (SELECT 1, '1', 0, [{'p': '1', 'd': 0}] UNION ALL
SELECT n + 1, best.p, best.d, list_append(seen, best) FROM (SELECT n, seen, arg_min({'p': dst, 'd': d + 1}, (-frequency, dst, d)) AS best
FROM (SELECT w.n, w.seen, unnest(w.seen).p AS src, unnest(w.seen).d AS d FROM walk w) JOIN ed USING (src) WHERE d < 2 AND NOT list_contains(list_transform(seen, lambda x: x.p), dst) GROUP BY n, seen) WHERE n < 1000)
SELECT phrase, CAST(depth AS INT) AS depth FROM walk"""
)
def priority_traversal(spark, sf):
    return graph.priority_traversal(part_edges(spark, sf).cache(), ["1"])


@query(
    _with(EDGES)
    + """, fr AS (SELECT dst AS phrase, max(frequency) AS frequency FROM ed WHERE src IN ('1', '2', '3') GROUP BY 1)
SELECT phrase, row_number() OVER (ORDER BY frequency DESC, phrase) AS place FROM fr WHERE phrase NOT IN ('1', '2', '3') ORDER BY frequency DESC, phrase LIMIT 10"""
)
def pick_pending(spark, sf):
    seen = spark.createDataFrame([("1",), ("2",), ("3",)], "phrase string")
    e = part_edges(spark, sf).join(seen.withColumnRenamed("phrase", "src"), "src", "left_semi")
    front = e.select(F.col("dst").alias("phrase"), F.col("frequency").cast("double").alias("frequency"), F.lit(False).alias("is_seed"))
    return graph.pick_pending(front, seen, seen.limit(0), 10)


@query(
    """SELECT phrase, created_at, run_dir FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY created_at DESC, run_dir) AS n FROM (SELECT o_orderpriority AS phrase, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS created_at, CAST(o_orderkey AS VARCHAR) AS run_dir FROM orders)) WHERE n = 1"""
)
def latest_run(spark, sf):
    o = _table(spark, sf, "orders")
    return graph.latest_run(o.select(F.col("o_orderpriority").alias("phrase"), F.col("o_orderdate").cast("date").cast("string").alias("created_at"), F.col("o_orderkey").cast("string").alias("run_dir")))


# Display


@query(
    _with(M)
    + f"""SELECT phrase, period, replace(format('{{:,}}', queries), ',', '{display.THIN}') AS number, {RU}[month(period)] || ' ' || CAST(year(period) AS VARCHAR) AS month_ru, CAST(year(period) AS VARCHAR) || '年' || CAST(month(period) AS VARCHAR) || '月' AS month_zh,
'1 ' || ['{"', '".join(display.GENITIVE)}'][month(period)] || ' ' || CAST(year(period) AS VARCHAR) || ' г.' AS date_ru, 'в ' || ['{"', '".join(display.PREPOSITIONAL)}'][month(period)] AS month_in FROM m"""
)
def format_values(spark, sf):
    p = F.col("period")
    return orders_monthly(spark, sf).select(
        "phrase",
        "period",
        display.format_number(F.col("queries").cast("double")).alias("number"),
        display.format_month(p).alias("month_ru"),
        display.format_month(p, "zh").alias("month_zh"),
        display.format_date(p).alias("date_ru"),
        F.concat(F.lit("в "), display.format_month_name(F.month("period"))).alias("month_in"),
    )


@query(
    _with(M15, PROFILE, AMP, GROWTH, AGE, RECORDS)
    + f"""SELECT phrase, CASE klass WHEN 'GROWING' THEN 'рост к прогнозу в ' || replace(printf('%.1f', score), '.', ',') || ' раза, рост идёт ' || CAST(coalesce(age, 1) AS VARCHAR) || ' мес.' WHEN 'SEASONAL' THEN '{display.EXPLAIN["ru"]["SEASONAL"]}'
WHEN 'FALLING' THEN 'в ' || replace(printf('%.1f', score), '.', ',') || ' раза реже прогноза' ELSE '{display.EXPLAIN["ru"]["STABLE"]}' END AS why, CASE klass WHEN 'GROWING' THEN '增长' WHEN 'SEASONAL' THEN '季节性' WHEN 'FALLING' THEN '下降' ELSE '平稳' END AS label_zh FROM rec"""
)
def explain_template(spark, sf):
    r = ranking.phrase_records(phrases_monthly(spark, sf)).withColumn("klass", scores.classify(F.col("score"), F.col("amplitude")))
    return r.select("phrase", display.explain(F.col("klass"), F.col("score"), F.col("age")).alias("why"), scores.class_label(F.col("klass"), scores.LABELS_ZH).alias("label_zh"))


@query("SELECT n_name AS phrase, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) END AS translation, CASE WHEN n_nationkey % 2 = 0 THEN 'cache' ELSE 'missing' END AS origin FROM nation")
def translation_cache(spark, sf):
    n = _table(spark, sf, "nation")
    cache = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("phrase"), F.lower("n_name").alias("translation"))
    return translate(n.select(F.col("n_name").alias("phrase")), cache)


@query()
def artifact_json(spark, sf):
    return showcase.document(phrases_monthly(spark, sf), clusters(spark, sf), "2001-08-01T00:00:00Z", filtered(spark, sf))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly series, growth against forecast, class and rank, in display order."""
    return rank_showcase(spark, sf_dir).orderBy("rank")


@query("""SELECT n_name AS phrase, '&lt;b&gt;' || n_name || ' &amp;&quot;&#x27;{ {' || n_name || '}}' AS shown FROM nation""")
def escape_data(spark, sf):
    n = F.col("n_name")
    return _table(spark, sf, "nation").select(n.alias("phrase"), display.escape_data(F.concat(F.lit("<b>"), n, F.lit(" &\"'{{"), n, F.lit("}}"))).alias("shown"))


@query(
    """SELECT count(*) FILTER (WHERE o_orderstatus <> 'F') AS collected, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed,
arg_max(o_orderpriority, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus = 'F') AS last_error FROM orders"""
)
def run_status(spark, sf):
    failed = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
    return runs.run_status(_table(spark, sf, "orders").select(F.col("o_orderkey").alias("phrase"), F.col("o_orderdate").alias("at"), failed.alias("error")))
