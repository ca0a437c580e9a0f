"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

#: The words of a text as a list.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+')"

SUBSTRING = rf"""WITH t AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM dup, range(0, 20) r(k)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM t),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY p) AS k FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)"""


def mixing(seed: str, digits: int) -> str:
    """Equal weights, as many documents as there are; Poisson by summed logarithms."""
    return f"""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT source, (SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * CAST(n AS DOUBLE)) AS rate FROM c),
cdf AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM r, range(0, 200) g(k)),
u AS (SELECT *, CAST('0x' || substr(md5('{seed}:1:' || CAST(doc_id AS VARCHAR)), 1, {digits}) AS BIGINT) / CAST({16**digits} AS DOUBLE) AS u FROM documents),
drawn AS (SELECT u.*, (SELECT count(*) FROM cdf WHERE cdf.source = u.source AND cdf.c < u.u) AS n_copies FROM u),
cop AS (SELECT *, unnest(range(1, n_copies + 1)) AS k FROM drawn WHERE n_copies > 0)
SELECT doc_id, text, lang, source, n_chars, CAST(n_copies AS INTEGER) AS n_copies, CAST(k AS INTEGER) AS copy,
md5('{seed}:order:' || CAST(doc_id AS VARCHAR) || ':' || CAST(k AS VARCHAR)) AS order_key FROM cop"""


def secrets(rules) -> str:
    """Spans by adding up the pieces between matches, for each rule."""
    parts = []
    for i, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {i} AS o, '{r.kind}' AS kind, {str(r.base).lower()} AS base, {r.least} AS least, regexp_extract_all(x, '{p}') AS m, regexp_extract_all(x, '{p}', {r.group}) AS g, regexp_split_to_array(x, '{p}') AS s
FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)"""
        )
    return f"""WITH a AS ({" UNION ALL ".join(parts)}),
b AS (SELECT doc_id, o, kind, base, least, unnest(m) AS m, unnest(g) AS g, unnest(range(1, len(m) + 1)) AS i, s, m AS ms FROM a WHERE len(m) > 0),
c AS (SELECT doc_id, o, kind, base, length(g) AS n, least, list_sum(list_transform(s[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda z: length(z))), 0) AS a, length(m) AS l FROM b),
d AS (SELECT doc_id, o, kind, base, CAST(a AS BIGINT) AS a, CAST(a + l AS BIGINT) AS e FROM c WHERE n >= least),
f AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, o) FILTER (WHERE base) AS bs, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, o) AS spans FROM d GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(bs, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN f USING (doc_id)"""
