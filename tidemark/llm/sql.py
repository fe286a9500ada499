"""DuckDB SQL that the queries of the subpackage must agree with."""

DECONTAMINATE_SQL = r"""
WITH low AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
), bk AS (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS win FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM bk)
), ks AS (SELECT DISTINCT k FROM bw
), dw AS (
  SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM low, ks)
), hits AS (SELECT doc_id, s, dw.k, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k
), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id
), its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM low LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

#: Runs as windows of joined text: no ranks, no suffix array.
LINE_RUNS_SQL = r"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents
), raw AS (SELECT doc_id, unnest(ls) AS s, unnest(range(0, len(ls))) AS line FROM cut
), n AS (
  SELECT doc_id, line, s, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i
  FROM raw WHERE regexp_matches(s, '[^\x20\x09-\x0D]')
), x AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS y FROM n
), spans AS (
  SELECT doc_id, i AS first, max(i) OVER w AS last, sum(words) OVER w AS total FROM (SELECT *, y - words AS x FROM x)
  WINDOW w AS (PARTITION BY doc_id ORDER BY x RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION
  SELECT doc_id, min(i) OVER w AS first, i AS last, sum(words) OVER w AS total FROM x
  WINDOW w AS (PARTITION BY doc_id ORDER BY y RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), win AS (SELECT DISTINCT doc_id, first, last FROM spans WHERE total >= 50
), txt AS (
  SELECT win.doc_id, first, last, string_agg(s, chr(10) ORDER BY i) AS t FROM win JOIN n ON n.doc_id = win.doc_id AND n.i BETWEEN first AND last GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER p AS rn, first_value(doc_id) OVER p AS d0, first_value(last) OVER p AS last0 FROM txt WINDOW p AS (PARTITION BY t ORDER BY doc_id, first)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = d0 THEN greatest(first, last0 + 1) ELSE first END, last + 1)) AS i FROM ranked WHERE rn > 1
), del AS (SELECT doc_id, line FROM gone JOIN n USING (doc_id, i)
), per AS (SELECT doc_id, count(*) AS n_deleted, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS deleted FROM del GROUP BY doc_id
), kept AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY line) AS t FROM raw ANTI JOIN del USING (doc_id, line) GROUP BY doc_id
)
SELECT c.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted, coalesce(deleted, '') AS deleted, sha256(coalesce(t, '')) AS text_sha256
FROM cut c LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

WARC_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= 100
"""


def mix_sql(weights: dict[str, dict[str, float]], max_epochs: int = 4, seed: int = 42) -> str:
    """The mixture of op3 with as many tokens as there are: budgets level by level, then prefixes by running sums of whole leaves."""
    names = list(weights["domain"])
    domain = " ".join(f"WHEN {at} THEN '{n}'" for at, n in enumerate(names))
    levels = ("domain", "lang", "source")
    parts = []
    for at, level in enumerate(levels):
        here, above = ", ".join(levels[: at + 1]), levels[:at]
        by = f"PARTITION BY {', '.join(above)}" if above else ""
        weight = "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {float(v)}" for k, v in weights.get(level, {}).items()) + " ELSE 1.0 END" if weights.get(level) else "1.0"
        given = f"g{at - 1}.budget" if at else "(SELECT sum(t) FROM leaf)"
        join = f"JOIN g{at - 1} USING ({', '.join(above)})" if at else ""
        parts.append(f"""
n{at} AS (SELECT n.*, CAST({given} AS BIGINT) AS given, CAST(cap AS DOUBLE) / weight AS ratio FROM (SELECT {here}, CAST(sum(cap) AS BIGINT) AS cap, CAST({weight} AS DOUBLE) AS weight FROM leaf GROUP BY {here}) n {join}),
u{at} AS (SELECT *, (given - coalesce(sum(cap) OVER ({by} ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER ({by} ORDER BY ratio, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM n{at}),
s{at} AS (SELECT *, max(CASE WHEN ratio > level THEN level END) OVER ({by}) AS share FROM u{at}),
g{at} AS (SELECT {here}, CAST(least(cap, greatest(CASE WHEN share IS NULL OR ratio <= level THEN cap ELSE floor(weight * share + 1e-6) END, 0)) AS BIGINT) AS budget FROM s{at}),""")
    return rf"""
WITH d AS (
  SELECT doc_id, CASE CAST('0x' || substr(md5(coalesce(source, '')), 1, 4) AS INTEGER) % 3 {domain} END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         lang AS lang0, source AS source0, len(regexp_extract_all(text, '[^ 	-]+')) AS tokens FROM documents
), e AS (SELECT * FROM d WHERE tokens > 0
), leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS t, CAST(sum(tokens) AS BIGINT) * {max_epochs} AS cap FROM e GROUP BY ALL),{"".join(parts)}
p AS (SELECT e.*, g2.budget // leaf.t AS epochs, g2.budget % leaf.t AS rest FROM e JOIN g2 USING (domain, lang, source) JOIN leaf USING (domain, lang, source)
), c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || epochs || ':' || doc_id)) AS upto FROM p)
SELECT doc_id, domain, lang0 AS lang, source0 AS source, CAST(tokens AS BIGINT) AS tokens, CAST(epochs AS INTEGER) AS epochs, CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM c WHERE epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""
