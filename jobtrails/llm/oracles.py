"""DuckDB SQL for the queries of this folder that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op3_host_quality"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), win AS (
  SELECT rid, unnest(range(1, len(ws) - 6)) AS p, ws FROM w WHERE len(ws) >= 8
), keyed AS (
  SELECT rid, p, array_to_string(ws[p:p + 7], ' ') AS k FROM win
), hit AS (
  SELECT rid, p FROM keyed QUALIFY count(*) OVER (PARTITION BY rid, k) > 1
), rep AS (
  SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + 8)) AS q FROM hit) GROUP BY rid
), base AS (
  SELECT w.rid, doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (rid)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
), h AS (
  SELECT host, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS x FROM f WHERE host IS NOT NULL GROUP BY host
), c AS (
  SELECT sum(n) AS n, sum(x) / sum(n) AS m, count(*) AS k, sum(x * x / n) / sum(n) AS xx FROM h
), v AS (
  SELECT *, xx - m * m - m * (1 - m) * k / n AS v FROM c
), prior AS (
  SELECT m, CASE WHEN v > 0 AND m > 0 AND m < 1 THEN greatest(m * (1 - m) / v - 1, 1.0) ELSE n END AS s FROM v
), verdict AS (
  SELECT host, (x + m * s) / (n + s) <= 0.6 AS host_kept FROM h, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(host_kept, TRUE) AS kept
FROM f LEFT JOIN verdict USING (host)
"""

ORACLES["op5_url_filter"] = r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(rule, verdict) AS (
  VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')
), p AS (
  SELECT rule, verdict, split_part(rule, '/', 1) AS rh, substr(rule, strpos(rule, '/')) AS rp FROM r
), hit AS (
  SELECT host, path, arg_max(rule, k) AS rule, arg_max(verdict, k) AS verdict
  FROM (SELECT DISTINCT host, path, rule, verdict,
               1000000 * len(string_split(rh, '.')) + 10 * length(rp) + (verdict = 'block')::INT AS k
        FROM u JOIN p ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
  GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN hit USING (host, path)
"""

ORACLES["op11_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS original FROM d
), f AS (
  SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > original, FALSE)::INT AS bits FROM w
), l AS (
  SELECT doc_id, max(coalesce(quality = 1, FALSE)::INT) AS good, max(coalesce(toxic = 1, FALSE)::INT) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), h AS (
  SELECT part, bits, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, bits
), filters(name, bit) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bs
  FROM filters a, filters b, filters c, filters d, filters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, bs[step] AS bit, coalesce(list_sum(bs[1:step - 1]), 0)::INT AS earlier
  FROM orders, (SELECT unnest(range(1, 6))::INT AS step)
), counted AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN bits & (earlier | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN bits & earlier = 0 AND bits & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN bits & earlier <> 0 AND bits & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN bits = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN bits & earlier = 0 AND bits & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN bits & earlier = 0 AND bits & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM h, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM counted
"""
