"""DuckDB SQL for those training-data queries that SQL can express, over the whole tables."""

from __future__ import annotations

from .quality import SYMBOLS, QualityRules
from .urls import RULES, Mining

_SPACE = r"\x20\x09-\x0D"
_WORD = rf"[^{_SPACE}]+"


def _jaccard_sql(width: int, percent: int) -> str:
    """Sets of shingles, pairs that share one, components of the links."""
    tails = ", ".join(f"w[{k + 1}:]" for k in range(width))
    return rf"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
  s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= {width} THEN list_transform(list_distinct(list_zip({tails}, true)), lambda x: x::VARCHAR) WHEN len(w) > 0 THEN [w::VARCHAR] ELSE [] END) AS item FROM t),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY 1, 2),
  link AS (SELECT u, v FROM both_ JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= {percent} * (x.n + y.n - k)),
  e AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
  walk(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.v, walk.root FROM walk JOIN e ON e.u = walk.doc_id)
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
  FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(root) AS component_id FROM walk GROUP BY 1) c USING (doc_id)"""


def _quality_sql(rules: QualityRules) -> str:
    """Counts, references of each language and Jensen-Shannon distances to them."""
    kinds = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "space": r" \t\r\x0b\x0c", "newline": r"\n", "stop": r".,;:?''\x22\-()", "symbol": SYMBOLS, "beyond": r"\x{80}-\x{10FFFF}"}
    chars = ", ".join(f"'{k}': length(text) - length(regexp_replace(text, '[{c}]', '', 'g'))" for k, c in kinds.items())
    return rf"""WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
  p AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM t),
  win AS (SELECT doc_id, i, word, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, b, c) AS k FROM win WHERE c IS NOT NULL),
  rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) WHERE k > 1 GROUP BY 1),
  base AS (SELECT t.doc_id, len(w) AS n_words, length(regexp_replace(text, '[{_SPACE}]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS lines, coalesce(rep.n, 0) AS n_repeat_words FROM t LEFT JOIN rep USING (doc_id)),
  few AS (SELECT doc_id, lang, strlen(text) AS bytes, length(text) AS n, MAP {{{chars}}} AS m FROM t),
  every AS (SELECT * EXCLUDE (m), map_concat(m, MAP {{'other': CAST(n - list_sum(map_values(m)) AS BIGINT)}}) AS m FROM few),
  cls AS (SELECT doc_id, lang, bytes, n, unnest(map_keys(m)) AS kind, unnest(map_values(m)) AS k FROM every),
  med AS (SELECT lang, kind, quantile_disc(CAST(round_even(10000 * k / n::DOUBLE, 0) AS BIGINT), 0.5) AS k FROM cls WHERE lang IS NOT NULL AND bytes >= {rules.min_chars} GROUP BY 1, 2),
  cref AS (SELECT lang, kind, k / greatest(1, sum(k) OVER (PARTITION BY lang))::DOUBLE AS q FROM med),
  cpair AS (SELECT doc_id, r.lang, c.k / c.n::DOUBLE AS p, q FROM cls c JOIN cref r USING (kind) WHERE c.n >= {rules.min_chars}),
  wl AS (SELECT lang, word, count(*) AS k FROM p JOIN t USING (doc_id) WHERE lang IS NOT NULL GROUP BY 1, 2),
  wr AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k DESC, word) AS r, sum(k) OVER (PARTITION BY lang) AS total FROM wl),
  top AS (SELECT lang, word, k / total::DOUBLE AS q FROM wr WHERE r <= {rules.common_words}),
  langs AS (SELECT DISTINCT lang FROM t WHERE lang IS NOT NULL), vocab AS (SELECT DISTINCT word FROM top),
  wref AS (SELECT lang, word, coalesce(q, 0) AS q FROM langs CROSS JOIN vocab LEFT JOIN top USING (lang, word) UNION ALL SELECT lang, NULL, greatest(0, 1 - coalesce(sum(q), 0)) FROM langs LEFT JOIN top USING (lang) GROUP BY 1),
  wd AS (SELECT doc_id, v.word, count(*) AS k FROM p LEFT JOIN vocab v USING (word) GROUP BY 1, 2),
  long_ AS (SELECT doc_id, n_words FROM base WHERE n_words >= {rules.min_words}),
  wpair AS (SELECT l.doc_id, r.lang, coalesce(d.k, 0) / l.n_words::DOUBLE AS p, q FROM long_ l CROSS JOIN wref r LEFT JOIN wd d ON d.doc_id = l.doc_id AND d.word IS NOT DISTINCT FROM r.word),
  far AS (SELECT what, doc_id, lang, CASE WHEN sum(p) = 0 OR sum(q) = 0 THEN 1 ELSE sqrt(least(1, greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))) END AS far
    FROM (SELECT 'c' AS what, * FROM cpair UNION ALL SELECT 'w', * FROM wpair) GROUP BY 1, 2, 3),
  least_ AS (SELECT doc_id, min(CASE WHEN what = 'c' THEN far END) AS cd, min(CASE WHEN what = 'w' THEN far END) AS wd FROM far GROUP BY 1),
  out AS (SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, cd, wd FROM base LEFT JOIN least_ USING (doc_id))
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance,
  NOT (base_failed OR coalesce(cd > {rules.char_distance}, false) OR coalesce(wd > {rules.word_distance}, false)) AS kept FROM out"""


def _url_sql(mining: Mining) -> str:
    """Fixed rules, then every combination of tokens of labelled urls with its support and confidence.

    Rules that a shorter one makes needless are not pruned here, as they block nothing more.
    """
    fits = []
    for kind, rule in sorted(RULES, key=lambda r: -len(r[1])):
        of, _, start = rule.partition("/")
        fits.append((f"WHEN ends_with('.' || host, '.{of}') AND starts_with(path, '/{start}') THEN", rule, kind))
    named = " ".join(f"{when} '{rule}'" for when, rule, _ in fits)
    verdict = " ".join(f"{when} '{kind}'" for when, _, kind in fits)
    return rf"""WITH RECURSIVE raw AS (SELECT page_id, coalesce(url, '') AS url FROM pages), cut AS (SELECT page_id, translate(regexp_extract(url, '(?s)\A.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)\A.*?://([^/?#]*)([^?#]*)', 2) AS path FROM raw),
  u AS (SELECT *, list_distinct(list_concat(list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x), list_transform(list_filter(string_split(regexp_replace(path, '[0-9]+', '0', 'g'), '/'), lambda x: x <> ''), lambda x: 'p:' || x))) AS items FROM cut),
  known AS (SELECT doc_id, min(quality) = 0 AS bad FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1), lab AS (SELECT page_id, bad FROM u JOIN known ON doc_id = page_id WHERE len(items) > 0),
  h AS (SELECT page_id, unnest(items) AS item FROM u),
  every(page_id, s, last) AS (SELECT page_id, [item], item FROM h UNION ALL SELECT every.page_id, list_append(s, item), item FROM every JOIN h USING (page_id) WHERE item > last),
  rate AS (SELECT count(*)::DOUBLE AS total, count(*) FILTER (bad)::DOUBLE AS bad FROM lab),
  seen AS (SELECT s, count(*)::DOUBLE AS seen, count(*) FILTER (l.bad)::DOUBLE AS bad FROM every JOIN lab l USING (page_id) GROUP BY 1),
  rules AS (SELECT s FROM seen, rate WHERE rate.bad > 0 AND seen.bad >= ceil(greatest({mining.bad_support}::DOUBLE, 2 / total) * total) AND seen.bad / seen >= {mining.confidence} AND seen.bad / seen >= {mining.odds}::DOUBLE * (rate.bad / total) / (1 - rate.bad / total + {mining.odds}::DOUBLE * (rate.bad / total)) AND seen >= {mining.support}::DOUBLE * total),
  mined AS (SELECT DISTINCT page_id FROM every SEMI JOIN rules USING (s))
  SELECT page_id, host, path, CASE {named} END AS rule, coalesce(CASE {verdict} END, CASE WHEN page_id IN (SELECT page_id FROM mined) THEN 'block' END, 'allow') AS verdict FROM u"""


ORACLE_SQL = {
    "op3_quality_rules": _quality_sql(QualityRules()),
    "op8_url_rules": _url_sql(Mining()),
    "op10_jaccard_join": _jaccard_sql(3, 90),
}
