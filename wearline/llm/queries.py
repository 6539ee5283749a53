"""The registered queries of this subpackage and, where SQL can say it, their oracle."""

from __future__ import annotations

from .class_lm import op8_class_lm
from .html_text import op7_html_text
from .jaccard import op10_jaccard_join
from .mixture import op2_mix_sources
from .pieces import op6_sentencepiece
from .quality import op5_quality_rules
from .token_file import op9_token_files
from .topk import op1_exact_top_k
from .url_filter import op3_url_filter
from .warc import op4_warc


def queries() -> dict:
    return {
        "op1_exact_top_k": op1_exact_top_k,
        "op2_mix_sources": op2_mix_sources,
        "op3_url_filter": op3_url_filter,
        "op4_warc": op4_warc,
        "op5_quality_rules": op5_quality_rules,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_html_text": op7_html_text,
        "op8_class_lm": op8_class_lm,
        "op9_token_files": op9_token_files,
        "op10_jaccard_join": op10_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_top_k": TOP_K, "op3_url_filter": URL_FILTER, "op4_warc": WARC}


_HOST = "translate(coalesce(regexp_extract({0}, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "coalesce(regexp_extract({0}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"
_NODE = (
    "CASE WHEN instr({0}, '://') > 0 THEN translate(regexp_extract({0}, '^([^#]*?)://', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '://' || "
    + _HOST.format("regexp_extract({0}, '^([^#]*)', 1, 's')")
    + " || regexp_extract(regexp_extract({0}, '^([^#]*)', 1, 's'), '^.*?://[^/?#]*(.*)$', 1, 's') END"
)
_RULED = """
rules(verdict, rhost, rpath) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/'))
"""

URL_FILTER = f"""
WITH RECURSIVE {_RULED},
p AS (SELECT page_id, url, html, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path, {_NODE.format('url')} AS node FROM pages),
tags AS (
  SELECT url, regexp_extract(html, '<link\\b[^>]*?\\brel\\s*=\\s*["'']?canonical\\b[^>]*>', 0, 'is') AS c,
         regexp_extract(html, '<meta\\b[^>]*?\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>', 0, 'is') AS r FROM pages),
targets AS (
  SELECT url, regexp_extract(c, '\\bhref\\s*=\\s*["'']?\\s*([^\\s>"'']*)', 1, 'is') AS t FROM tags
  UNION ALL SELECT url, regexp_extract(r, '\\burl\\s*=\\s*["'']?([^''"\\s>]+)', 1, 'is') FROM tags),
whole AS (
  SELECT url, CASE WHEN instr(t, '://') > 0 THEN replace(t, '&amp;', '&')
    WHEN starts_with(t, '//') THEN regexp_extract(url, '^(.*?:)//', 1, 's') || replace(t, '&amp;', '&')
    WHEN starts_with(t, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || replace(t, '&amp;', '&') END AS t
  FROM targets WHERE t <> ''),
e0 AS (SELECT {_NODE.format('url')} AS a, {_NODE.format('t')} AS b FROM whole),
e AS (SELECT a, b FROM e0 WHERE a <> b UNION SELECT b, a FROM e0 WHERE a <> b),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
fits AS (
  SELECT n.node, r.verdict, r.rhost || r.rpath AS rule, row_number() OVER (PARTITION BY n.node ORDER BY length(r.rhost || r.rpath) DESC) AS k
  FROM (SELECT node FROM p UNION SELECT b FROM e) n JOIN rules r
    ON ({_HOST.format('n.node')} = r.rhost OR ends_with({_HOST.format('n.node')}, '.' || r.rhost)) AND starts_with({_PATH.format('n.node')}, r.rpath)),
spread AS (
  SELECT reach.a AS node FROM reach JOIN fits ON fits.node = reach.b AND fits.k = 1
  GROUP BY 1 HAVING bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow')),
ruled AS (
  SELECT p.page_id, p.node, p.host, p.path, r.rhost || r.rpath AS rule, r.verdict
  FROM p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
  QUALIFY row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) = 1)
SELECT page_id, host, path, rule,
  CASE WHEN rule IS NOT NULL THEN verdict WHEN spread.node IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NOT NULL THEN 'rule' WHEN spread.node IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by
FROM ruled LEFT JOIN spread ON spread.node = ruled.node
"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN firsts USING (digest)
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
