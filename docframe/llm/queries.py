"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .ann import op5_ann
from .licenses import op8_licenses
from .licenses import oracle as licenses_sql
from .line_dedup import op6_line_dedup, op6_line_dedup_bounds
from .mixing import op2_mixing
from .near_dedup import op10_near_dedup
from .packing import op4_packing
from .secrets import op3_secrets
from .topk import op9_topk
from .toxicity import op1_toxicity
from .warc import op7_warc

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_mixing, op3_secrets, op4_packing, op5_ann, op6_line_dedup, op6_line_dedup_bounds, op7_warc, op8_licenses, op9_topk, op10_near_dedup)}

#: WARC: the fixed columns of a capture; url_key and stamp are plain functions of the page.
WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
c AS (SELECT page_id, url, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest,
  min(page_id) OVER (PARTITION BY sha256(html)) AS first_id FROM p),
k AS (SELECT *, regexp_replace(regexp_replace(lower(url), '^[a-z][a-z0-9+.-]*://', ''), '#.*$', '') AS bare FROM c),
h AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?]*'), '^[^@]*@|:\d+$', '', 'g'), '^www\d*\.', '') AS host, regexp_replace(bare, '^[^/?]*', '') AS rest FROM k)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to,
  CASE WHEN host = '' THEN rest ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END END AS url_key,
  '1970-01-01T00:00:00Z' AS stamp FROM h"""

#: Secrets: RE2 has no match offsets, so each kind is marked, split and summed, as in the operator.
def secrets_sql() -> str:
    from .secrets import BASE_RULES, MORE_RULES

    parts, names = [], []
    for rank, (kind, pattern, group, least) in enumerate((*BASE_RULES, *MORE_RULES)):
        # 0x01 marks matches; RE2 knows no $0, so the whole match is a group of its own
        quoted = ("(" + pattern + ")").replace("'", "''")
        value = f"length(regexp_extract(p, '{quoted}', {group + 1}))" if group else "length(p)"
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, start, start + length(p) AS stop FROM (
  SELECT doc_id, p, i, coalesce(sum(length(p)) OVER (PARTITION BY doc_id, n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (
    SELECT doc_id, n, unnest(m) AS p, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT doc_id, n, string_split(regexp_replace(replace(text, chr(1), chr(2)), '{quoted}', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS m FROM d)))
  WHERE i % 2 = 0 AND {value} >= {least}""".replace("\\\\1", "\\1"))
        names.append(kind)
    own = " UNION ALL ".join(parts)
    joined = lambda cond: f"coalesce(string_agg(CASE WHEN {cond} THEN kind || ':' || start || ':' || stop END, ',' ORDER BY start, rank), '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}')::BIGINT AS n_{k}" for k in names[:3])
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS text FROM documents), s AS ({own})
SELECT d.doc_id, {counts}, sha256({joined('rank < 3')}) AS base_sha256, {joined('true')} AS spans
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, d.n"""


#: Exact search: all queries against all rows.
TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER w AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5"""

#: Line dedup: deletion variants as text, joined by equality.
LINES_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
o AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS no FROM d),
f AS (SELECT line, min((doc_id, no)) AS first FROM o WHERE length(line) >= 20 GROUP BY line),
v AS (SELECT line, first, i, md5(substr(line, 1, i - 1) || substr(line, i + 1)) AS key FROM (SELECT line, first, unnest(range(1, length(line) + 1)) AS i FROM f)),
near AS (
  SELECT a.line FROM v a JOIN v b ON a.key = b.key AND a.i = b.i AND b.first < a.first
  UNION SELECT a.line FROM v a JOIN f b ON a.key = md5(b.line) AND b.first < a.first
  UNION SELECT b.line FROM v a JOIN f b ON a.key = md5(b.line) AND a.first < b.first),
k AS (SELECT o.doc_id, o.no, o.line, (length(o.line) < 20 OR (f.first = (o.doc_id, o.no) AND o.line NOT IN (SELECT line FROM near))) AS kept FROM o LEFT JOIN f USING (line))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (NOT kept)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (kept), '')) AS text_sha256 FROM k GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op3_secrets": secrets_sql(), "op6_line_dedup": LINES_SQL, "op7_warc": WARC_SQL, "op8_licenses": licenses_sql(), "op9_topk": TOPK_SQL}
