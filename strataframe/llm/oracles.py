"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()


def _words(column: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS e FROM documents),
w AS (SELECT doc_id, p, e[p:p + 49] AS s FROM (SELECT doc_id, e, unnest(range(1, octet_length(e) - 48)) AS p FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(*) > 1),
hit AS (SELECT w.doc_id, w.p FROM w JOIN f ON w.s = f.s AND f.first < w.doc_id),
r AS (SELECT *, p > coalesce(max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -99) + 50 AS opens FROM hit),
g AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM r),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY ALL),
kept AS (SELECT s.doc_id, s.run, hex(e[coalesce(lag(s.b) OVER (PARTITION BY s.doc_id ORDER BY run), 1):s.a - 1]) AS x,
  CASE WHEN lead(s.a) OVER (PARTITION BY s.doc_id ORDER BY run) IS NULL THEN hex(e[s.b:]) ELSE '' END AS last, s.b - s.a AS n
  FROM spans s JOIN d ON s.doc_id = d.doc_id),
k AS (SELECT doc_id, sum(n) AS removed, count(*) AS spans, string_agg(x || last, '' ORDER BY run) AS kept FROM kept GROUP BY doc_id)
SELECT d.doc_id, octet_length(e) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(coalesce(unhex(kept), e)) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_words("text")} AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS size FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, size, array_to_string(w[j:j + size - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS j FROM s)),
dw AS (SELECT doc_id, size, j, array_to_string(w[j:j + size - 1], ' ') AS x
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS j FROM d, (SELECT DISTINCT size FROM s))),
hit AS (SELECT doc_id, dw.size, j, item_id FROM dw JOIN iw ON dw.size = iw.size AND dw.x = iw.x),
n AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(j, j + size)) AS p FROM hit) GROUP BY 1),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN g ON d.doc_id = g.doc_id
"""

SUBSTRING_INDEX = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
x AS (SELECT doc_id, p, array_to_string(w[p:p + 34], ' ') AS s FROM b WHERE p + 34 <= len(w)),
f AS (SELECT s FROM x GROUP BY s HAVING count(*) > 1),
hit AS (SELECT x.doc_id, x.p FROM x JOIN f ON x.s = f.s),
m AS (SELECT b.doc_id, b.p, b.w[b.p] AS word,
  max(CASE WHEN hit.p IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY b.doc_id ORDER BY b.p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM b LEFT JOIN hit ON b.doc_id = hit.doc_id AND b.p = hit.p),
k AS (SELECT doc_id, sum(gone) AS removed, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
