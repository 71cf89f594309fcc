"""The results of operators in DuckDB SQL, where SQL can state them."""

from __future__ import annotations

SPACED = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"

SUBSTRING = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text,''),'{SPACED}') AS w FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(list_slice(w,i,i+49),' ') AS k FROM (SELECT rid, doc_id, w, unnest(range(1,len(w)-48)) AS i FROM d)),
first AS (SELECT k, min(doc_id) AS first FROM win GROUP BY 1),
gone AS (SELECT DISTINCT rid, unnest(range(i,i+50)) AS p FROM win JOIN first USING (k) WHERE first < doc_id),
words AS (SELECT rid, unnest(w) AS x, unnest(range(1,len(w)+1)) AS p FROM d),
kept AS (SELECT rid, string_agg(x,' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (rid,p) GROUP BY 1),
cut AS (SELECT rid, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n,0) AS n_removed, sha256(coalesce(t,'')) AS kept_sha256 FROM d LEFT JOIN cut USING (rid) LEFT JOIN kept USING (rid)"""

NEAR = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER},'{SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT rid, CASE WHEN len(w)<5 THEN array_to_string(w,' ') ELSE array_to_string(list_slice(w,i,i+4),' ') END AS g FROM (SELECT rid, w, unnest(range(1,greatest(2,len(w)-3))) AS i FROM d WHERE len(w)>0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS shared FROM s a JOIN s b USING (g) WHERE a.rid<b.rid GROUP BY 1,2),
e AS (SELECT a, b FROM p JOIN n x ON x.rid=a JOIN n y ON y.rid=b WHERE 100*shared>=75*(x.n+y.n-shared)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b=l.a),
c AS (SELECT r.a AS rid, min(doc_id) AS component_id FROM r JOIN d ON d.rid=r.b GROUP BY 1)
SELECT doc_id, coalesce(n,0) AS n_shingles, component_id, doc_id=component_id AS kept FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)"""

LEAKS = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER},'{PLAIN}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER},'{PLAIN}') AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, least(10,len(w)) AS n, array_to_string(list_slice(w,i,i+9),' ') AS k FROM (SELECT item, w, unnest(range(1,greatest(2,len(w)-8))) AS i FROM b WHERE len(w)>0)),
dw AS (SELECT rid, n, i, array_to_string(list_slice(w,i,i+n-1),' ') AS k FROM (SELECT rid, w, n, unnest(range(1,len(w)-n+2)) AS i FROM d, (SELECT DISTINCT n FROM iw))),
h AS (SELECT rid, n, i, item FROM dw JOIN iw USING (n,k)),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i,i+n)) AS p FROM h) GROUP BY 1),
t AS (SELECT rid, count(*) AS n_items, string_agg(item,',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit,0) AS n_hit, coalesce(n_items,0) AS n_items, sha256(coalesce(items,'')) AS items_sha256, coalesce(n_hit,0)>0 AS contaminated FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)"""
