"""DuckDB SQL for the joins, by definition: all pairs that share something, and what links reach."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_REACH = """
either_way AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, root) AS (SELECT a, a FROM either_way UNION SELECT w.b, reach.root FROM reach JOIN either_way w ON w.a = reach.id),
least AS (SELECT id, min(root) AS component FROM reach GROUP BY id)"""


def jaccard_join_sql(table: str = "documents", width: int = 5, percent: int = 75) -> str:
    return rf"""
WITH RECURSIVE texts AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {table}),
sets AS (SELECT doc_id, CASE WHEN len(w) >= {width} THEN list_distinct(list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM texts),
each AS (SELECT doc_id, unnest(s) AS x FROM sets),
common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM each p JOIN each q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * n >= {percent} * (len(p.s) + len(q.s) - n)),{_REACH}
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id FROM sets LEFT JOIN least ON id = doc_id"""


def embedding_dedup_sql(table: str = "embeddings", cosine: float = 0.9) -> str:
    return f"""
WITH RECURSIVE every AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM {table}),
v AS (SELECT r, vec_id, CASE WHEN list_max(list_transform(e, lambda x: abs(x))) > 0 THEN list_transform(e, lambda x: x / list_max(list_transform(e, lambda y: abs(y)))) ELSE e END AS e FROM every WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT r, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
links AS (SELECT p.r AS a, q.r AS b FROM u p JOIN u q ON p.r < q.r AND len(p.e) = len(q.e) AND p.norm > 0 AND q.norm > 0 WHERE list_sum(list_transform(list_zip(p.e, q.e), lambda x: x[1] * x[2])) / (p.norm * q.norm) >= {cosine}::DOUBLE),{_REACH},
degree AS (SELECT a, count(*) AS n FROM either_way GROUP BY a),
lowest AS (SELECT l.component, min(vec_id) AS component_id FROM least l JOIN u ON u.r = l.id GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM every LEFT JOIN degree ON a = r LEFT JOIN least ON id = r LEFT JOIN lowest USING (component)"""
