"""DuckDB SQL for the queries of this package that SQL can express."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(table: str, key: str) -> str:
    """One row per row and distinct shingle of five words."""
    words = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+')"
    return f"""
        SELECT DISTINCT {key}, unnest(CASE
            WHEN len(w) = 0 THEN []::VARCHAR[]
            WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
        END) AS s
        FROM (SELECT {key}, {words} AS w FROM {table} WHERE text IS NOT NULL)"""


ORACLE = {
    "op8_decontaminate": f"""
        WITH d AS ({_shingles('documents', 'doc_id')}),
             b AS ({_shingles('benchmark', 'item_id')}),
             n AS (SELECT item_id, count(*) AS shingles FROM b GROUP BY item_id)
        SELECT doc_id, item_id, count(*)::INTEGER AS shared, any_value(shingles)::INTEGER AS shingles,
               count(*)::DOUBLE / any_value(shingles) AS containment
        FROM d JOIN b USING (s) JOIN n USING (item_id)
        GROUP BY doc_id, item_id
        HAVING count(*) >= 0.8 * any_value(shingles) - 1e-9""",
    "op10_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
                   FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id,
                          list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
                   FROM v q JOIN v c ON q.vec_id <> c.vec_id
                   WHERE q.vec_id % 50 = 0),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
                   FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
