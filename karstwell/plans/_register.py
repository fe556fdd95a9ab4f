"""Registration of queries with the SQL they equal."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict = {}

#: The adapter views of ``karstwell.sources.tables`` in SQL.
VIEWS = r"""
files AS (
  SELECT doc_id AS file_id, source || '/' || lang || '/doc_' || doc_id || '.txt' AS path, lang AS language, n_chars AS size, md5(text) AS content_hash, text
  FROM documents),
file_lines AS (SELECT file_id, path, language, string_split(text, chr(10)) AS ls FROM files),
chunks AS (
  SELECT file_id * 16777216 + i AS chunk_id, file_id, CAST(i AS INTEGER) AS start_line, CAST(i AS INTEGER) AS end_line, ls[i] AS code,
    CASE WHEN i = 1 THEN 'namespace' WHEN length(ls[i]) > 200 THEN 'function' WHEN length(ls[i]) > 80 THEN 'block' ELSE 'comment' END AS chunk_type,
    regexp_extract(ls[i], '^\s*(\S+)', 1) AS symbol, path, language
  FROM file_lines, unnest(range(1, len(ls) + 1)) AS t(i) WHERE regexp_matches(ls[i], '\S')),
embs AS (
  SELECT vec_id AS chunk_id, 'fake' AS provider, 'model_' || label AS model, CAST(embedding AS DOUBLE[]) AS embedding, CAST(len(embedding) AS INTEGER) AS dims
  FROM embeddings),
mutations AS (SELECT event_id AS seq, 'u' || user_id AS path, event_type, CAST(ts AS TIMESTAMP) AS ts FROM events)
"""


def query(name: str, sql: str | None = None, *, views: bool = True):
    """Registers a function of (spark, folder). ``sql`` is a SELECT over VIEWS, or, if it starts with a comma, further
    views and the SELECT; with ``views=False`` it stands alone."""

    def add(f):
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql if not views else "WITH RECURSIVE" + VIEWS.rstrip() + "\n" + sql
        return f

    return add
