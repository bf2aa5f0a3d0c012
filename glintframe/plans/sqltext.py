"""Pieces of SQL that several checks share."""

DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"


def dot(a: str, b: str) -> str:
    return DOT.format(a=a, b=b)


#: Every row whose id is divisible by 100 as a query, scored against all rows.
SCORED = f"""
scored AS (
  SELECT q.vec_id AS query_id, q.label AS query_label, e.vec_id::VARCHAR AS key, e.label, round({dot('q.embedding', 'e.embedding')}, 9) AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key)::INTEGER AS rank FROM scored
)"""

#: The same queries less half of the next row's vector, the raw negative's threshold applied.
COMPOSED = f"""
composed AS (
  SELECT q.vec_id AS query_id, q.label AS query_label, n.embedding AS negative,
         list_transform(list_zip(q.embedding, n.embedding), lambda x: x[1]::DOUBLE - 0.5 * x[2]::DOUBLE) AS raw
  FROM embeddings q JOIN embeddings n ON n.vec_id = q.vec_id + 1 WHERE q.vec_id % 100 = 0
), unit AS (
  SELECT query_id, query_label, negative, list_transform(raw, lambda x: x / sqrt({dot('raw', 'raw')})) AS v FROM composed
)"""
