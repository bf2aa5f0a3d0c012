"""Queries over the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import abuse, clusters, formatting, mixing, neighbours, tokens, topn, varied
from .vectors import with_dimensions


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of index_entry (side 0) and search_response (side 1)."""
    header = table(spark, sf_dir, "index_header")
    entries = with_dimensions(table(spark, sf_dir, "index_entry"), header, side=0)
    return entries.unionByName(with_dimensions(table(spark, sf_dir, "search_response"), header, side=1))


def _asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_dimensions(table(spark, sf_dir, "search_response"), table(spark, sf_dir, "index_header"))


def _with_query(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Rows with the query that their response's vector was made of."""
    asked = table(spark, sf_dir, "search_request").groupBy("generation").agg(F.min("query").alias("query"))
    own = rows.join(table(spark, sf_dir, "search_response").select("vec_id", "generation"), "vec_id")
    return own.join(asked, "generation", "left").drop("generation")


def p1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable query vector with its query and the one of the 200 picks of its index that stands for it; a pick stands for itself."""
    found = varied.represented(_asked_vectors(spark, sf_dir), k=200).withColumn("similarity", F.round("similarity", 5))
    return _with_query(spark, sf_dir, found).select("index_name", "vec_id", "query", "pick", "pick_vec_id", "similarity")


def p1_varied_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every index 200 query vectors that cover what was asked, in the order they were picked, with their query."""
    picks = varied.varied_subset(_asked_vectors(spark, sf_dir), k=200)
    return _with_query(spark, sf_dir, picks).select("index_name", "pick", "vec_id", "query")


def p1_varied_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a twentieth of every index's query vectors."""
    picks = varied.varied_subset(_asked_vectors(spark, sf_dir), share=0.05)
    return _with_query(spark, sf_dir, picks).select("index_name", "pick", "vec_id", "query")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest_vectors(_vectors(spark, sf_dir), k=5, min_similarity=0.90)
    return found.select(F.col("query_id").alias("response_vec_id"), F.col("vec_id").alias("entry_vec_id"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.linked_groups(_vectors(spark, sf_dir), min_similarity=0.90, min_size=3)


def p3_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaf of an index with its size and its three most typical members."""
    described = clusters.describe_leaves(clusters.leaf_members(_vectors(spark, sf_dir)), typical=3)
    keys = table(spark, sf_dir, "index_entry").select("vec_id", "key")
    return described.join(keys, "vec_id", "left")


def p3_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaf of every usable vector."""
    return clusters.leaf_members(_vectors(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "search_request")
    return formatting.copies(requests, "query", "request_id").select(F.col("first").alias("first_request_id"), "request_id")


def p5_distinct_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each distinct query, with the number of its copies."""
    classes, _ = formatting.collapse(table(spark, sf_dir, "search_request"), "query", "request_id")
    return classes.select(F.col("first").alias("first_request_id"), "copies")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_n_per_group(
        table(spark, sf_dir, "search_match"), table(spark, sf_dir, "search_request"), group="generation", item="key", score="score", rank="rank", ident="match_id", n="top_k"
    )


_FORMS_SQL = r"""
WITH raw AS (
  SELECT query, count(*) AS n, min(request_id) AS id FROM search_request WHERE query IS NOT NULL AND request_id IS NOT NULL GROUP BY query
), form AS (
  SELECT query, n, id, CASE WHEN regexp_matches(query, '[:=]')
    THEN 'F' || array_to_string(list_sort(list_filter(list_transform(
           regexp_split_to_array(query, '[;|,&\n\r\x0B\x0C\x{85}\x{2028}\x{2029}]'),
           lambda p: replace(lower(regexp_replace(regexp_extract(p, '^[^:=]*'), '[^\p{L}\p{N}]+', '', 'g')), 'ς', 'σ') || chr(1)
                  || replace(lower(regexp_replace(regexp_replace(p, '^[^:=]*[:=]?', ''), '[^\p{L}\p{N}]+', '', 'g')), 'ς', 'σ')),
           lambda f: f <> chr(1))), chr(2))
    ELSE 'T' || replace(lower(regexp_replace(query, '[^\p{L}\p{N}]+', '', 'g')), 'ς', 'σ') END AS canonical
  FROM raw
), class AS (SELECT canonical, min(id) AS first, sum(n)::BIGINT AS copies FROM form WHERE length(canonical) > 1 GROUP BY canonical)
"""

_P6_SQL = """
WITH asked AS (SELECT generation, max(top_k) AS n FROM search_request WHERE top_k > 0 GROUP BY generation),
placed AS (
  SELECT m.match_id, m.generation, m.key, m.score + 0.0::FLOAT AS score, m.rank, a.n,
         row_number() OVER (PARTITION BY m.generation, m.key ORDER BY m.score + 0.0::FLOAT DESC, m.rank ASC NULLS LAST, m.match_id) AS own
  FROM search_match m JOIN asked a USING (generation) WHERE m.key IS NOT NULL AND m.match_id IS NOT NULL AND m.score IS NOT NULL AND NOT isnan(m.score)
), kept AS (
  SELECT match_id, n, row_number() OVER (PARTITION BY generation ORDER BY score DESC, rank ASC NULLS LAST, match_id) AS place FROM placed WHERE own = 1
)
SELECT match_id FROM kept WHERE place <= n
"""

_USABLE_SQL = """
WITH RECURSIVE h AS (SELECT index_name, max(dimensions) AS d FROM index_header WHERE index_name IS NOT NULL AND dimensions > 0 GROUP BY index_name),
every AS (
  SELECT 0 AS side, vec_id, index_name, embedding FROM index_entry UNION ALL SELECT 1, vec_id, index_name, embedding FROM search_response
), usable AS (
  SELECT side, vec_id, index_name, embedding::DOUBLE[] AS v FROM every JOIN h USING (index_name)
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = d AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
)"""
_P2_SQL = (
    _USABLE_SQL
    + """, pair AS (
  SELECT q.vec_id AS q, e.vec_id AS e, round(list_cosine_similarity(q.v, e.v), 12) AS s FROM usable q JOIN usable e ON q.index_name = e.index_name AND q.side = 1 AND e.side = 0
)
SELECT q AS response_vec_id, e AS entry_vec_id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, e) AS place FROM pair WHERE s >= 0.9) WHERE place <= 5"""
)
_P3_SQL = (
    _USABLE_SQL
    + """, link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.index_name = b.index_name AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), root AS (SELECT a, min(b) AS low FROM link GROUP BY a),
reach(vec_id, first) AS (
  SELECT a, a FROM root WHERE a < low
  UNION
  SELECT l.b, r.first FROM reach r JOIN link l ON l.a = r.vec_id
), own AS (SELECT vec_id, min(first) AS first FROM reach GROUP BY vec_id)
SELECT first AS first_vec_id, vec_id FROM (SELECT *, count(*) OVER (PARTITION BY first) AS n FROM own) WHERE n >= 3 AND vec_id <> first"""
)


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and how often each is taken."""
    mixed, _ = mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))
    return mixed


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    _, report = mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))
    return report


def _abuse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_label"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _abuse_scores(spark, sf_dir).filter("toxic").select("doc_id").distinct()


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document."""
    return _abuse_scores(spark, sf_dir).select("doc_id", "score")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of toxic documents of every source."""
    return abuse.rates(_abuse_scores(spark, sf_dir))


QUERIES = {
    "p1_members": p1_members,
    "p1_varied_queries": p1_varied_queries,
    "p1_varied_share": p1_varied_share,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_leaves": p3_leaves,
    "p3_members": p3_members,
    "p5_found": p5_found,
    "p5_distinct_queries": p5_distinct_queries,
    "p6_found": p6_found,
    "p7_ids": p7_ids,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
    "p9_rates": p9_rates,
}
SQL = {
    "p2_found": _P2_SQL,
    "p3_found": _P3_SQL,
    "p5_found": _FORMS_SQL
    + "SELECT c.first AS first_request_id, r.request_id FROM search_request r JOIN form f ON f.query = r.query JOIN class c USING (canonical) WHERE r.request_id <> c.first",
    "p5_distinct_queries": _FORMS_SQL + "SELECT first AS first_request_id, copies FROM class",
    "p6_found": _P6_SQL,
}
