"""Queries over indexes, catalogs, requests and responses, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tags as T
from ..functions import templates
from ..functions.views import expand_views, view_size
from ..operators import build as B
from ..operators import evaluate as E
from ..operators import requests as R
from ..operators.snapshots import number_states
from ..sources.tables import table


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.index_statistics(table(spark, sf_dir, "index_entry"), ("index_name",))
    return found.withColumns({c: F.round(c, 6) for c in ("min_norm", "median_norm", "max_norm")})


def index_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared against actual entries of every index: presence, counts and rows of a wrong width."""
    header = table(spark, sf_dir, "index_header").select("index_name", "dimensions", "model", F.col("count").alias("declared"))
    sizes = table(spark, sf_dir, "index_entry").filter("index_name is not null").select("index_name", F.size("embedding").alias("width")).groupBy("index_name", "width").count()
    wide = sizes.join(header.select("index_name", "dimensions"), "index_name", "left").groupBy("index_name").agg(
        F.sum("count").alias("rows"), F.sum(F.when(F.coalesce(F.col("width") == F.col("dimensions"), F.lit(False)), 0).otherwise(F.col("count"))).alias("odd_rows")
    )
    found = B.presence(header, wide, "index_name")
    return found.select("index_name", "state", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("odd_rows", F.lit(0)).alias("odd_rows"), (F.col("declared") == F.coalesce("rows", F.lit(0))).alias("count_holds"))


def fingerprint_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fingerprint_map(table(spark, sf_dir, "index_entry").filter("key is not null"), ("index_name",))


def first_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry that a point lookup of each key finds: the first by position."""
    e = table(spark, sf_dir, "index_entry").filter("key is not null")
    return e.groupBy("index_name", "key").agg(F.min(F.struct("position", "vec_id")).alias("f"), F.count(F.lit(1)).alias("entries")).select("index_name", "key", "f.position", "f.vec_id", "entries")


def catalog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.catalog_entries(table(spark, sf_dir, "build_request")).select("build_id", "position", "key", "path", "fingerprint", "view")


def incremental_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every build could reuse of the stored vectors, each stored one once."""
    catalog = B.catalog_entries(table(spark, sf_dir, "build_request").select("build_id", "entries"))
    cached = table(spark, sf_dir, "index_entry").filter("embedding is not null").select("key", "fingerprint", "position", "vec_id")
    return B.plan_counts(B.plan_reuse(catalog, cached.withColumn("position", F.struct("position", "vec_id")), ("build_id",), "vec_id"), ("build_id",))


def incremental_build_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing reusing the one before it in its library, as a builder whose cache is the last build does."""
    build = ("library", "snapshot_no")
    rows = table(spark, sf_dir, "index_snapshot").filter("key is not null and fingerprint is not null").select(*build, "position", "key", "fingerprint")
    following = number_states(rows.select(*build).distinct()).filter("next_no is not null").select(*build, "next_no")
    before = rows.join(following, list(build)).select("library", F.col("next_no").alias("snapshot_no"), "key", "fingerprint", "position", F.lit(1).alias("vector"))
    return B.plan_counts(B.plan_reuse(rows, before, build, "vector", own=build), build)


def request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_error(table(spark, sf_dir, "search_request")).select("request_id", "error")


def request_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_defaults(table(spark, sf_dir, "search_request"), lower_case=True).select(
        "request_id", F.round(F.col("negative_weight").cast("double"), 6).alias("negative_weight"), "weight_is_number", "min_results", "embedding_only", "negative_query", "query"
    )


def latest_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_generation(table(spark, sf_dir, "search_request"))


def response_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.response_lists(table(spark, sf_dir, "search_match"))
    return found.select("generation", F.size("matches").cast("long").alias("n"), F.transform("matches", lambda m: m["key"]).alias("keys"))


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies of every index: both kinds of percentile, and the mean without the first response."""
    r = table(spark, sf_dir, "search_response").filter("query_ms is not null and not isnan(query_ms)")
    numbered = r.withColumn("n", F.row_number().over(Window.partitionBy("index_name").orderBy("vec_id")))
    found = numbered.groupBy("index_name").agg(
        F.avg("query_ms").alias("mean_ms"), F.median("query_ms").alias("median_ms"), E.percentile_nearest("query_ms", 0.95).alias("p95_nearest"),
        E.percentile_linear("query_ms", 0.95).alias("p95_linear"), F.avg(F.when(F.col("n") > 1, F.col("query_ms"))).alias("warm_ms"),
    )
    return found.select("index_name", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts carry each tag of their type, read as a comma-separated list."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.explode(T.parse_tags(F.replace("p_type", F.lit(" "), F.lit(" , ")))).alias("tag"))
    return p.groupBy("tag", T.query_text(F.col("tag")).alias("text")).agg(F.count(F.lit(1)).alias("parts"))


def tag_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts a query with required and forbidden tags accepts."""
    own = T.parse_tags(F.replace("p_type", F.lit(" "), F.lit(",")))
    all_, any_, none = F.array(F.lit("brass")), F.array(F.array(F.lit("large"), F.lit("small"), F.lit("economy"))), F.array(F.lit("plated"))
    return table(spark, sf_dir, "part").select("p_partkey", T.matches_required(own, all_, any_).alias("required"), T.has_forbidden(own, none).alias("forbidden"), T.is_positive(own, all_, any_, none).alias("positive"), T.default_kind(F.lit(None).cast("string"), none).alias("kind"))


def tag_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag queries: a generation's matches as results, in the order of their ranks and keys, the keys of its matches of even id as relevant."""
    m = table(spark, sf_dir, "search_match").filter("generation is not null and key is not null and rank is not null")
    own = m.groupBy(F.col("generation").alias("query"), "key").agg(F.min("rank").alias("rank"))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank", "key")))
    wanted = m.filter("match_id % 2 = 0").select(F.col("generation").alias("query"), "key").distinct()
    found = E.tag_metrics(ranked, wanted)
    return found.select("query", "relevant", *[F.round(c, 6).alias(c) for c in ("precision_at_1", "hit_at_5", "precision_at_5", "average_precision", "ndcg")])


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All anchors in a pool of 500; where these are more than 500, in a pool of five times their number."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"))
    anchors = docs.filter("key like '%00'")
    n = anchors.distinct().count()
    return B.deterministic_pool(docs, anchors, 500 if n <= 500 else 5 * n)


def sample_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents about a catalog key that an index holds, with the key's last entry in each such index."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("catalog_key").alias("key"))
    entries = table(spark, sf_dir, "index_entry").filter("index_name is not null").select("index_name", "key", F.struct("position", "vec_id").alias("position"), "vec_id")
    return B.sample_vectors(docs, entries, ("index_name",), "vec_id").select("doc_id", "key", "index_name", "vec_id")


def shared_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that only one library's catalogs hold."""
    e = B.catalog_entries(table(spark, sf_dir, "build_request").select("build_id", "library", "entries"))
    return B.unshared(e, "library", "path")


def leaked_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that occur both in embedding-only requests and in searches."""
    r = table(spark, sf_dir, "search_request").filter("query is not null")
    only = F.coalesce("embedding_only", F.lit(False))
    return r.filter(only).select("query").intersect(r.filter(~only).select("query"))


def prompt_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    words = {"subject": part.select(F.lower("p_brand").alias("subject")).distinct(), "setting": table(spark, sf_dir, "nation").select(F.lower("n_name").alias("setting")).distinct(), "style": table(spark, sf_dir, "region").select(F.lower("r_name").alias("style")).distinct()}
    return templates.expand(spark, ["{style} {subject} in {setting}", "a {subject}, {style}"], words)


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of pictures whose sizes come from the parts' numbers."""
    p = table(spark, sf_dir, "part").select(F.concat(F.when(F.col("p_partkey") % 3 == 0, "live:").otherwise("static:"), F.col("p_partkey")).alias("key"), (F.col("p_size") * 40 + 90).alias("width"), (F.col("p_partkey") % 7 * 100 + 90).cast("int").alias("height"))
    out = expand_views(p, 2.0)
    w, h = view_size(F.col("width"), F.col("height"), F.col("view"))
    return out.select("key", "view", w.cast("int").alias("view_width"), h.cast("int").alias("view_height"))


def key_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "index_entry").filter("key is not null").select("key").distinct().select("key", F.sha2(F.col("key").cast("binary"), 256).alias("digest"))


_ENTRY = "(SELECT build_id, library, unnest(entries) AS e, unnest(range(len(entries)))::INTEGER AS position FROM build_request WHERE entries IS NOT NULL)"
_BLANK = "({c} IS NULL OR NOT regexp_matches({c}, '[^\\s\\pZ\\x{{0B}}\\x{{85}}]'))"
_BAD = "({c} IS NOT NULL AND (isnan({c}) OR isinf({c}) OR {c} < 0))"


def _reuse_sql(catalog: str, cached: str, by: str, own: str = "") -> str:
    return f"""
WITH catalog AS ({catalog}), turned AS (SELECT *, row_number() OVER (PARTITION BY {by}, key, fingerprint ORDER BY position) AS turn FROM catalog),
cache AS (SELECT DISTINCT * FROM ({cached}))
SELECT {", ".join("t." + c.strip() for c in by.split(","))}, count(*) AS total, count(c.key) AS reused, count(*) - count(c.key) AS missing, count(DISTINCT t.key) AS keys
FROM turned t LEFT JOIN cache c ON t.key = c.key AND t.fingerprint = c.fingerprint AND t.turn = 1{own} GROUP BY {", ".join("t." + c.strip() for c in by.split(","))}"""


QUERIES = {
    f.__name__: f
    for f in (
        index_stats, index_check, fingerprint_map, first_entries, catalog_entries, incremental_build, incremental_build_snapshots, request_errors, request_settings,
        latest_generation, response_lists, latency_summary, tag_counts, tag_predicates, tag_metrics, pool, sample_entries, shared_paths, leaked_queries, prompt_grammar, views, key_digests,
    )
}
SQL = {
    "index_stats": """
        WITH n AS (SELECT *, CASE WHEN embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)), true)
            THEN coalesce(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 0) END AS norm FROM index_entry)
        SELECT index_name, count(*) AS records, count(DISTINCT key) AS unique_keys, round(min(norm), 6) AS min_norm, round(median(norm), 6) AS median_norm, round(max(norm), 6) AS max_norm,
            sum(12 + coalesce(strlen(key), 0) + 4 * coalesce(len(embedding), 0))::BIGINT AS bytes FROM n GROUP BY index_name""",
    "index_check": """
        WITH r AS (SELECT e.index_name, count(*) AS n, count(*) FILTER (WHERE len(e.embedding) IS DISTINCT FROM h.dimensions) AS odd FROM index_entry e LEFT JOIN index_header h USING (index_name) WHERE e.index_name IS NOT NULL GROUP BY e.index_name)
        SELECT coalesce(h.index_name, r.index_name) AS index_name, CASE WHEN h.index_name IS NULL THEN 'inactive' WHEN r.index_name IS NULL THEN 'missing' ELSE 'active' END AS state,
            coalesce(r.n, 0) AS rows, coalesce(r.odd, 0)::BIGINT AS odd_rows, h.count = coalesce(r.n, 0) AS count_holds FROM index_header h FULL JOIN r ON h.index_name = r.index_name""",
    "fingerprint_map": "SELECT index_name, key, arg_max(fingerprint, (position, fingerprint)) AS fingerprint FROM index_entry WHERE key IS NOT NULL GROUP BY index_name, key",
    "first_entries": "SELECT index_name, key, min((position, vec_id))[1] AS position, min((position, vec_id))[2] AS vec_id, count(*) AS entries FROM index_entry WHERE key IS NOT NULL GROUP BY index_name, key",
    "catalog_entries": f"SELECT build_id, position, e.key AS key, e.path AS path, e.fingerprint AS fingerprint, coalesce(e.view, 'full') AS view FROM {_ENTRY} WHERE e IS NOT NULL",
    "incremental_build": _reuse_sql(f"SELECT build_id, position, e.key AS key, e.fingerprint AS fingerprint FROM {_ENTRY} WHERE e IS NOT NULL", "SELECT key, fingerprint FROM index_entry WHERE embedding IS NOT NULL", "build_id"),
    "incremental_build_snapshots": _reuse_sql(
        "SELECT library, snapshot_no, position, key, fingerprint FROM index_snapshot WHERE key IS NOT NULL AND fingerprint IS NOT NULL",
        "SELECT s.library, n.next_no, s.key, s.fingerprint FROM index_snapshot s JOIN (SELECT library, snapshot_no, lead(snapshot_no) OVER (PARTITION BY library ORDER BY snapshot_no) AS next_no "
        "FROM (SELECT DISTINCT library, snapshot_no FROM index_snapshot WHERE library IS NOT NULL AND snapshot_no IS NOT NULL AND key IS NOT NULL AND fingerprint IS NOT NULL)) n "
        "ON s.library = n.library AND s.snapshot_no = n.snapshot_no WHERE s.key IS NOT NULL AND s.fingerprint IS NOT NULL AND n.next_no IS NOT NULL",
        "library, snapshot_no", " AND t.library = c.library AND t.snapshot_no = c.next_no"),
    "request_errors": f"""
        SELECT request_id, CASE WHEN {_BLANK.format(c='query')} THEN 'query must not be empty'
          WHEN coalesce(embedding_only, false) THEN NULL
          WHEN top_k IS NULL OR top_k <= 0 THEN 'top-k must be positive' WHEN {_BAD.format(c='negative_weight')} THEN 'invalid negative weight'
          WHEN {_BAD.format(c='score_window')} THEN 'invalid score window' WHEN {_BAD.format(c='min_score_prominence')} THEN 'invalid minimum score prominence'
          WHEN max_results <= 0 THEN 'invalid maximum result count' END AS error FROM search_request""",
    "request_settings": f"""
        SELECT request_id, CASE WHEN NOT coalesce(isnan(negative_weight), false) THEN round(coalesce(negative_weight, 0.5::FLOAT)::DOUBLE, 6) END AS negative_weight,
          NOT coalesce(isnan(negative_weight), false) AS weight_is_number, coalesce(min_results, 0) AS min_results, coalesce(embedding_only, false) AS embedding_only,
          CASE WHEN NOT {_BLANK.format(c='negative_query')} THEN lower(negative_query) END AS negative_query, lower(query) AS query FROM search_request""",
    "latest_generation": "SELECT client, max(generation) AS generation FROM search_request GROUP BY client",
    "response_lists": "SELECT generation, count(*) AS n, list(key ORDER BY rank, key, score) AS keys FROM search_match WHERE generation IS NOT NULL AND key IS NOT NULL AND rank IS NOT NULL GROUP BY generation",
    "latency_summary": """
        WITH r AS (SELECT index_name, query_ms, row_number() OVER (PARTITION BY index_name ORDER BY vec_id) AS n FROM search_response WHERE query_ms IS NOT NULL AND NOT isnan(query_ms))
        SELECT index_name, round(avg(query_ms), 6) AS mean_ms, round(median(query_ms), 6) AS median_ms, round(quantile_disc(query_ms, 0.95), 6) AS p95_nearest,
          round(quantile_cont(query_ms, 0.95), 6) AS p95_linear, round(avg(query_ms) FILTER (WHERE n > 1), 6) AS warm_ms FROM r GROUP BY index_name""",
    "tag_counts": "SELECT tag, replace(tag, '-', ' ') AS text, count(*) AS parts FROM (SELECT p_partkey, unnest(list_distinct(list_transform(string_split(p_type, ' '), lambda t: lower(trim(t))))) AS tag FROM part) WHERE tag <> '' GROUP BY tag",
    "tag_predicates": """
        SELECT p_partkey, required, forbidden, required AND NOT forbidden AS positive, 'negation' AS kind FROM (
          SELECT p_partkey, list_contains(t, 'brass') AND list_has_any(t, ['large', 'small', 'economy']) AS required, list_contains(t, 'plated') AS forbidden
          FROM (SELECT p_partkey, string_split(lower(p_type), ' ') AS t FROM part))""",
    "tag_metrics": """
        WITH m AS (SELECT * FROM search_match WHERE generation IS NOT NULL AND key IS NOT NULL AND rank IS NOT NULL), ranked AS (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY best, key) AS rank FROM (SELECT generation AS query, key, min(rank) AS best FROM m GROUP BY ALL)),
        wanted AS (SELECT DISTINCT generation AS query, key FROM m WHERE match_id % 2 = 0), n AS (SELECT query, count(*) AS relevant FROM wanted GROUP BY query),
        h AS (SELECT r.query, r.rank, (w.key IS NOT NULL)::INT AS hit, sum((w.key IS NOT NULL)::INT) OVER (PARTITION BY r.query ORDER BY r.rank) AS found FROM ranked r LEFT JOIN wanted w ON r.query = w.query AND r.key = w.key WHERE r.rank <= 10)
        SELECT h.query, coalesce(any_value(n.relevant), 0) AS relevant, round(max(CASE WHEN rank = 1 THEN hit END)::DOUBLE, 6) AS precision_at_1, round(max(CASE WHEN rank <= 5 THEN hit END)::DOUBLE, 6) AS hit_at_5,
          round(sum(CASE WHEN rank <= 5 THEN hit END) / 5, 6) AS precision_at_5,
          round(CASE WHEN any_value(n.relevant) > 0 THEN coalesce(sum(CASE WHEN hit = 1 THEN found / rank END), 0) / least(any_value(n.relevant), 10) END, 6) AS average_precision,
          round(CASE WHEN any_value(n.relevant) > 0 THEN coalesce(sum(CASE WHEN hit = 1 THEN 1 / log2(rank + 1) END), 0) / list_sum(list_transform(range(1, least(any_value(n.relevant), 10) + 1), lambda r: 1 / log2(r + 1))) ELSE 0 END, 6) AS ndcg
        FROM h LEFT JOIN n ON h.query = n.query GROUP BY h.query""",
    "pool": """
        WITH k AS (SELECT DISTINCT doc_id::VARCHAR AS key FROM documents), a AS (SELECT key FROM k WHERE key LIKE '%00')
        SELECT key, true AS is_anchor FROM a UNION ALL
        (SELECT key, false FROM k WHERE key NOT LIKE '%00' ORDER BY sha256(key), key LIMIT (SELECT CASE WHEN count(*) <= 500 THEN 500 - count(*) ELSE 4 * count(*) END FROM a))""",
    "sample_entries": """
        SELECT d.doc_id, d.catalog_key AS key, e.index_name, e.vec_id FROM documents d JOIN (
          SELECT index_name, key, arg_max(vec_id, (position, vec_id)) AS vec_id FROM index_entry WHERE index_name IS NOT NULL AND key IS NOT NULL GROUP BY index_name, key) e ON e.key = d.catalog_key""",
    "shared_paths": f"SELECT any_value(library) AS library, path FROM (SELECT DISTINCT library, e.path AS path FROM {_ENTRY} WHERE e.path IS NOT NULL) GROUP BY path HAVING count(*) = 1",
    "leaked_queries": "SELECT query FROM search_request WHERE query IS NOT NULL AND coalesce(embedding_only, false) INTERSECT SELECT query FROM search_request WHERE query IS NOT NULL AND NOT coalesce(embedding_only, false)",
    "prompt_grammar": """
        WITH s AS (SELECT DISTINCT lower(p_brand) AS subject FROM part), n AS (SELECT DISTINCT lower(n_name) AS setting FROM nation), r AS (SELECT DISTINCT lower(r_name) AS style FROM region)
        SELECT DISTINCT prompt FROM (SELECT style || ' ' || subject || ' in ' || setting AS prompt FROM s, n, r UNION ALL SELECT 'a ' || subject || ', ' || style FROM s, r)""",
    "views": """
        WITH p AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'live:' ELSE 'static:' END || p_partkey AS key, p_size * 40 + 90 AS width, p_partkey % 7 * 100 + 90 AS height FROM part),
        v AS (SELECT *, unnest(CASE WHEN key LIKE 'static:%' AND width / height >= 2 THEN ['full', 'center', 'leftThird', 'rightThird'] ELSE ['full', 'center'] END) AS view FROM p)
        SELECT key, view, (CASE WHEN view = 'center' THEN least(width, height) WHEN view = 'full' THEN width ELSE greatest(1, width // 3) END)::INTEGER AS view_width,
          (CASE WHEN view = 'center' THEN least(width, height) ELSE height END)::INTEGER AS view_height FROM v""",
    "key_digests": "SELECT DISTINCT key, sha256(key) AS digest FROM index_entry WHERE key IS NOT NULL",
}
