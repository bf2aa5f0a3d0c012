"""Queries over fitting, fingerprints, tokens, patch grids and served requests.

Those without SQL need Python: they are checked by unit tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..functions.encoders import hashing_factory
from ..functions.vectors import norm
from ..functions.views import expand_views, patch_grid_column, view_size
from ..operators import build as B
from ..operators import distill
from ..operators import evaluate as E
from ..operators.durable import shared_folder
from ..sources.index_file import export_parts, read_index, validate
from ..sources.tables import table
from ..streaming.serve import responses

DIMENSIONS = 64


def patch_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct patch grids of all views of pictures whose sizes come from the parts' numbers, and how many views have each."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("static:"), F.col("p_partkey")).alias("key"), (F.col("p_size") * 40 + 90).alias("width"), (F.col("p_partkey") % 7 * 100 + 90).cast("int").alias("height"))
    w, h = view_size(F.col("width"), F.col("height"), F.col("view"))
    sizes = expand_views(p, 2.0).groupBy(w.cast("int").alias("w"), h.cast("int").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    grids = sizes.select("n", patch_grid_column(F.col("h"), F.col("w"), 16, 256).alias("g"))
    return grids.groupBy(F.col("g.rows").alias("rows"), F.col("g.columns").alias("columns")).agg(F.sum("n").alias("views"))


def catalog_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every build's entries in their order."""
    return hashing.catalog_fingerprints(B.catalog_entries(table(spark, sf_dir, "build_request").select("build_id", "entries")), "build_id")


def cache_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index file name of every model for full and for several views."""
    models = table(spark, sf_dir, "index_header").filter("model is not null").select("model").distinct()
    return models.select("model", F.explode(F.array(F.lit("full"), F.lit("multiview"))).alias("profile")).withColumn("name", hashing.cache_name_column(F.col("model"), F.col("profile")))


def token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lengths of every query as ids, framed to 16 places; a stand-in for a tokenizer's ids."""
    ids = F.transform(F.split("query", " "), lambda w: F.length(w).cast("long"))
    full, mask = text.frame_ids(ids, 16, 999)
    return table(spark, sf_dir, "search_request").filter("query is not null").select("request_id", full.alias("ids"), F.aggregate(mask, F.lit(0).cast("long"), lambda s, x: s + x).alias("used"))


def distilled_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear map from the left to the right half of the vectors, fitted on four of five rows: cosines on the rest."""
    pairs = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("source"), F.slice("embedding", 33, 32).alias("target"))
    weights = distill.ridge(pairs.filter("vec_id % 5 <> 0"), 1e-3)
    from ..functions.vectors import dot, normalise

    held = distill.predict(pairs.filter("vec_id % 5 = 0"), weights)
    cosine = held.select(dot(normalise(F.col("predicted"), "floor"), normalise(F.col("target"), "floor")).alias("cosine"))
    return cosine.agg(F.avg("cosine").alias("cosine_mean"), E.percentile_linear("cosine", 0.05).alias("cosine_p05"), F.min("cosine").alias("cosine_minimum"), F.count(F.lit(1)).alias("pairs"))


def index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings written as a folder of index files, and what the files' reader and their headers say of them."""
    rows = table(spark, sf_dir, "embeddings").filter(F.size("embedding") == DIMENSIONS)
    keyed = rows.select(F.col("vec_id").alias("position"), F.col("vec_id").cast("string").alias("key"), (F.col("vec_id") * 7).cast("decimal(20,0)").alias("fingerprint"), "embedding")
    folder = shared_folder(spark)
    parts = export_parts(keyed.repartition(3, "key"), folder, "vectors@1", 19, DIMENSIONS)
    for path, n in parts:
        if validate(path).count != n:
            raise ValueError(f"{path} is damaged")
    read, slim = read_index(spark, folder), read_index(spark, folder, vectors=False)
    norms = read.select("key", F.round(norm(F.col("embedding")), 5).alias("norm"), F.size("embedding").alias("width"))
    return norms.join(slim.select("key", "fingerprint"), "key")


def served_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response lines of the requests whose id is divisible by 100, by the hashing encoder against all entries of that width."""
    asked = table(spark, sf_dir, "search_request").filter("request_id % 100 = 0")
    index = table(spark, sf_dir, "index_entry").filter(F.size("embedding") == DIMENSIONS)
    return responses(asked, index, hashing_factory(DIMENSIONS)).select("value")


QUERIES = {f.__name__: f for f in (patch_shapes, catalog_fingerprints, cache_names, token_frames, index_files, distilled_fidelity, served_requests)}
SQL = {
    "patch_shapes": """
        WITH RECURSIVE p AS (SELECT p_size * 40 + 90 AS width, p_partkey % 7 * 100 + 90 AS height FROM part),
        v AS (SELECT *, unnest(CASE WHEN width / height >= 2 THEN ['full', 'center', 'leftThird', 'rightThird'] ELSE ['full', 'center'] END) AS view FROM p),
        s AS (SELECT CASE WHEN view = 'center' THEN least(width, height) WHEN view = 'full' THEN width ELSE greatest(1, width // 3) END AS w,
                     CASE WHEN view = 'center' THEN least(width, height) ELSE height END AS h, count(*) AS n FROM v GROUP BY ALL),
        b(w, h, n, lo, hi) AS (
          SELECT w, h, n, 1e-6::DOUBLE, 100::DOUBLE FROM s
          UNION ALL
          SELECT w, h, n, CASE WHEN fits THEN (lo + hi) / 2 ELSE lo END, CASE WHEN fits THEN hi ELSE (lo + hi) / 2 END
          FROM (SELECT *, greatest(1, ceil(h * ((lo + hi) / 2) / 16)) * greatest(1, ceil(w * ((lo + hi) / 2) / 16)) <= 256 AS fits FROM b WHERE hi - lo >= 1e-5)),
        e AS (SELECT * FROM b WHERE hi - lo < 1e-5)
        SELECT greatest(1, ceil(h * lo / 16))::BIGINT AS rows, greatest(1, ceil(w * lo / 16))::BIGINT AS columns, sum(n)::BIGINT AS views FROM e GROUP BY ALL""",
    "index_files": """
        SELECT vec_id::VARCHAR AS key, (vec_id * 7)::DECIMAL(20,0) AS fingerprint, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, len(embedding)::INTEGER AS width
        FROM embeddings WHERE len(embedding) = 64""",
    "cache_names": """
        WITH p AS (SELECT DISTINCT model, unnest(['full', 'multiview']) AS profile FROM index_header WHERE model IS NOT NULL),
        b AS (SELECT *, hex(encode(model)) || 'FF' || hex(encode(profile)) AS bytes FROM p),
        f AS (SELECT *, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(len(bytes) // 2),
            lambda i: (16 * (instr('0123456789ABCDEF', bytes[2 * i + 1]) - 1) + instr('0123456789ABCDEF', bytes[2 * i + 2]) - 1)::UHUGEINT)),
            lambda h, x: (xor(h, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM b)
        SELECT model, profile, 'index-' || lpad(lower(hex(h::UBIGINT)), 16, '0') || '.sidx' AS name FROM f""",
    "token_frames": """
        SELECT request_id, list_resize(CASE WHEN len(i) > 16 THEN list_concat(i[1:15], [999::BIGINT]) ELSE i END, 16, 0::BIGINT) AS ids, least(len(i), 16)::BIGINT AS used
        FROM (SELECT request_id, list_transform(string_split(query, ' '), lambda w: length(w)::BIGINT) AS i FROM search_request WHERE query IS NOT NULL)""",
}
