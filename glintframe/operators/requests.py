"""Search requests and responses as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_NEGATIVE_WEIGHT = 0.5


def _blank(c: str) -> Column:
    # white space of any script, as a trimmed text's emptiness is judged
    return F.col(c).isNull() | ~F.col(c).rlike(r"[^\s\p{Z}\x85]")


def _unsound(c: str) -> Column:
    return F.col(c).isNotNull() & (F.isnan(c) | (F.abs(c) == float("inf")) | (F.col(c) < 0))


def with_error(requests: DataFrame) -> DataFrame:
    """The requests with ``error``: the first rule that a request breaks, or null.

    A query must not be blank; other rules don't hold for embedding-only
    requests: ``top_k`` is positive, ``negative_weight`` (null means 0.5),
    ``score_window`` and ``min_score_prominence`` are finite and not
    negative, ``max_results`` is positive.  Nulls of the last three are fine.
    """
    search = ~F.coalesce("embedding_only", F.lit(False))
    return requests.withColumn(
        "error",
        F.when(_blank("query"), "query must not be empty")
        .when(search & ~F.coalesce(F.col("top_k") > 0, F.lit(False)), "top-k must be positive")
        .when(search & _unsound("negative_weight"), "invalid negative weight")
        .when(search & _unsound("score_window"), "invalid score window")
        .when(search & _unsound("min_score_prominence"), "invalid minimum score prominence")
        .when(search & F.coalesce(F.col("max_results") <= 0, F.lit(False)), "invalid maximum result count"),
    )


def with_defaults(requests: DataFrame, lower_case: bool = False) -> DataFrame:
    """Null settings replaced: weight 0.5, no minimum of results, not embedding-only; a blank negative query becomes null.

    A weight that isn't a number becomes null, and ``weight_is_number`` false.
    With ``lower_case`` the query and the negative query are put into lower
    case, as models trained on such text want them.
    """
    case = F.lower if lower_case else F.col
    return requests.withColumns(
        {
            "negative_weight": F.when(~F.isnan("negative_weight") | F.col("negative_weight").isNull(), F.coalesce("negative_weight", F.lit(DEFAULT_NEGATIVE_WEIGHT).cast("float"))),
            "weight_is_number": ~F.isnan(F.coalesce("negative_weight", F.lit(0).cast("float"))),
            "min_results": F.coalesce("min_results", F.lit(0).cast("long")),
            "embedding_only": F.coalesce("embedding_only", F.lit(False)),
            "negative_query": F.when(~_blank("negative_query"), case("negative_query")),
            "query": case("query"),
        }
    )


def latest_generation(requests: DataFrame, client: str = "client") -> DataFrame:
    """(client, generation): every client's highest generation, by which stale responses are told."""
    return requests.groupBy(client).agg(F.max("generation").alias("generation"))


def response_lists(matches: DataFrame, by: str = "generation") -> DataFrame:
    """(generation, matches): the matches of a response as an array of (rank, key, score) in the order of rank.

    Matches without key or rank belong to no response; of equal ranks the smaller key goes first.
    """
    kept = matches.filter(f"{by} is not null and key is not null and rank is not null")
    return kept.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", "key", "score"))).alias("matches"))


def response_json(responses: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One JSON line (column ``value``, beside those to ``keep``) for every response (generation, query_ms, search_ms, matches, embedding, error).

    The embedding is left out where there is none; the error is written even if null.
    """
    names = {"query_ms": "queryMs", "search_ms": "searchMs"}
    base = [F.col(c).alias(names.get(c, c)) for c in ("generation", "query_ms", "search_ms")]
    matches = F.coalesce("matches", F.array().cast("array<struct<rank:int,key:string,score:float>>")).alias("matches")
    plain = {"ignoreNullFields": "false"}
    without = F.to_json(F.struct(*base, matches, "error"), plain)
    withit = F.to_json(F.struct(*base, matches, "embedding", "error"), plain)
    return responses.select(*keep, F.when(F.col("embedding").isNull(), without).otherwise(withit).alias("value"))
