"""Answering search requests, as batches and as a stream.

A stream's micro-batch is answered like any batch: every request that isn't
blank gets one response, errors included, so a bad request never stops the
stream.  The loaded index is the only thing the batches share.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoders import TextEncoder, encode_texts
from ..functions.vectors import compose, normalise
from ..operators.durable import checkpointed
from ..operators.relevance import relevant
from ..operators.requests import response_json, with_defaults, with_error
from ..operators.search import top_k
from ..sources.documents import parse_requests
from ..sources.files import memory_mib
from ..sources.index_file import load_searchable


def answer(requests: DataFrame, index: DataFrame, encoder: Callable[[], TextEncoder], timings: bool = False) -> DataFrame:
    """(request_no, generation, query_ms, search_ms, matches, embedding, error): one response a request.

    ``requests`` has the columns of :func:`documents.parse_requests`, or of a
    table of that kind (then without ``_corrupt``).  A request that can't be
    read has generation 0.  Embedding-only requests get their normalised
    query vector; others the relevant matches for the query vector less the
    weighted negative one, normalised, with the raw negative vector's
    exclusion.  Vectors without direction are errors.  The requests of a batch
    share their work: with ``timings`` each gets an equal part of the time that
    encoding and searching took, requests that weren't searched for none of
    the latter; without, and for refused requests, timings are null.
    """
    if "_corrupt" not in requests.columns:
        requests = requests.withColumn("_corrupt", F.lit(None).cast("string"))
    numbered = with_defaults(with_error(requests.withColumn("request_no", F.monotonically_increasing_id())))
    error = F.when(F.col("_corrupt").isNotNull(), F.lit("the request can't be read")).otherwise(F.col("error"))
    checked = checkpointed(numbered.withColumn("error", error).withColumn("generation", F.when(F.col("_corrupt").isNull(), F.col("generation")).otherwise(F.lit(0).cast("decimal(20,0)"))))
    good = checked.filter("error is null")
    begun = time.perf_counter()
    positive = encode_texts(good, "query", encoder, "p", "pe")
    both = encode_texts(positive.withColumn("_n", F.when(~F.col("embedding_only"), F.col("negative_query"))), "_n", encoder, "n", "ne")
    q = normalise(compose(F.col("p"), F.col("n"), F.col("negative_weight"), "float"), precision="float").cast("array<float>")
    ready = checkpointed(
        both.withColumn("q", q).withColumn("why", F.coalesce("pe", "ne", F.when(F.col("q").isNull(), F.lit("the query vector has no direction"))))
    )
    query_ms = (time.perf_counter() - begun) * 1000 / max(1, ready.count()) if timings else None
    asked = ready.filter("why is null and not embedding_only").select(F.col("request_no").alias("query_id"), F.col("q").alias("vector"), F.col("top_k").alias("k"), F.col("n").alias("negative"))
    found = top_k(index, asked)
    settings = ready.select(F.col("request_no").alias("query_id"), "score_window", "min_score_prominence", "min_results", "max_results")
    kept = relevant(found.join(settings, "query_id"), ["query_id"])
    lists = kept.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "key", F.col("score").cast("float").alias("score")))).alias("matches"))
    search_ms = None
    if timings:
        begun = time.perf_counter()
        lists = checkpointed(lists)
        search_ms = (time.perf_counter() - begun) * 1000 / max(1, asked.count())
    none = F.lit(None)
    ok = ready.join(lists, ready["request_no"] == lists["query_id"], "left").select(
        "request_no", "generation", F.lit(query_ms).cast("double").alias("query_ms"),
        F.when(F.col("why").isNull() & ~F.col("embedding_only"), F.lit(search_ms).cast("double")).alias("search_ms"), "matches",
        F.when(F.col("why").isNull() & F.col("embedding_only"), F.col("q")).alias("embedding"), F.col("why").alias("error"),
    )
    bad = checked.filter("error is not null").select(
        "request_no", "generation", none.cast("double").alias("query_ms"), none.cast("double").alias("search_ms"),
        none.cast("array<struct<rank:int,key:string,score:float>>").alias("matches"), none.cast("array<float>").alias("embedding"), "error",
    )
    return ok.unionByName(bad)


def responses(requests: DataFrame, index: DataFrame, encoder: Callable[[], TextEncoder], timings: bool = False) -> DataFrame:
    """The responses as JSON lines (request_no, value)."""
    return response_json(answer(requests, index, encoder, timings), ["request_no"])


def report(spark: SparkSession, path: str, encoder: Callable[[], TextEncoder], model: str, request: dict, threads: int = 1) -> dict:
    """One request, as a request line has it, against an index file: the answer with sizes, timings and memory, ready for a JSON document.

    A request that breaks a rule raises a ValueError that names it.
    """
    begun = time.perf_counter()
    encoder()
    model_ms = (time.perf_counter() - begun) * 1000
    begun = time.perf_counter()
    header, index = load_searchable(spark, path)
    items = index.select("key").distinct().count()
    index_ms = (time.perf_counter() - begun) * 1000
    line = spark.createDataFrame([(json.dumps({"generation": 0, **request}),)], "value string")
    r = answer(parse_requests(line), index, encoder, timings=True).first()
    if r is None or r["error"]:
        raise ValueError(r["error"] if r else "the request can't be read")
    return {
        "format": 1, "model": model, "indexModel": header.model, "items": items, "embeddings": header.count, "dimensions": header.dimensions, "threads": threads,
        "modelLoadMs": model_ms, "indexLoadMs": index_ms, "queryMs": r["query_ms"], "searchMs": r["search_ms"],
        "residentMib": memory_mib() or None, "proportionalMib": memory_mib(gauge="Pss") or None, "matches": [m.asDict() for m in r["matches"] or []],
    }


def serve(stream: DataFrame, index: DataFrame, encoder: Callable[[], TextEncoder], out: str, checkpoint: str, **trigger):
    """Answers a stream of requests into JSON lines below ``out``, one folder a micro-batch; returns the running query.

    A micro-batch that is run again after a failure replaces its folder, so
    each request is answered once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        answered = responses(rows, index, encoder, timings=True)
        answered.orderBy("request_no").select("value").write.mode("overwrite").text(f"{out.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_only(stream: DataFrame, client: str = "client", generation: str = "generation", at: str = "received_at", late: str = "1 hour") -> DataFrame:
    """The highest generation of every client and hour as requests stream in; rows later than ``late`` are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 hour"), client).agg(F.max(generation).alias(generation))


def maintain(stream: DataFrame, table_path: str, checkpoint: str, **trigger):
    """Keeps an index table (key, fingerprint, embedding) up to date from a stream of entries (position, key, fingerprint, embedding).

    Each micro-batch's last entry of a key replaces the table's; the table is
    written as a new version beside the old one and named in ``_current``
    only when it is whole.
    """
    from pathlib import Path

    from ..sources.index_file import replace_file

    def batch(rows: DataFrame, number: int) -> None:
        last = rows.filter("key is not null").groupBy("key").agg(F.max(F.struct("position", "fingerprint", "embedding")).alias("l")).select("key", "l.fingerprint", "l.embedding")
        pointer = Path(table_path) / "_current"
        spark = rows.sparkSession
        if pointer.exists():
            old = spark.read.parquet(f"{table_path}/{pointer.read_text().strip()}")
            last = last.unionByName(old.join(last.select("key"), "key", "left_anti"))
        version = f"v{number:08d}"
        last.write.mode("overwrite").parquet(f"{table_path}/{version}")
        replace_file(pointer, version.encode())

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
