"""The search command line: one query against an index file, answered as a JSON document."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from ..functions.encoders import OnnxTextEncoder, hashing_factory
from ..sources.index_file import IndexFileError, read_header
from ..sources.manifest import load as load_manifest
from .serve import report

#: Option, its name in a request, its kind.
OPTIONS = (
    ("--negative-query", "negativeQuery", str), ("--negative-weight", "negativeWeight", float), ("--top-k", "topK", int), ("--score-window", "scoreWindow", float),
    ("--min-score-prominence", "minScoreProminence", float), ("--max-results", "maxResults", int), ("--min-results", "minResults", int),
)


class _Once(argparse.Action):
    """An option that may be given once."""

    def __call__(self, parser, namespace, values, option_string=None):
        if getattr(namespace, self.dest) is not None:
            parser.error(f"{option_string} is given twice")
        setattr(namespace, self.dest, values)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """``python -m glintframe.streaming.command INDEX QUERY [options]``; a failure prints its report and ends with 1.

    Without ``--manifest`` of a model pack the query is encoded by the hashing
    encoder of the index's width.
    """
    parser = argparse.ArgumentParser(prog="search", allow_abbrev=False)
    parser.add_argument("index")
    parser.add_argument("query")
    parser.add_argument("--manifest", action=_Once)
    parser.add_argument("--threads", action=_Once, type=int)
    for option, name, kind in OPTIONS:
        parser.add_argument(option, dest=name, action=_Once, type=kind)
    a = parser.parse_args(arguments)
    request = {"query": a.query, "topK": 10} | {name: value for _, name, _ in OPTIONS if (value := getattr(a, name)) is not None}
    threads = a.threads or 1
    try:
        if a.manifest:
            manifest = load_manifest(Path(a.manifest))
            model, encoder = manifest.id, lambda: OnnxTextEncoder(manifest, threads)
        else:
            model, encoder = "hashing", hashing_factory(read_header(a.index).dimensions)
        out = report(spark or SparkSession.builder.getOrCreate(), a.index, encoder, model, request, threads)
    except (OSError, ValueError, IndexFileError) as e:
        print(json.dumps({"code": "search_failed", "message": str(e), "hint": "see --help for the options"}))
        return 1
    print(json.dumps(out, indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
