"""Commands: index, search, ask, stats, check, export, models."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .config import find_config, load_config, with_defaults
from .models import listing
from .plans import reports
from .plans.answers import ask
from .plans.build import build_index
from .plans.search import Index, search, search_federated
from .session import session
from .sources import index_io


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="notalith")
    p.add_argument("command", choices=("index", "search", "ask", "stats", "check", "export", "models"))
    p.add_argument("text", nargs="*")
    for name in ("db", "index", "model", "filter", "project", "type", "status", "since", "output", "config", "master"):
        p.add_argument(f"--{name}")
    for name in ("path", "tag", "vault", "ignore"):
        p.add_argument(f"--{name}", action="append")
    p.add_argument("-k", type=int)
    p.add_argument("--graph-boost", type=float)
    p.add_argument("--max-per-doc", type=int)
    p.add_argument("--nprobe", type=int)
    p.add_argument("--format", choices=("jsonl", "csv", "parquet"), default="jsonl")
    for name in ("semantic", "canonical", "ann", "explain", "no-vectors", "auto-tag", "auto-summarize"):
        p.add_argument(f"--{name}", action="store_true", default=None)
    return p


def run(argv: list[str] | None = None, spark=None):
    """The table that a command answers with, or None."""
    args = vars(parser().parse_args(argv))
    o = with_defaults(args, load_config(find_config(args.get("config"))))
    spark = spark or session(o.get("master"))
    if o["command"] == "models":
        return listing(spark)
    if o["command"] == "index":
        r = build_index(spark, o["db"], o["index"], model=o.get("model") or "hash-64", ignore=o.get("ignore"))
        return spark.createDataFrame([(r.files, r.chunks, r.reused, r.embedded)], "files int, chunks int, reused int, embedded int")
    where = {a: o.get(b) for a, b in (("globs", "path"), ("tags", "tag"), ("project", "project"), ("type", "type"), ("status", "status"), ("since", "since"), ("filter", "filter"), ("canonical_only", "canonical")) if o.get(b)}
    options = {a: o[b] for a, b in (("k", "k"), ("graph_boost", "graph_boost"), ("max_per_doc", "max_per_doc"), ("nprobe", "nprobe"), ("semantic_only", "semantic"), ("ann", "ann"), ("explain", "explain")) if o.get(b) is not None} | where
    queries = spark.createDataFrame([(0, " ".join(o["text"]))], "qid int, query string")
    if o.get("vault"):
        return search_federated(queries, {v: v for v in o["vault"]}, **options)
    index = Index.load(spark, o["index"])
    if o["command"] == "search":
        return search(queries, index, **options)
    if o["command"] == "ask":
        return ask(queries, index, **options)
    if o["command"] == "stats":
        return reports.stats(index.chunks)
    if o["command"] == "check":
        return reports.health(index.chunks, index.postings, index.lengths, index.edges)
    chunks = index.chunks
    if o.get("auto_tag") or o.get("auto_summarize"):
        from .operators.summaries import analyse

        chunks = chunks.join(analyse(chunks, "chunk_id"), "chunk_id")
    if o["format"] == "jsonl":
        index_io.export_jsonl(chunks, o["output"], not o.get("no_vectors"))
    elif o["format"] == "csv":
        index_io.export_csv(chunks, o["output"])
    else:
        index_io.export_parquet(chunks, o["output"])
    return spark.range(1).select(F.lit(o["output"]).alias("written"))


def main() -> None:
    run().show(50, truncate=120)


if __name__ == "__main__":
    main()
