"""Command line: python -m vecloom create-index | insert | search | stats | benchmark | serve."""

from __future__ import annotations

import argparse
import json
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vecloom.operators import index as ann
from vecloom.operators.config import IndexConfig
from vecloom.plans.service import DEFAULT_K, DEFAULT_NPROBE, Service
from vecloom.sources.index_store import append_codes, load_index, save_index
from vecloom.sources.vector_files import read_json_vectors


def from_json(spark: SparkSession, path: str, dim: int, start: int = 0):
    """Vectors of one JSON document, with ids in its order."""
    return read_json_vectors(spark, path, dim).select((F.col("position") + start).cast("long").alias("vec_id"), "embedding")


def create(spark: SparkSession, path: str, vectors: str, dim: int, partitions: int) -> dict:
    """Train on the vectors and store the index."""
    index = ann.build(from_json(spark, vectors, dim), dim, IndexConfig(num_partitions=partitions))
    save_index(index, path, spark)
    return Service(spark, index).export()


def insert(spark: SparkSession, path: str, vectors: str) -> dict:
    index = load_index(spark, path)
    rows = from_json(spark, vectors, index.dim, index.next_id)
    return {"imported": append_codes(spark, path, index, rows)}


def handler(service: Service):
    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, found = service.http(self.command, self.path, body)
            out = json.dumps(found).encode()
            self.send_response(status)
            for name, value in (("Content-Type", "application/json"), ("Access-Control-Allow-Origin", "*"), ("Content-Length", str(len(out)))):
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = answer

    return Handler


def main(argv: list[str] | None = None) -> dict | None:
    p = argparse.ArgumentParser(prog="vecloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [c := sub.add_parser(name), *(c.add_argument(a) for a in args)][0]
    c = add("create-index", "index", "vectors")
    c.add_argument("--dim", type=int, required=True)
    c.add_argument("--partitions", type=int, default=16)
    add("insert", "index", "vectors")
    c = add("search", "index", "query")
    c.add_argument("--k", type=int, default=DEFAULT_K)
    c.add_argument("--nprobe", type=int, default=DEFAULT_NPROBE)
    add("stats", "index")
    c = add("benchmark")
    c.add_argument("--n", type=int, default=10_000)
    c.add_argument("--dim", type=int, default=64)
    c = add("serve", "index")
    c.add_argument("--port", type=int, default=8080)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "create-index":
        out = create(spark, a.index, a.vectors, a.dim, a.partitions)
    elif a.command == "insert":
        out = insert(spark, a.index, a.vectors)
    elif a.command == "benchmark":
        out = Service(spark, None).benchmark({"dim": a.dim, "n": a.n, "query_count": min(a.n, 200), "k": DEFAULT_K, "nprobe_values": [4, 8, 16, 32, 64, 100]})
    else:
        service = Service(spark, load_index(spark, a.index))
        if a.command == "serve":
            HTTPServer(("127.0.0.1", a.port), handler(service)).serve_forever()
            return None
        if a.command == "search":
            with open(a.query) as f:
                vector = json.load(f)
            out = service.search({"vector": vector["vector"] if isinstance(vector, dict) else vector, "k": a.k, "nprobe": a.nprobe})
        else:
            out = service.stats()
    print(json.dumps(out))
    return out


if __name__ == "__main__":
    main()
