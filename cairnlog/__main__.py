"""Command line: search a store, count its lines by step, keep ingesting push requests into it, serve it, look after it.

    python -m cairnlog search STORE '(a and b){app="web"}' --mint 0 --maxt 1 --count 10
    python -m cairnlog read STORE '{app="web"}' --start 0 --end 60000 --step 1000
    python -m cairnlog ingest REQUESTS STORE CHECKPOINT
    python -m cairnlog serve STORE SPOOL --port 9400
    python -m cairnlog compact STORE
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from .config import UI_COUNTS
from .engine import Engine
from .operators.search import as_json, ordered
from .plans.temql import parse
from .server import PORT, serve
from .streaming.ingest import read_compressed, read_requests, start_ingest


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="cairnlog", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    todo = parser.add_subparsers(dest="todo", required=True)
    search = todo.add_parser("search")
    search.add_argument("store")
    search.add_argument("query")
    search.add_argument("--mint", type=int)
    search.add_argument("--maxt", type=int)
    search.add_argument("--count", type=int, default=UI_COUNTS[0])
    search.add_argument("--semantics", choices=("record", "series"), default="record")
    search.add_argument("--direction", choices=("forward", "backward"), default="forward")
    search.add_argument("--json", action="store_true")
    read = todo.add_parser("read")
    read.add_argument("store")
    read.add_argument("query")
    for name in ("start", "end", "step"):
        read.add_argument(f"--{name}", type=int, required=True)
    ingest = todo.add_parser("ingest")
    for name in ("requests", "store", "checkpoint"):
        ingest.add_argument(name)
    serving = todo.add_parser("serve")
    serving.add_argument("store")
    serving.add_argument("spool")
    serving.add_argument("--port", type=int, default=PORT)
    todo.add_parser("compact").add_argument("store")
    return parser.parse_args(args)


def main(args: list[str] | None = None) -> None:
    a = arguments(args)
    spark = SparkSession.builder.appName("cairnlog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.todo == "ingest":
        start_ingest(read_requests(spark, a.requests), a.store, a.checkpoint).awaitTermination()
        return
    engine = Engine(spark, store=a.store)
    if a.todo == "compact":
        print(*[m.block_id for m in engine.compact()], *engine.retain(), sep="\n")
        return
    if a.todo == "serve":
        server = serve(engine, a.spool, a.port)
        start_ingest(read_compressed(spark, f"file://{os.path.abspath(a.spool)}"), a.store, f"{a.store}/checkpoint", f"{a.store}/dead_letters")
        server.serve_forever()
        return
    if a.todo == "search":
        found = engine.search(a.query, a.mint, a.maxt, a.count, semantics=a.semantics, direction=a.direction)
        rows = as_json(found).orderBy("series_key").select("json") if a.json else ordered(found, a.direction)
    else:
        query = parse(a.query)
        rows = engine.read(list(query.matchers) if query else [], a.start, a.end, a.step).orderBy("series_key", "bucket_end_ms")
    for row in rows.toLocalIterator():
        print(*row, sep="\t")


if __name__ == "__main__":
    main()
