"""Command line and HTTP front ends over the catalogue: every query by name, as JSON lines.

Exit codes: 0, 1 for a failure at run time, 2 for wrong usage; a closed pipe is no failure.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.config import NEIGHBOR_FLOOR, NEIGHBOR_LIMIT, SETTINGS, save_preferences, settings
from threadloom.operators import edges
from threadloom.operators.merge import SnapshotStore
from threadloom.plans import catalogue, model, nested_queries, serving, upkeep  # noqa: F401  the last adds to the catalogue
from threadloom.plans.pipeline import Pipeline
from threadloom.session import scope
from threadloom.sources.providers import Provider

QUERIES = catalogue.QUERIES | nested_queries.QUERIES
DEFAULT_LIMIT = 50


def session() -> SparkSession:
    spark = SparkSession.builder.appName("threadloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _lines(found: DataFrame, limit: int) -> list[str]:
    return (found.limit(limit) if limit else found).toJSON().collect()


def rows(spark: SparkSession, name: str, root: str, limit: int) -> list[str]:
    """JSON of the first rows of a query; ``limit`` 0 takes all that the caller asked the driver to hold."""
    with scope():
        return _lines(QUERIES[name](spark, root), limit)


def _flag(text: str) -> bool:
    if text.lower() not in ("true", "false", "1", "0"):
        raise ValueError(f"neither true nor false: {text}")
    return text.lower() in ("true", "1")


def _whole(text: str) -> int:
    if int(text) < 1:
        raise ValueError(f"must be above 0: {text}")
    return int(text)


def _numbers(text: str) -> list[int]:
    return [int(n) for n in text.split(",") if n.strip().lstrip("-").isdigit()]


def _one_of(*names: str) -> Callable[[str], str]:
    def parse(text: str) -> str:
        if text not in names:
            raise ValueError(f"must be one of {', '.join(names)}")
        return text

    return parse


def _floor(text: str) -> float:
    return float(text)


def _neighbors(spark: SparkSession, root: str, thread_id: int, limit: int = NEIGHBOR_LIMIT, floor: float = NEIGHBOR_FLOOR) -> DataFrame:
    rows_ = model.scoped(model.vectors(spark, root), model.threads(spark, root))
    return edges.neighbors_of(rows_.where(F.col("id") == thread_id), rows_, limit, floor).select("right_id", "score", "rank").orderBy("rank")


def _author(spark: SparkSession, root: str, login: str) -> DataFrame:
    """Threads of one author with each one's strongest stored edge to another of theirs; a blank login has none."""
    from threadloom.plans.catalogue import author_strongest_match

    mine = model.threads(spark, root).where((F.lower(F.trim("author_login")) == login.strip().lower()) & (F.trim("author_login") != ""))
    best = author_strongest_match(spark, root).withColumnRenamed("thread_id", "id")
    return mine.select(*catalogue._THREAD).join(best, "id", "left").orderBy(F.col("updated_at_gh").desc_nulls_last(), F.col("number").desc())


#: Views with parameters: their function, the parsers of what may be given, and what must be.
VIEWS: dict[str, tuple[Callable[..., DataFrame], dict[str, Callable], tuple[str, ...]]] = {
    "threads": (serving.threads_view, {"repo_id": int, "kind": _one_of("issue", "pull_request"), "numbers": _numbers, "include_closed": _flag, "limit": _whole}, ()),
    "author_threads_of": (_author, {"login": str}, ("login",)),
    "search": (serving.search_view, {"text": str, "repo_id": int, "mode": _one_of("keyword", "semantic", "hybrid"), "limit": _whole}, ("text",)),
    "neighbors": (_neighbors, {"thread_id": int, "limit": _whole, "floor": _floor}, ("thread_id",)),
    "clusters": (serving.clusters_view, {"include_closed": _flag}, ()),
    "cluster_list": (serving.snapshot, {"repo_id": int, "least": _whole, "sort": _one_of("recent", "size"), "text": str, "include_closed": _flag, "limit": _whole}, ()),
    "cluster": (serving.detail, {"component": int, "most": _whole}, ("component",)),
}


def view(spark: SparkSession, name: str, root: str, given: dict[str, str]) -> list[str]:
    run, parsers, needed = VIEWS[name]
    if unknown := set(given) - set(parsers):
        raise ValueError(f"unknown: {', '.join(sorted(unknown))}")
    if missing := [n for n in needed if n not in given]:
        raise ValueError(f"missing: {', '.join(missing)}")
    args = {k: parsers[k](v) for k, v in given.items()}
    with scope():
        return _lines(run(spark, root, **args), 0 if "limit" in args or name in ("cluster", "neighbors") else DEFAULT_LIMIT)


def act(pipeline: Pipeline, name: str, body: dict, now: str, provider: Provider | None = None) -> dict:
    """An action on the store: ``refresh``, ``rerun``, ``close-thread``, ``close-cluster``."""
    with scope():
        if name == "close-thread":
            return {"ok": True, "cluster_closed": pipeline.close_thread(int(body["repo_id"]), int(body["number"]), now)}
        if name == "close-cluster":
            pipeline.close_cluster(int(body["cluster_id"]), now)
            return {"ok": True}
        if name == "rerun":
            return pipeline.rerun(str(body["stage"]), int(body["repo_id"]), now, provider, int(body.get("dimensions", 0)))
        wants = {k: bool(body.get(k, False)) for k in ("embed", "cluster")}
        if wants["embed"] and provider is None:
            raise ValueError("embed needs a provider")
        return pipeline.refresh(int(body["repo_id"]), now, provider=provider if wants["embed"] else None, dimensions=int(body.get("dimensions", 0)), cluster=wants["cluster"])


ACTIONS = ("refresh", "rerun", "close-thread", "close-cluster")


def handler(spark: SparkSession, root: str, pipeline: Pipeline | None = None, provider: Provider | None = None) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def answer(self, work: Callable[[], tuple[int, str]]) -> None:
            try:
                status, body = work()
            except (ValueError, KeyError) as e:
                status, body = 400, json.dumps({"error": str(e)[:2000]})
            except LookupError as e:
                status, body = 404, json.dumps({"error": str(e)[:2000]})
            except Exception as e:
                status, body = 500, json.dumps({"error": str(e)[:2000]})
            data = body.encode()
            self.send_response(status)
            self.send_header("content-type", "application/json")
            self.send_header("content-length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            url = urlparse(self.path)
            name, args = url.path.strip("/").replace("-", "_"), {k: v[0] for k, v in parse_qs(url.query).items()}

            def work() -> tuple[int, str]:
                if name == "health":
                    return 200, json.dumps({"ok": True, "spark": spark.version})
                if name in VIEWS:
                    return 200, "[" + ",".join(view(spark, name, root, args)) + "]"
                if name not in QUERIES:
                    return 404, json.dumps({"error": f"no query {name}"})
                return 200, "[" + ",".join(rows(spark, name, root, _whole(args.get("limit", str(DEFAULT_LIMIT))))) + "]"

            self.answer(work)

        def do_POST(self) -> None:
            def work() -> tuple[int, str]:
                name = urlparse(self.path).path.strip("/").removeprefix("actions/")
                if name not in ACTIONS or pipeline is None:
                    return 404, json.dumps({"error": f"no action {name}"})
                body = json.loads(self.rfile.read(int(self.headers.get("content-length") or 0)) or b"{}")
                if not isinstance(body, dict):
                    raise ValueError("the body must be a JSON object")
                now = str(body.get("now") or datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z"))
                return 200, json.dumps(act(pipeline, name, body, now, provider))

            self.answer(work)

        def log_message(self, *_: object) -> None:
            pass

    return Handler


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="threadloom")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("queries", help="names of all queries")
    one = sub.add_parser("query", help="rows of a query as JSON lines")
    one.add_argument("name", choices=sorted(QUERIES))
    one.add_argument("--root", required=True, help="folder of the tables")
    one.add_argument("--limit", type=int, default=DEFAULT_LIMIT)
    plan = sub.add_parser("explain", help="plan of a query")
    plan.add_argument("name", choices=sorted(QUERIES))
    plan.add_argument("--root", required=True)
    serve = sub.add_parser("serve", help="queries over HTTP")
    serve.add_argument("--root", required=True)
    serve.add_argument("--port", type=int, default=SETTINGS["port"])
    serve.add_argument("--store", default="", help="folder of the snapshot store that actions work on")
    seen = sub.add_parser("view", help="a view with parameters, as JSON lines")
    seen.add_argument("name", choices=sorted(VIEWS))
    seen.add_argument("--root", required=True)
    seen.add_argument("given", nargs="*", metavar="NAME=VALUE")
    check = sub.add_parser("doctor", help="whether Spark and the store answer")
    check.add_argument("--store", required=True)
    conf = sub.add_parser("config", help="settings and where they come from; NAME=VALUE saves preferences")
    conf.add_argument("--file", default="")
    conf.add_argument("given", nargs="*", metavar="NAME=VALUE")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        if args.command == "queries":
            print("\n".join(sorted(QUERIES)))
        elif args.command == "query":
            for line in rows(session(), args.name, args.root, args.limit):
                print(line)
        elif args.command == "explain":
            QUERIES[args.name](session(), args.root).explain("formatted")
        elif args.command == "view":
            for line in view(session(), args.name, args.root, dict(g.split("=", 1) for g in args.given)):
                print(line)
        elif args.command == "doctor":
            spark = session()
            print(json.dumps(Pipeline(spark, SnapshotStore(spark, args.store)).doctor()))
        elif args.command == "config":
            if args.given:
                save_preferences(args.file, dict(g.split("=", 1) for g in args.given))
            print(json.dumps({k: {"value": v, "from": o} for k, (v, o) in settings(os.environ, args.file, ".env.local").items()}))
        else:
            spark = session()
            pipeline = Pipeline(spark, SnapshotStore(spark, args.store)) if args.store else None
            ThreadingHTTPServer(("127.0.0.1", args.port), handler(spark, args.root, pipeline)).serve_forever()
    except BrokenPipeError:
        return 0
    except Exception as e:
        print(str(e)[:2000], file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
