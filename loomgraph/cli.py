"""``python -m loomgraph.cli``: the client's operations from a shell, and as a small HTTP service."""

from __future__ import annotations

import argparse
import json
import sys
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import DataFrame, SparkSession

from . import api, store
from .sources import files

READ_ONLY = ("callers", "callees", "implementers", "implemented-by", "impact", "top", "god-nodes", "communities", "related", "blindspots", "signatures", "query")


def session() -> SparkSession:
    return SparkSession.builder.appName("loomgraph").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def plain(result) -> object:
    return [r.asDict(True) for r in result.collect()] if isinstance(result, DataFrame) else result


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph")
    p.add_argument("--graph")
    p.add_argument("--db")
    p.add_argument("--root", default=".")
    p.add_argument("--isolation", default="single", choices=("single", "project", "branch"))
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("index")
    c.add_argument("folder")
    c.add_argument("--docs")
    c.add_argument("--clean", action="store_true")
    c.add_argument("--scip")
    for name in ("callers", "callees"):
        c = sub.add_parser(name)
        c.add_argument("name")
        c.add_argument("--depth", default=1)
    for name in ("implementers", "implemented-by"):
        sub.add_parser(name).add_argument("name")
    c = sub.add_parser("impact")
    c.add_argument("name")
    c.add_argument("--hops", default=3)
    c = sub.add_parser("feedback")
    c.add_argument("node")
    c.add_argument("kind")
    c.add_argument("--label", default="Function")
    c.add_argument("--weight", type=float)
    c = sub.add_parser("top")
    c.add_argument("--label", default="Function")
    c.add_argument("--limit", default=10)
    for name in ("god-nodes", "communities", "gc", "blindspots", "signatures", "doctor"):
        c = sub.add_parser(name)
        c.add_argument("--limit", default=10)
        c.add_argument("--dry-run", action="store_true")
    c = sub.add_parser("related")
    c.add_argument("name")
    c.add_argument("--depth", default=2)
    c.add_argument("--limit", default=10)
    sub.add_parser("query").add_argument("sql")
    sub.add_parser("mcp")
    sub.add_parser("serve").add_argument("--port", type=int, default=8787)
    return p


def run(args: argparse.Namespace) -> object:
    if args.command == "doctor":
        return api.doctor()
    if args.command == "gc":
        return store.collect_garbage(args.root, args.dry_run)
    path = store.graph_path(args.root, args.db, args.graph, args.isolation)
    client = api.Client(session(), path, args.command in READ_ONLY)
    return dispatch(client, args)


def dispatch(client: api.Client, args: argparse.Namespace) -> object:
    match args.command:
        case "index":
            told = client.index_tree(args.folder, args.clean)
            if args.docs:
                told |= client.index_documents(files.read_documents(client.spark, args.docs))
            if args.scip:
                told |= client.overlay_symbols(args.scip, files.read_tree(client.spark, args.folder))
            return told
        case "callers":
            return plain(client.callers(args.name, args.depth))
        case "callees":
            return plain(client.callees(args.name, args.depth))
        case "implementers":
            return client.implementers(args.name)
        case "implemented-by":
            return client.implemented_specs(args.name)
        case "impact":
            return plain(client.ranked_impact(args.name, args.hops))
        case "feedback":
            events = client.spark.createDataFrame([(0, args.node, args.kind, args.weight)], "seq long, node_id string, kind string, weight double")
            found = plain(client.feedback(events, args.label))
            return found[0] if found else None
        case "top":
            return plain(client.top(args.label, args.limit))
        case "god-nodes":
            return plain(client.god_nodes(args.limit))
        case "communities":
            return plain(client.communities())
        case "related":
            return plain(client.related(args.name, args.depth, args.limit))
        case "blindspots":
            return client.blindspots()
        case "signatures":
            return client.signatures()
        case "query":
            return plain(client.query(args.sql))
        case "serve":
            serve(client, args.port)
        case "mcp":
            from . import tools

            tools.serve(client)
    return None


def answer(client: api.Client, method: str, path: str, body: dict) -> tuple[int, object]:
    """One request of the service: status and body."""
    if (method, path) == ("GET", "/health"):
        try:
            return 200, {"status": "ok", "functions": client.graph.table("Function").count()}
        except Exception as e:
            return 503, {"status": "unhealthy", "error": str(e)[:200]}
    try:
        if (method, path) == ("POST", "/graph/call-chain"):
            if not isinstance(body.get("symbol"), str):
                return 400, {"error": "symbol is needed"}
            chain, told = client.call_chain_with_health(body["symbol"], body.get("direction", "both"), body.get("depth", 1))
            return 200, {"nodes": plain(chain)} | ({"indexHealth": told} if told else {})
        if (method, path) == ("POST", "/graph/impact-analysis"):
            if not isinstance(body.get("specId"), str):
                return 400, {"error": "specId is needed"}
            return 200, {"decisions": plain(client.impact(body["specId"], body.get("maxHops", 3)))}
        if (method, path) == ("POST", "/graph/ingest"):
            node = body.get("functionId") or body.get("nodeId")
            if not isinstance(node, str) or not isinstance(body.get("type"), str):
                return 400, {"error": "nodeId and type are needed"}
            try:
                label = "Function" if body.get("functionId") else api.schema.confidence_label(body.get("label", "Function"))
            except ValueError:
                label = "Function"
            events = client.spark.createDataFrame([(0, node, body["type"], body.get("weight"))], "seq long, node_id string, kind string, weight double")
            found = plain(client.feedback(events, label))
            return (200, found[0]) if found else (404, {"error": f"no {label} {node}"})
    except Exception as e:
        return 500, {"error": str(e)[:300]}
    return 404, {"error": "no such route"}


def serve(client: api.Client, port: int) -> None:
    class Handler(BaseHTTPRequestHandler):
        def _reply(self, method: str) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                body = json.loads(raw) if raw else {}
                status, told = answer(client, method, self.path, body) if isinstance(body, dict) else (400, {"error": "an object is needed"})
            except ValueError:
                status, told = 400, {"error": "this is no JSON"}
            data = json.dumps(told, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._reply("GET")

        def do_POST(self) -> None:
            self._reply("POST")

    HTTPServer(("127.0.0.1", port), Handler).serve_forever()


def main() -> int:
    args = parser().parse_args()
    try:
        print(json.dumps(run(args), default=str, indent=None if args.json else 2))
    except (ValueError, FileNotFoundError, PermissionError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
