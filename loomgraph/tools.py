"""The client's operations as tools of a JSON-RPC server on standard input and output (Model Context Protocol)."""

from __future__ import annotations

import json
import sys

from pyspark.sql import functions as F

from . import api
from .cli import plain
from .sources import files

WRITES = ("index_code", "index_docs", "ingest_feedback", "related")
_S, _N, _L = {"type": "string"}, {"type": "number"}, {"type": "array"}
TOOLS = {
    "index_code": ("Index source files given as path and source.", {"files": _L}, ["files"]),
    "index_docs": ("Index specs and decisions given as markdown.", {"docs": _L}, ["docs"]),
    "call_chain": ("Callers and callees of a function by name.", {"symbol": _S, "direction": _S, "depth": _N}, ["symbol"]),
    "implementers": ("Modules that implement a spec.", {"specId": _S}, ["specId"]),
    "implemented_by": ("Specs that a module implements.", {"path": _S}, ["path"]),
    "impact_analysis": ("Decisions behind a spec.", {"specId": _S, "maxHops": _N}, ["specId"]),
    "ingest_feedback": ("Adjust a node's confidence by an event.", {"nodeId": _S, "type": _S, "label": _S, "weight": _N}, ["nodeId", "type"]),
    "related": ("What is important around a node.", {"seed": _S, "depth": _N, "limit": _N}, ["seed"]),
    "blindspots": ("Files that failed to parse.", {}, []),
    "signatures": ("Parse errors by cause.", {}, []),
    "doctor": ("What this installation can extract.", {}, []),
}


def call(client: api.Client, name: str, a: dict) -> object:
    """One tool; KeyError for a missing argument, ValueError for a bad one."""
    if client.graph.read_only and name in WRITES:
        raise PermissionError(f"{name} writes, and the graph is open for reading only")
    spark = client.spark
    if name == "index_code":
        return client.index_files(files.in_memory(spark, [(f["path"], f["source"]) for f in a["files"]]))
    if name == "index_docs":
        rows = [(d["content"], d.get("fallbackId"), k) for k, d in enumerate(a["docs"])]
        return client.index_documents(spark.createDataFrame(rows, "content string, fallback_id string, ordinal long"))
    if name == "call_chain":
        found = client.call_chain(a["symbol"], a.get("direction", "both"), a.get("depth", 1))
        anchors = client.graph.table("Function").where(F.col("name") == F.lit(a["symbol"])).select("file").unionByName(found.select("file"))
        health = client.index_health(anchors)
        return {"nodes": plain(found)} | ({"index_health": health} if health else {})
    if name == "implementers":
        return client.implementers(a["specId"])
    if name == "implemented_by":
        return client.implemented_specs(a["path"])
    if name == "impact_analysis":
        return plain(client.impact(a["specId"], a.get("maxHops", 3)))
    if name == "ingest_feedback":
        events = spark.createDataFrame([(0, a["nodeId"], a["type"], a.get("weight"))], "seq long, node_id string, kind string, weight double")
        found = plain(client.feedback(events, a.get("label", "Function")))
        if not found:
            raise ValueError(f"no {a.get('label', 'Function')} {a['nodeId']}")
        return found[0]
    if name == "related":
        return plain(client.related(a["seed"], a.get("depth", 2), a.get("limit", 10)))
    if name == "blindspots":
        return client.blindspots()
    if name == "signatures":
        return client.signatures()
    if name == "doctor":
        return api.doctor()
    raise ValueError(f"no tool {name}")


def handle(client: api.Client, message: dict) -> dict | None:
    """The reply to one message; None for a notification."""
    method, params = message.get("method"), message.get("params") or {}
    if "id" not in message:
        return None
    reply: dict = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "loomgraph", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]}}
    if method == "tools/call":
        try:
            told, failed = json.dumps(call(client, params.get("name", ""), params.get("arguments") or {}), default=str), False
        except Exception as e:
            told, failed = f"{type(e).__name__}: {e}"[:500], True
        return reply | {"result": {"content": [{"type": "text", "text": told}], "isError": failed}}
    return reply | {"error": {"code": -32601, "message": f"no method {method}"}}


def serve(client: api.Client) -> None:
    for line in sys.stdin:
        if line.strip():
            try:
                reply = handle(client, json.loads(line))
            except ValueError:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "this is no JSON"}}
            if reply:
                print(json.dumps(reply), flush=True)
