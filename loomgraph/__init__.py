"""Code and knowledge property-graph analytics expressed as Spark DataFrames."""

from .api import Client, doctor
from .extract.project import extract_code_graph, extract_project
from .operators.feedback import apply_feedback, feedback_trace, top_by_confidence
from .operators.health import blindspots, failure_buckets, healing, index_health, signature_buckets
from .operators.knowledge import impact, implemented_specs, implementers, markdown_docs, parse_documents, ranked_impact
from .operators.merge import upsert_edges, upsert_nodes
from .operators.rank import communities, god_nodes, pagerank, related
from .operators.traverse import call_chain, callees, callers, definition_files, neighbourhood, reach
from .sources.files import in_memory, read_documents, read_tree
from .sources.symbols import read_index
from .store import GraphStore, collect_garbage, graph_path

__version__ = "0.1.0"

__all__ = [
    "Client", "GraphStore", "apply_feedback", "blindspots", "call_chain", "callees", "callers", "collect_garbage", "communities", "definition_files", "doctor", "extract_code_graph", "extract_project",
    "failure_buckets", "feedback_trace", "god_nodes", "graph_path", "healing", "impact", "implemented_specs", "implementers", "in_memory", "index_health", "markdown_docs", "neighbourhood", "pagerank",
    "parse_documents", "ranked_impact", "reach", "read_documents", "read_index", "read_tree", "related", "signature_buckets", "top_by_confidence", "upsert_edges", "upsert_nodes",
]
