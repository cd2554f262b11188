"""The client: index, query, feedback, health, over one graph store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .extract import lexical, project
from .lineage import cut
from .operators import feedback, health, knowledge, ranges, rank, traverse
from .sources import files as tree
from .sources import manifest, symbols
from .store import GraphStore


class Client:
    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark = spark
        self.store: GraphStore | None = GraphStore.open(spark, path, read_only)
        self.manifest_path = path.removesuffix(".graph") + ".parse-manifest"

    @property
    def graph(self) -> GraphStore:
        if self.store is None:
            raise RuntimeError("this client is closed")
        return self.store

    def close(self) -> None:
        self.store = None

    # writing
    def index_files(self, files: DataFrame, root: str = "", clean: bool = False) -> dict:
        """Extracts ``files(path, source)`` and upserts what they hold; returns the counts."""
        if clean:
            self.graph.clear()
        found = project.extract_project(files)
        self.graph.write({t: found[t] for t in ("Function", "Class", "Module", "Spec", "DEFINES", "IMPLEMENTS", "CALLS")})
        now = cut(found["health"], "health")
        previous = manifest.read_or_none(self.spark, self.manifest_path, root)
        healed = health.healing(previous, now).groupBy("change").count().collect() if previous is not None else []
        manifest.write_run(now, self.manifest_path, root, clean)
        counts = found["counts"].first().asDict() | health.summary(now).first().asDict()
        return counts | {"functions": found["Function"].count(), "calls": found["CALLS"].count(), **{r["change"]: r["count"] for r in healed}}

    def index_tree(self, root: str, clean: bool = False) -> dict:
        return self.index_files(tree.read_tree(self.spark, root), root, clean) | tree.unreached(root)

    def index_documents(self, docs: DataFrame) -> dict:
        """Upserts specs and decisions of ``docs(content, fallback_id, ordinal)``."""
        parsed = cut(knowledge.parse_documents(docs), "parsed")
        nodes, edges = knowledge.nodes(parsed), knowledge.edges(parsed)
        batches = {}
        for label, column in (("Spec", "status"), ("Decision", "date")):
            own = nodes.where(F.col("label") == label)
            present = F.when(F.col("origin") == "declared", F.array(*[F.lit(c) for c in ("title", column, "confidence", "origin")])).otherwise(F.array(F.lit("origin")))
            batches[label] = own.select("id", "title", column, "confidence", "origin", present.alias("present"))
        batches |= {rel: edges.where(F.col("rel") == rel).select("src", "dst").distinct() for rel in ("IMPACTS", "SUPERSEDES", "RELATES")}
        self.graph.write(batches)
        clusters = knowledge.unresolved_clusters(parsed.where("id is null").select("fallback_id", "ordinal")).collect()
        return knowledge.counts(parsed).first().asDict() | {"unresolved_clusters": [r.asDict() for r in clusters]}

    def index_markdown(self, docs: DataFrame) -> None:
        nodes, edges = knowledge.markdown_docs(docs)
        self.graph.write({"Doc": nodes, "REFERENCES": edges})

    def overlay_symbols(self, path: str, files: DataFrame) -> dict:
        """Adds the definitions and call edges of a symbol index over the scopes of ``files``; the counts are those of the index and of what was found.

        Definitions that resolve to the same scope, as overloads do, are one node.
        """
        occurrences = symbols.read_index(self.spark, path)
        if occurrences.isEmpty():
            raise ValueError(f"{path} holds no documents")
        flat = project.scan_files(files).where("kind in ('function', 'class')")
        ranges.overlap(flat.select("file"), occurrences)
        ids = ranges.qualify(flat.select("file", "kind", "name", "start", "end", "ordinal")).join(flat.select("file", "ordinal", "line", "kind", (F.col("line") + 0).alias("first")), ["file", "ordinal", "kind"])
        lines = files.select(F.col("path").alias("file"), F.col("source"))
        last = F.size(F.split(F.left(F.col("source"), F.col("end").cast("int")), "\n"))
        scopes = ids.join(lines, "file").select("id", "file", "kind", F.col("first").cast("int").alias("start"), last.alias("end"), "ordinal")
        definitions, edges, counts = ranges.index_edges(occurrences, scopes)
        nodes = cut(ranges.index_nodes(definitions, ids.join(lines.select("file"), "file").select("id", "file", "kind", "name", F.col("first").alias("start_line"))), "overlay")
        functions, classes = nodes.where("kind = 'function'"), nodes.where("kind = 'class'")
        given = [F.lit(schema.INDEX_CONFIDENCE).alias("confidence"), F.lit(schema.INDEX_PROVIDER).alias("provider")]
        self.graph.write({
            "Module": nodes.select(F.col("file").alias("id"), F.col("file").alias("path")).distinct(),
            "Function": functions.select("id", "name", "file", "start_line", *given),
            "Class": classes.select("id", "name", "file", given[1]),
            "DEFINES": functions.select(F.col("file").alias("src"), F.col("id").alias("dst")),
            "CALLS": edges,
        })
        told = occurrences.agg(F.count_distinct("file").alias("documents")).first().asDict()
        return counts.first().asDict() | told | {"files_parsed": files.count(), "files_matched": ranges.overlap(flat.select("file"), occurrences).count(), "calls_emitted": edges.count(), "nodes": nodes.count()}

    def feedback(self, events: DataFrame, label: str = "Function") -> DataFrame:
        """Applies ``events(seq, node_id, kind[, weight])``; returns before and after of each event, none for missing nodes."""
        label = schema.confidence_label(label)
        nodes = self.graph.table(label)
        trace = cut(feedback.feedback_trace(nodes, events), "trace")
        self.graph.replace({label: feedback.apply_feedback(nodes, events)})
        return trace

    # reading
    def query(self, sql: str, **params) -> DataFrame:
        return self.graph.query(sql, **params)

    def callers(self, name: str, depth=1) -> DataFrame:
        return traverse.callers(self.graph.table("Function"), self.graph.table("CALLS"), name, depth)

    def callees(self, name: str, depth=1) -> DataFrame:
        return traverse.callees(self.graph.table("Function"), self.graph.table("CALLS"), name, depth)

    def call_chain(self, name: str, direction: str = "both", depth=1) -> DataFrame:
        return traverse.call_chain(self.graph.table("Function"), self.graph.table("CALLS"), name, direction, depth)

    def implementers(self, spec: str) -> dict:
        """Title and origin of a spec (null when it is unknown) and its modules with their functions."""
        g, spec = self.graph, spec.upper()
        row = g.table("Spec").where(F.col("id") == F.lit(spec)).first()
        found = knowledge.implementers(g.table("Spec"), g.table("IMPLEMENTS"), g.table("DEFINES"), g.table("Function"), spec).collect()
        return {"title": row["title"] if row else None, "origin": (row["origin"] or "declared") if row else None, "modules": [{"module": r["module"], "functions": r["functions"]} for r in found]}

    def implemented_specs(self, path: str) -> dict:
        hits, specs = knowledge.implemented_specs(self.graph.table("Module"), self.graph.table("IMPLEMENTS"), path)
        found = len(hits) == 1
        return {"module_found": found, "resolved_from": hits[0] if found else None, "ambiguous_matches": hits if len(hits) > 1 else [], "specs": [r["id"] for r in specs.collect()] if found else []}

    def impact(self, spec: str, hops=3) -> DataFrame:
        g = self.graph
        return knowledge.impact(g.table("Decision"), g.table("IMPACTS"), g.table("SUPERSEDES"), spec.upper(), hops)

    def ranked_impact(self, spec: str, hops=3) -> DataFrame:
        g = self.graph
        return knowledge.ranked_impact(g.table("Decision"), g.table("IMPACTS"), g.table("SUPERSEDES"), spec.upper(), hops)

    def top(self, label: str = "Function", limit=10) -> DataFrame:
        label = schema.confidence_label(label)
        return feedback.top_by_confidence(self.graph.table(label).select("id", F.col(schema.DISPLAY[label]).alias("display"), "confidence"), limit)

    def god_nodes(self, limit=10, damping: float = rank.DAMPING) -> DataFrame:
        return rank.god_nodes(self.graph.nodes(), self.graph.edges(), limit, damping)

    def related(self, seed: str, depth=2, limit=10) -> DataFrame:
        return rank.related(self.graph.nodes(), self.graph.edges(), seed, depth, limit)

    def communities(self, max_phases: int = 20, max_iterations: int = 20) -> DataFrame:
        return rank.communities(self.graph.table("Function"), self.graph.table("CALLS"), max_phases, max_iterations)

    def _health(self) -> DataFrame | None:
        return manifest.read(self.spark, self.manifest_path)

    def index_health(self, files: DataFrame) -> dict | None:
        """What an answer over ``files(file)`` may lack; None without a manifest or when all is healthy, ``unavailable`` with the reason when health can't be told. Never raises, as the answer itself is there."""
        try:
            known = self._health()
            row = health.index_health(known, files).first() if known is not None else None
            return row.asDict() if row else None
        except Exception as e:
            return {"files_indexed": 0, "partial": 0, "failed": 0, "unavailable": str(e)[:200]}

    def call_chain_with_health(self, name: str, direction: str = "both", depth=1) -> tuple[DataFrame, dict | None]:
        """The call chain, and the index health of its files and of those that define the name."""
        chain = cut(self.call_chain(name, direction, depth), "chain")
        files = traverse.definition_files(self.graph.table("Function"), name).unionByName(chain.select("file")).distinct()
        return chain, self.index_health(files)

    def blindspots(self) -> list[dict]:
        known = self._health()
        return [r.asDict() for r in health.blindspots(known).select("path", "failed", "error_nodes").collect()] if known is not None else []

    def signatures(self) -> dict:
        known = self._health()
        if known is None:
            return {"signatures": [], "failures": []}
        return {"signatures": [r.asDict() for r in health.signature_buckets(known).collect()], "failures": [r.asDict() for r in health.failure_buckets(known).collect()]}


def doctor() -> dict:
    """What this installation can extract; needs no graph."""
    import pyspark

    return {"spark": pyspark.__version__, "extractor": lexical.NAME, "languages": list(lexical.LANGUAGES), "unavailable": []}
