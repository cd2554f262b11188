"""Knowledge documents to typed nodes and edges, and the impact queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .traverse import reach, steps


def parse_documents(docs: DataFrame) -> DataFrame:
    """``docs(content, fallback_id, ordinal)`` to one row each, ``id`` null where no artifact id is found.

    Candidates are the front matter's id, the path's last segment and the first heading, in this order.
    References are the body's links, then the relation fields; those to itself are dropped.
    """
    fields, body = T.front_matter(F.col("content"))
    d = docs.select("ordinal", "fallback_id", fields.alias("fields"), body.alias("body"))
    d = d.withColumn("heading", T.first_heading(F.col("body")))
    get = lambda k: F.try_element_at("fields", F.lit(k))
    d = d.withColumn("id", F.coalesce(T.classify_ref(get("id")), T.classify_ref(T.last_segment(F.col("fallback_id"))), T.classify_ref(F.col("heading"))))
    listed = F.flatten(F.array(*[F.coalesce(T.ref_ids(get(k)), F.array().cast("array<string>")) for k in T.RELATION_FIELDS]))
    linked = F.filter(F.transform(T.link_refs(F.col("body")), T.classify_ref), lambda x: x.isNotNull())
    refs = F.filter(F.array_distinct(F.concat(linked, listed)), lambda x: x != F.col("id"))
    return d.select("ordinal", "fallback_id", "id", T.ref_kind(F.col("id")).alias("kind"), F.coalesce(get("title"), "heading", "id").alias("title"), F.coalesce(get("status"), F.lit("unknown")).alias("status"), F.coalesce(get("date"), F.lit("")).alias("date"), F.when(F.col("id").isNotNull(), refs).alias("refs"))


def edges(parsed: DataFrame) -> DataFrame:
    """``(rel, src, dst)``, one row per reference: which relation follows from the kinds at both ends."""
    r = parsed.where("id is not null").select("id", "kind", F.explode("refs").alias("ref")).withColumn("to", T.ref_kind(F.col("ref")))
    rel = F.when(F.col("kind") != F.col("to"), "IMPACTS").when(F.col("kind") == "Decision", "SUPERSEDES").otherwise("RELATES")
    turned = (F.col("kind") == "Spec") & (F.col("to") == "Decision")
    return r.select(rel.alias("rel"), F.when(turned, F.col("ref")).otherwise(F.col("id")).alias("src"), F.when(turned, F.col("id")).otherwise(F.col("ref")).alias("dst"))


def nodes(parsed: DataFrame) -> DataFrame:
    """``(id, label, title, status, date, confidence, origin)``: declared documents, then stubs of what is only referenced."""
    own = parsed.where("id is not null")
    declared = own.select("id", F.col("kind").alias("label"), "title", F.when(F.col("kind") == "Spec", F.col("status")).alias("status"), F.when(F.col("kind") == "Decision", F.col("date")).alias("date"), F.lit(1.0).alias("confidence"), F.lit("declared").alias("origin"))
    stubs = own.select(F.explode("refs").alias("id")).distinct().join(own.select("id"), "id", "left_anti")
    none = lambda t: F.lit(None).cast(t)
    return declared.unionByName(stubs.select("id", T.ref_kind(F.col("id")).alias("label"), none("string").alias("title"), none("string").alias("status"), none("string").alias("date"), none("double").alias("confidence"), F.lit("referenced").alias("origin")))


def counts(parsed: DataFrame) -> DataFrame:
    """One row: node records by label, edge records by relation, documents read and left without an id."""
    n, e = nodes(parsed), edges(parsed)
    of = lambda c, v: F.count_if(F.col(c) == v)
    a = n.agg(of("label", "Spec").alias("specs"), of("label", "Decision").alias("decisions"))
    b = e.agg(of("rel", "IMPACTS").alias("impacts"), of("rel", "SUPERSEDES").alias("supersedes"), of("rel", "RELATES").alias("relates"))
    c = parsed.agg(F.count("*").alias("docs_scanned"), F.count_if(F.col("id").isNull()).alias("docs_unresolved"))
    return a.crossJoin(b).crossJoin(c)


def unresolved_clusters(unresolved: DataFrame, least: int = 3, most: int = 3) -> DataFrame:
    """``(prefix, n, samples)`` of the upper-case prefixes that at least ``least`` unresolved ``(fallback_id, ordinal)`` share, the ``most`` frequent."""
    prefix = F.regexp_extract(T.last_segment(F.col("fallback_id")), "^([A-Z][A-Z0-9_]*)-", 1)
    p = unresolved.select(prefix.alias("prefix"), "fallback_id", "ordinal").where("prefix != ''")
    total = p.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    firsts = p.groupBy("prefix", "fallback_id").agg(F.min("ordinal").alias("ordinal")).groupBy("prefix").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "fallback_id"))), lambda x: x["fallback_id"]), 1, 3).alias("samples"))
    return total.join(firsts, "prefix").orderBy(F.desc("n"), "prefix").limit(most)


def markdown_docs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Generic documents: nodes ``(id, title, status, confidence, origin)``, first of an id wins, and edges ``(src, dst)``."""
    fields, body = T.front_matter(F.col("content"))
    get = lambda k: F.try_element_at("fields", F.lit(k))
    d = docs.select("ordinal", "fallback_id", fields.alias("fields"), body.alias("body"))
    d = d.withColumn("id", F.coalesce(get("id"), "fallback_id")).where("id is not null")
    values = F.struct(F.coalesce(get("title"), T.first_heading(F.col("body")), "id").alias("title"), get("status").alias("status"))
    first = d.groupBy("id").agg(F.min_by(values, "ordinal").alias("v"))
    n = first.select("id", "v.title", "v.status", F.lit(1.0).alias("confidence"), F.lit("declared").alias("origin"))
    e = d.select(F.col("id").alias("src"), F.explode(T.link_refs(F.col("body"))).alias("dst")).where("src != dst").distinct()
    return n, e


def impact(decisions: DataFrame, impacts: DataFrame, supersedes: DataFrame, spec: str, hops=3) -> DataFrame:
    """``(id, title, confidence, via)`` of decisions behind a spec: direct ones, then those that supersede these."""
    direct = impacts.where(F.col("dst") == F.lit(spec)).select(F.col("src").alias("id")).distinct()
    chained = reach(supersedes, direct, steps(hops, 3), "in").select("id")
    both = direct.select("id", F.lit(0).alias("rank")).unionByName(chained.select("id", F.lit(1).alias("rank"))).groupBy("id").agg(F.min("rank").alias("rank"))
    found = decisions.join(both, "id")
    return found.select("id", "title", "confidence", F.when(F.col("rank") == 0, "direct").otherwise("supersedes").alias("via"))


def ranked_impact(decisions: DataFrame, impacts: DataFrame, supersedes: DataFrame, spec: str, hops=3) -> DataFrame:
    found = impact(decisions, impacts, supersedes, spec, hops)
    return found.withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).orderBy(F.desc("confidence"), "id")


def implementers(specs: DataFrame, implements: DataFrame, defines: DataFrame, functions: DataFrame, spec: str) -> DataFrame:
    """``(module, functions)``: the modules of a spec with their functions' names, sorted, repeated names kept."""
    modules = implements.where(F.col("dst") == F.lit(spec)).select(F.col("src").alias("module"))
    own = defines.join(functions.select(F.col("id").alias("dst"), "name"), "dst").select(F.col("src").alias("module"), "name")
    return modules.join(own, "module", "left").groupBy("module").agg(F.sort_array(F.collect_list("name")).alias("functions")).orderBy("module")


def implemented_specs(modules: DataFrame, implements: DataFrame, path: str) -> tuple[list[str], DataFrame]:
    """The modules that a path stands for and the specs of the one it stands for; several candidates are never picked from."""
    at = T.module_path(F.lit(path))
    wanted = modules.select(at.alias("at")).limit(1).collect()
    wanted = wanted[0]["at"] if wanted else path
    hits = sorted(r["id"] for r in modules.where(T.path_matches(F.col("id"), wanted)).select("id").distinct().collect())
    exact = [h for h in hits if h == wanted]
    chosen = exact or hits
    none = implements.where(F.lit(False))
    mine = implements.where(F.col("src") == F.lit(chosen[0])) if len(chosen) == 1 else none
    return chosen, mine.select(F.col("dst").alias("id")).orderBy("id")
