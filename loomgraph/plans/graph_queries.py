"""Traversal, resolution, impact, ranking: queries over derived graphs with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import knowledge, rank, ranges, resolve, traverse
from . import driver as D

DEPTH = 2
ROUNDS = rank.ITERATIONS


def join01_resolve_local(spark, sf):
    r = resolve.resolve_calls(D.raw_calls(spark, sf), resolve.bare_names(D.functions(spark, sf)))
    return r.where("outcome = 'local'").groupBy("file").agg(F.count("*").alias("n"), F.min("to_id").alias("first_target"), F.max("to_id").alias("last_target"))


def join02_resolve_global(spark, sf):
    r = resolve.resolve_calls(D.raw_calls(spark, sf), resolve.bare_names(D.functions(spark, sf)))
    return r.groupBy("file", "outcome").agg(F.count("*").alias("n"), F.count_distinct("to_id").alias("targets"))


def join03_global_index(spark, sf):
    return resolve.global_index(resolve.bare_names(D.functions(spark, sf))).withColumnRenamed("only", "only_id")


def ext08_bare_names(spark, sf):
    return resolve.bare_names(D.functions(spark, sf))


def agg01_call_edges(spark, sf):
    names = resolve.bare_names(D.functions(spark, sf))
    return resolve.build_call_edges(resolve.resolve_calls(D.raw_calls(spark, sf), names))


def agg02_project_counts(spark, sf):
    return resolve.resolution_counts(resolve.resolve_calls(D.raw_calls(spark, sf), resolve.bare_names(D.functions(spark, sf))))


def join24_coverage(spark, sf):
    names, raw = resolve.bare_names(D.functions(spark, sf)), D.raw_calls(spark, sf)
    edges = resolve.build_call_edges(resolve.resolve_calls(raw, names))
    return resolve.cross_file_coverage(names, raw, edges, D.functions(spark, sf)).withColumn("coverage", F.round("coverage", 6))


def join04_callers(spark, sf):
    return traverse.callers(D.functions(spark, sf), D.calls(spark, sf), D.seed_name(spark, sf), DEPTH)


def join05_callees(spark, sf):
    return traverse.callees(D.functions(spark, sf), D.calls(spark, sf), D.seed_name(spark, sf), DEPTH)


def join06_call_chain(spark, sf):
    return traverse.call_chain(D.functions(spark, sf), D.calls(spark, sf), D.seed_name(spark, sf), "both", DEPTH)


def join07_definition_files(spark, sf):
    return traverse.definition_files(D.functions(spark, sf), D.seed_name(spark, sf))


def join08_implementers(spark, sf):
    """Modules are brands; a brand implements the suppliers of its parts and defines its parts."""
    parts = D.functions(spark, sf)
    lines = D.table(spark, sf, "lineitem").select(D.text("l_partkey").alias("id"), D.text("l_suppkey").alias("dst"))
    implements = lines.join(parts, "id").select(F.col("file").alias("src"), "dst").distinct()
    defines = parts.select(F.col("file").alias("src"), F.col("id").alias("dst"))
    return knowledge.implementers(D.specs(spark, sf), implements, defines, parts, D.SPEC).select("module", F.array_join("functions", ",").alias("functions"))


def join09_implemented_specs(spark, sf):
    parts = D.functions(spark, sf)
    lines = D.table(spark, sf, "lineitem").select(D.text("l_partkey").alias("id"), D.text("l_suppkey").alias("dst"))
    implements = lines.join(parts, "id").select(F.concat(F.lit("src/"), "file").alias("src"), "dst").distinct()
    modules = parts.select(F.concat(F.lit("src/"), "file").alias("id")).distinct()
    first = parts.agg(F.min("file")).first()[0]
    return knowledge.implemented_specs(modules, implements, f"./{first}")[1]


def join10_impact_direct(spark, sf):
    return knowledge.impact(D.decisions(spark, sf), D.impacts(spark, sf), D.supersedes(spark, sf), D.SPEC, 3).where("via = 'direct'").select("id")


def join11_impact_chained(spark, sf):
    direct = D.impacts(spark, sf).where(F.col("dst") == D.SPEC).select(F.col("src").alias("id")).distinct()
    return traverse.reach(D.supersedes(spark, sf), direct, 3, "in").select("id").distinct()


def join12_impact_analysis(spark, sf):
    return knowledge.impact(D.decisions(spark, sf), D.impacts(spark, sf), D.supersedes(spark, sf), D.SPEC, 3).select("id", "title", "via")


def join13_ranked_impact(spark, sf):
    return knowledge.ranked_impact(D.decisions(spark, sf), D.impacts(spark, sf), D.supersedes(spark, sf), D.SPEC, 3)


def _heterogeneous(spark, sf):
    """Regions, nations, suppliers and parts with their relations, the calls of parts among them: the whole mixed graph."""
    region = D.table(spark, sf, "region").select(F.lit("Spec").alias("label"), D.text("r_regionkey").alias("id"), F.col("r_name").alias("display"))
    nation = D.table(spark, sf, "nation").select(F.lit("Module").alias("label"), D.text("n_nationkey").alias("id"), F.col("n_name").alias("display"))
    supplier = D.table(spark, sf, "supplier").select(F.lit("Function").alias("label"), F.concat(F.lit("s"), D.text("s_suppkey")).alias("id"), F.col("s_name").alias("display"))
    a = D.table(spark, sf, "nation").select(F.lit("IMPLEMENTS").alias("rel"), F.lit("Module").alias("src_label"), D.text("n_nationkey").alias("src"), F.lit("Spec").alias("dst_label"), D.text("n_regionkey").alias("dst"))
    b = D.table(spark, sf, "supplier").select(F.lit("DEFINES").alias("rel"), F.lit("Module").alias("src_label"), D.text("s_nationkey").alias("src"), F.lit("Function").alias("dst_label"), F.concat(F.lit("s"), D.text("s_suppkey")).alias("dst"))
    part = D.functions(spark, sf).select(F.lit("Function").alias("label"), F.concat(F.lit("p"), "id").alias("id"), F.col("name").alias("display"))
    c = D.calls(spark, sf).select(F.lit("CALLS").alias("rel"), F.lit("Function").alias("src_label"), F.concat(F.lit("p"), "src").alias("src"), F.lit("Function").alias("dst_label"), F.concat(F.lit("p"), "dst").alias("dst"))
    return region.unionByName(nation).unionByName(supplier).unionByName(part), a.unionByName(b).unionByName(c)


def join14_neighbourhood(spark, sf):
    return traverse.neighbourhood(*_heterogeneous(spark, sf), "s1", 3)


def ga01_god_nodes(spark, sf):
    nodes, edges = _heterogeneous(spark, sf)
    return rank.god_nodes(nodes, edges, 10, 0.85, ROUNDS).select("label", "id", "display", F.round("rank", 9).alias("rank"))


def ga01_pagerank(spark, sf):
    r = rank.pagerank(D.functions(spark, sf), D.calls(spark, sf), 0.85, ROUNDS)
    return r.select("id", F.round("rank", 9).alias("rank"))


def ga02_communities(spark, sf):
    return rank.communities(D.functions(spark, sf), D.calls(spark, sf))


def ga03_related(spark, sf):
    nodes, edges = _heterogeneous(spark, sf)
    return rank.related(nodes, edges, "s1", 2, 10, ROUNDS).select("label", "id", "display", F.round("rank", 9).alias("rank"))


def _scopes(spark, sf):
    """Lines of a part are scopes over days: from the ship date on, as many days as the quantity."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    line = D.table(spark, sf, "lineitem")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return line.select(D.text("l_partkey").alias("file"), F.concat(D.text("l_orderkey"), F.lit("-"), D.text("l_linenumber")).alias("id"), day.alias("start"), (day + F.col("l_quantity").cast("int")).alias("end"), key.alias("ordinal"))


_SCOPES = """scopes AS (SELECT CAST(l_partkey AS VARCHAR) AS file, concat(l_orderkey, '-', l_linenumber) AS id, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS "start",
  date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INTEGER) AS "end", l_orderkey * 10 + l_linenumber AS ordinal FROM lineitem)"""


def join15_containment(spark, sf):
    """How many scopes of the same file strictly contain each."""
    s = _scopes(spark, sf)
    return ranges.containing(s, s.select("file", "start", "end")).groupBy("file").agg(F.count("*").alias("pairs"), F.sum((F.col("e") - F.col("s")).cast("long")).alias("extent"))


def join16_smallest_containing(spark, sf):
    s = _scopes(spark, sf)
    sites = s.select(F.concat(F.col("id"), F.lit("?")).alias("site"), "file", F.col("start"), F.col("start").alias("end")).distinct()
    found = ranges.smallest_containing(sites, s.groupBy("file", "start", "end").agg(F.min("ordinal").alias("ordinal"), F.min("id").alias("id")))
    return found.select("site", "file", "scope_id")


def join20_overlap(spark, sf):
    a = D.functions(spark, sf).select("file")
    b = D.table(spark, sf, "supplier").select(F.concat(F.lit("Brand#"), (F.col("s_nationkey") + 11).cast("string")).alias("file"))
    return ranges.overlap(a, b)


_UP = """SELECT id, name, file FROM functions WHERE id IN (SELECT id FROM walk WHERE d > 0)"""


def _walk(direction: str, depth: int) -> str:
    a, b = ("src", "dst") if direction == "in" else ("dst", "src")
    return f"walk(id, d) AS (SELECT id, 0 FROM functions WHERE name = {D.SEED} UNION SELECT c.{a}, w.d + 1 FROM walk w JOIN calls c ON c.{b} = w.id WHERE w.d < {depth})"


def _chain_sql() -> str:
    part = lambda d, how: f"SELECT id, name, file, '{how}' AS direction FROM functions WHERE id IN (SELECT id FROM {d} WHERE d > 0)"
    walks = f"{_walk('in', DEPTH).replace('walk', 'up')}, {_walk('out', DEPTH).replace('walk', 'down')}"
    return f"WITH RECURSIVE {D.FUNCTIONS}, {D.CALLS}, {walks} {part('up', 'callers')} UNION ALL {part('down', 'callees')}"


def _pagerank_sql(vertices: str, edges: str, rounds: int, select: str) -> str:
    """Unrolled, as each round needs the sum over dangling vertices."""
    parts = [vertices, edges, "deg AS (SELECT src, count(*) AS degree FROM e GROUP BY src)", "n AS (SELECT count(*)::DOUBLE AS n FROM v)", "r0 AS (SELECT id, 1.0 / n AS rank FROM v, n)"]
    for k in range(rounds):
        parts.append(f"l{k} AS (SELECT coalesce(sum(rank), 0) AS lost FROM r{k} WHERE id NOT IN (SELECT src FROM deg))")
        parts.append(f"g{k} AS (SELECT e.dst AS id, sum(r.rank / degree) AS got FROM e JOIN r{k} r ON r.id = e.src JOIN deg d ON d.src = e.src GROUP BY e.dst)")
        parts.append(f"r{k + 1} AS MATERIALIZED (SELECT v.id, (1 - 0.85::DOUBLE) / n + 0.85::DOUBLE * (coalesce(got, 0) + lost / n) AS rank FROM v LEFT JOIN g{k} USING (id), l{k}, n)")
    return f"WITH {', '.join(parts)} {select}"


_NODES = f"""{D.FUNCTIONS}, {D.CALLS}, nodes AS (SELECT 'Spec' AS label, CAST(r_regionkey AS VARCHAR) AS id, r_name AS display FROM region UNION ALL SELECT 'Module', CAST(n_nationkey AS VARCHAR), n_name FROM nation
  UNION ALL SELECT 'Function', concat('s', s_suppkey), s_name FROM supplier UNION ALL SELECT 'Function', concat('p', id), name FROM functions),
edges AS (SELECT concat('Module', n_nationkey) AS src, concat('Spec', n_regionkey) AS dst FROM nation UNION ALL SELECT concat('Module', s_nationkey), concat('Functions', s_suppkey) FROM supplier
  UNION ALL SELECT concat('Functionp', src), concat('Functionp', dst) FROM calls),
both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"""
_NEAR = "near(k, d) AS (SELECT concat(label, id), 0 FROM nodes WHERE id = 's1' UNION SELECT b.dst, near.d + 1 FROM near JOIN both_ways b ON b.src = near.k WHERE near.d < {})"
_IMPLEMENTS = "implements AS (SELECT DISTINCT f.file AS src, CAST(l_suppkey AS VARCHAR) AS dst FROM lineitem JOIN functions f ON f.id = CAST(l_partkey AS VARCHAR))"
_CHAIN = f"""walk(id, d) AS (SELECT DISTINCT src, 0 FROM impacts WHERE dst = '{D.SPEC}' UNION SELECT s.src, w.d + 1 FROM walk w JOIN supersedes s ON s.dst = w.id WHERE w.d < 3)"""
_IMPACT = f"SELECT d.id, d.title, CASE WHEN min(w.d) = 0 THEN 'direct' ELSE 'supersedes' END AS via FROM walk w JOIN decisions d ON d.id = w.id GROUP BY d.id, d.title"

SQL = {
    "join01_resolve_local": f"WITH {D.RAW_CALLS} SELECT file, count(*) AS n, min(to_id) AS first_target, max(to_id) AS last_target FROM resolved WHERE outcome = 'local' GROUP BY file",
    "join02_resolve_global": f"WITH {D.RAW_CALLS} SELECT file, outcome, count(*) AS n, count(DISTINCT to_id) AS targets FROM resolved GROUP BY file, outcome",
    "join03_global_index": f"WITH {D.RAW_CALLS} SELECT name, candidates, only_id FROM anywhere",
    "ext08_bare_names": f"WITH {D.RAW_CALLS} SELECT file, name, id FROM names",
    "agg01_call_edges": f"WITH {D.RAW_CALLS} SELECT from_id AS src, to_id AS dst, count(*) AS call_count, min(CASE WHEN outcome = 'local' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END) AS confidence, 'tree-sitter' AS provider FROM resolved WHERE to_id IS NOT NULL AND to_id <> from_id GROUP BY from_id, to_id",
    "agg02_project_counts": f"WITH {D.RAW_CALLS} SELECT count(*) AS call_sites, count(*) FILTER (outcome = 'local') AS local_calls, count(*) FILTER (outcome = 'global') AS global_calls, count(*) FILTER (outcome = 'ambiguous') AS ambiguous, count(*) FILTER (outcome = 'unresolved') AS unresolved FROM resolved",
    "join24_coverage": f"""WITH {D.RAW_CALLS}, candidates AS (SELECT DISTINCT n.id FROM names n JOIN raw_calls r ON r.callee = n.name AND r.file <> n.file),
  crossing AS (SELECT DISTINCT to_id AS id FROM resolved r JOIN functions a ON a.id = r.from_id JOIN functions b ON b.id = r.to_id WHERE a.file <> b.file)
  SELECT count(*) AS candidates, count(c.id) AS covered, round(count(c.id) * 100.0::DOUBLE / nullif(count(*), 0), 6) AS coverage FROM candidates k LEFT JOIN crossing c USING (id)""",
    "join04_callers": f"WITH RECURSIVE {D.FUNCTIONS}, {D.CALLS}, {_walk('in', DEPTH)} {_UP}",
    "join05_callees": f"WITH RECURSIVE {D.FUNCTIONS}, {D.CALLS}, {_walk('out', DEPTH)} {_UP}",
    "join06_call_chain": _chain_sql(),
    "join07_definition_files": f"SELECT DISTINCT p_brand AS file FROM part WHERE p_name = {D.SEED}",
    "join08_implementers": f"WITH {D.FUNCTIONS}, {_IMPLEMENTS} SELECT i.src AS module, string_agg(f.name, ',' ORDER BY f.name) AS functions FROM implements i JOIN functions f ON f.file = i.src WHERE i.dst = '{D.SPEC}' GROUP BY i.src",
    "join09_implemented_specs": f"WITH {D.FUNCTIONS}, {_IMPLEMENTS} SELECT dst AS id FROM implements WHERE src = (SELECT min(file) FROM functions)",
    "join10_impact_direct": f"WITH {D.KNOWLEDGE} SELECT src AS id FROM impacts WHERE dst = '{D.SPEC}'",
    "join11_impact_chained": f"WITH RECURSIVE {D.KNOWLEDGE}, {_CHAIN} SELECT DISTINCT id FROM walk WHERE d > 0",
    "join12_impact_analysis": f"WITH RECURSIVE {D.KNOWLEDGE}, {_CHAIN} {_IMPACT}",
    "join13_ranked_impact": f"WITH RECURSIVE {D.KNOWLEDGE}, {_CHAIN}, found AS ({_IMPACT}) SELECT f.id, f.title, coalesce(d.confidence, 0) AS confidence, f.via FROM found f JOIN decisions d USING (id)",
    "join14_neighbourhood": f"WITH RECURSIVE {_NODES}, {_NEAR.format(3)} SELECT label, id FROM nodes WHERE concat(label, id) IN (SELECT k FROM near)",
    "ga01_god_nodes": _pagerank_sql(f"{_NODES}, v AS (SELECT concat(label, id) AS id FROM nodes)", "e AS (SELECT DISTINCT src, dst FROM edges)", ROUNDS, f"SELECT label, nodes.id, display, round(rank, 9) AS rank FROM nodes JOIN r{ROUNDS} r ON r.id = concat(label, nodes.id) ORDER BY r.rank DESC, label, nodes.id LIMIT 10"),
    "ga01_pagerank": _pagerank_sql(f"{D.FUNCTIONS}, {D.CALLS}, v AS (SELECT id FROM functions)", "e AS (SELECT src, dst FROM calls)", ROUNDS, f"SELECT id, round(rank, 9) AS rank FROM r{ROUNDS}"),
    "ga03_related": "WITH RECURSIVE" + _pagerank_sql(f"{_NODES}, {_NEAR.format(2)}, v AS (SELECT DISTINCT k AS id FROM near)", "e AS (SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT k FROM near) AND dst IN (SELECT k FROM near))", ROUNDS, f"SELECT label, nodes.id, display, round(rank, 9) AS rank FROM nodes JOIN r{ROUNDS} r ON r.id = concat(label, nodes.id) WHERE nodes.id <> 's1' ORDER BY r.rank DESC, label, nodes.id LIMIT 10")[4:],
    "join15_containment": f"WITH {_SCOPES} SELECT s.file, count(*) AS pairs, CAST(sum(o.\"end\" - o.\"start\") AS BIGINT) AS extent FROM scopes s JOIN scopes o ON o.file = s.file AND o.\"start\" <= s.\"start\" AND o.\"end\" >= s.\"end\" AND o.\"end\" - o.\"start\" > s.\"end\" - s.\"start\" GROUP BY s.file",
    "join16_smallest_containing": f"""WITH {_SCOPES}, sites AS (SELECT DISTINCT concat(id, '?') AS site, file, "start" FROM scopes), one AS (SELECT file, "start", "end", min(ordinal) AS ordinal, min(id) AS id FROM scopes GROUP BY 1, 2, 3)
  SELECT site, file, scope_id FROM (SELECT i.site, i.file, s.id AS scope_id, row_number() OVER (PARTITION BY i.site, i.file, i."start" ORDER BY s."end" - s."start", s.ordinal) AS n FROM sites i JOIN one s ON s.file = i.file AND s."start" <= i."start" AND s."end" >= i."start") WHERE n = 1""",
    "join20_overlap": f"WITH {D.FUNCTIONS} SELECT DISTINCT file FROM functions WHERE file IN (SELECT concat('Brand#', s_nationkey + 11) FROM supplier)",
}

QUERIES = {f.__name__: f for f in (
    join01_resolve_local, join02_resolve_global, join03_global_index, ext08_bare_names, agg01_call_edges, agg02_project_counts, join24_coverage, join04_callers, join05_callees, join06_call_chain,
    join07_definition_files, join08_implementers, join09_implemented_specs, join10_impact_direct, join11_impact_chained, join12_impact_analysis, join13_ranked_impact, join14_neighbourhood,
    ga01_god_nodes, ga01_pagerank, ga02_communities, ga03_related, join15_containment, join16_smallest_containing, join20_overlap,
)}
