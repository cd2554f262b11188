"""Scalar functions, knowledge parsing, writers, feedback and health: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..lineage import cut, spread
from ..operators import feedback, health, knowledge, merge, ranges, resolve
from ..sources import symbols
from ..streaming.feedback import evolved
from . import driver as D
from .driver import table


def _docs(spark, sf):
    """A markdown document per row, its text behind a heading and references: specs, every third one a decision, every seventh without front matter, every eleventh nameless."""
    d = spread(table(spark, sf, "documents"))  # the patterns take far longer than moving the texts
    n = D.text("doc_id")
    kind = F.when(F.col("doc_id") % 3 == 0, "DEC-").otherwise("SPEC-")
    refs = F.concat(F.lit("[["), F.lit("DEC-"), (F.col("doc_id") % 20).cast("string"), F.lit("]] and [[ SPEC-"), (F.col("doc_id") % 30).cast("string"), F.lit(" ]]\n"))
    front = F.concat(F.lit("---\nid: "), kind, n, F.lit('\ntitle: "About '), n, F.lit('"\nstatus: '), F.col("lang"), F.lit("\ndate: '2024-01-0"), (F.col("n_chars") % 9 + 1).cast("string"), F.lit("'\nrelated: [dec-"), (F.col("n_chars") % 50).cast("string"), F.lit(", SPEC-"), (F.col("doc_id") + 1).cast("string"), F.lit("]\n---\n"))
    whole = F.concat(refs, F.coalesce("text", F.lit("")))
    content = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("# Heading "), n, F.lit("\n"), whole)).otherwise(F.concat(front, F.lit("text\n"), whole))
    fallback = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("docs/REQ-"), n, F.lit(".md"))).otherwise(F.concat(F.lit("docs/"), kind, n, F.lit("-x.md")))
    return d.select(content.alias("content"), fallback.alias("fallback_id"), F.col("doc_id").alias("ordinal"))


_DOCS = """docs AS (SELECT doc_id AS ordinal, CASE WHEN doc_id % 3 = 0 THEN 'DEC-' ELSE 'SPEC-' END AS p, doc_id % 7 = 0 AS bare,
  concat('[[DEC-', doc_id % 20, ']] and [[ SPEC-', doc_id % 30, ' ]]', chr(10), coalesce(text, '')) AS refs, lang, n_chars, doc_id FROM documents),
content AS (SELECT ordinal, CASE WHEN bare THEN concat('# Heading ', doc_id, chr(10), refs) ELSE concat('---', chr(10), 'id: ', p, doc_id, chr(10), 'title: "About ', doc_id, '"', chr(10), 'status: ', lang, chr(10),
  'date: ''2024-01-0', n_chars % 9 + 1, '''', chr(10), 'related: [dec-', n_chars % 50, ', SPEC-', doc_id + 1, ']', chr(10), '---', chr(10), 'text', chr(10), refs) END AS content,
  CASE WHEN doc_id % 11 = 0 THEN concat('docs/REQ-', doc_id, '.md') ELSE concat('docs/', p, doc_id, '-x.md') END AS fallback_id FROM docs),
split AS (SELECT *, regexp_extract(content, '(?s)^---\\r?\\n(.*?)\\r?\\n---\\r?\\n?(.*)$', 1) AS front, CASE WHEN starts_with(content, '---') THEN regexp_extract(content, '(?s)^---\\r?\\n(.*?)\\r?\\n---\\r?\\n?(.*)$', 2) ELSE content END AS body FROM content),
fields AS (SELECT *, nullif(trim(regexp_extract(front, '(?m)^id\\s*:\\s*(.*)$', 1)), '') AS f_id, nullif(trim(regexp_extract(front, '(?m)^title\\s*:\\s*(.*)$', 1), '"'), '') AS f_title,
  nullif(regexp_extract(front, '(?m)^status\\s*:\\s*(.*)$', 1), '') AS f_status, nullif(trim(regexp_extract(front, '(?m)^date\\s*:\\s*(.*)$', 1), ''''), '') AS f_date,
  regexp_extract(front, '(?m)^related\\s*:\\s*(.*)$', 1) AS f_related, nullif(regexp_extract(body, '(?m)^#\\s+(.+)$', 1), '') AS heading FROM split),
named AS (SELECT *, coalesce(f_id, nullif(regexp_extract(fallback_id, '(?:SPEC|DEC)-[0-9]+'), '')) AS raw_id FROM fields),
parsed AS (SELECT ordinal, fallback_id, raw_id AS id, heading, f_title, f_status, f_date,
  list_concat(regexp_extract_all(body, '(?:SPEC|DEC)-[0-9]+'), list_transform(regexp_extract_all(f_related, '(?i)(?:SPEC|DEC)-[0-9]+'), lambda x: upper(x))) AS all_refs FROM named),
refs AS (SELECT DISTINCT ordinal, id, ref FROM (SELECT ordinal, id, unnest(all_refs) AS ref FROM parsed WHERE id IS NOT NULL) WHERE ref <> id),
typed AS (SELECT *, CASE WHEN id LIKE 'SPEC%' THEN 'Spec' ELSE 'Decision' END AS a, CASE WHEN ref LIKE 'SPEC%' THEN 'Spec' ELSE 'Decision' END AS b FROM refs),
edges AS (SELECT CASE WHEN a <> b THEN 'IMPACTS' WHEN a = 'Decision' THEN 'SUPERSEDES' ELSE 'RELATES' END AS rel, CASE WHEN a = 'Spec' AND b = 'Decision' THEN ref ELSE id END AS src, CASE WHEN a = 'Spec' AND b = 'Decision' THEN id ELSE ref END AS dst FROM typed),
nodes AS (SELECT id, CASE WHEN id LIKE 'SPEC%' THEN 'Spec' ELSE 'Decision' END AS label, coalesce(f_title, heading, id) AS title, CASE WHEN id LIKE 'SPEC%' THEN coalesce(f_status, 'unknown') END AS status,
  CASE WHEN id NOT LIKE 'SPEC%' THEN coalesce(f_date, '') END AS "date", 1.0::DOUBLE AS confidence, 'declared' AS origin FROM parsed WHERE id IS NOT NULL
  UNION ALL SELECT DISTINCT ref, CASE WHEN ref LIKE 'SPEC%' THEN 'Spec' ELSE 'Decision' END, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), 'referenced' FROM refs WHERE ref NOT IN (SELECT id FROM parsed WHERE id IS NOT NULL))"""


def _parsed(spark, sf):
    """Parsed once, as nodes and counts read it several times."""
    return cut(knowledge.parse_documents(_docs(spark, sf)), "parsed")


def src07_knowledge_nodes(spark, sf):
    return knowledge.nodes(_parsed(spark, sf))


def sf10_knowledge_edges(spark, sf):
    return knowledge.edges(_parsed(spark, sf))


def sf09_parse_knowledge(spark, sf):
    return knowledge.parse_documents(_docs(spark, sf)).select("ordinal", "id", "kind", F.size("refs").alias("n_refs"), F.array_join(F.array_sort("refs"), ",").alias("refs"))


def agg11_knowledge_counts(spark, sf):
    return knowledge.counts(_parsed(spark, sf))


def join25_stubs(spark, sf):
    return knowledge.nodes(_parsed(spark, sf)).where("origin = 'referenced'").select("id", "label")


def agg07_unresolved_clusters(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("a/"), F.upper("lang"), F.lit("_R-"), D.text("doc_id"), F.lit(".md")).alias("fallback_id"), F.col("doc_id").alias("ordinal"))
    return knowledge.unresolved_clusters(d).select("prefix", "n", F.array_join("samples", ",").alias("samples"))


def src06_markdown_nodes(spark, sf):
    return knowledge.markdown_docs(_docs(spark, sf))[0].select("id", "title", "status")


def src06_markdown_edges(spark, sf):
    return knowledge.markdown_docs(_docs(spark, sf))[1]


def sf01_front_matter(spark, sf):
    fields, body = T.front_matter(F.col("content"))
    return _docs(spark, sf).select("ordinal", F.try_element_at(fields, F.lit("id")).alias("id"), F.try_element_at(fields, F.lit("title")).alias("title"), F.size(fields).alias("n_fields"), F.length(body).alias("body_length"))


def sf02_extract_refs(spark, sf):
    _, body = T.front_matter(F.col("content"))
    return _docs(spark, sf).select("ordinal", F.array_join(T.link_refs(body), "|").alias("refs"))


def sf03_first_heading(spark, sf):
    return _docs(spark, sf).select("ordinal", T.first_heading(F.col("content")).alias("heading"))


def _after_text(spark, sf, said):
    """Each document's whole text with a remark behind it."""
    return table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), said).alias("raw"))


def sf04_classify_ref(spark, sf):
    ref = T.classify_ref(F.col("raw"))
    return _after_text(spark, sf, F.concat(F.lit(" see x"), F.col("source"), F.lit(" spec-"), D.text("doc_id"), F.lit(" adr-7"))).select("doc_id", ref.alias("ref"), T.ref_kind(ref).alias("kind"))


def sf05_ref_ids(spark, sf):
    said = F.concat(F.lit(" dec-"), (F.col("doc_id") % 9).cast("string"), F.lit(", SPEC-"), D.text("doc_id"), F.lit(" and MYSPEC-5 and DEC-"), (F.col("doc_id") % 9).cast("string"))
    return _after_text(spark, sf, said).select("doc_id", F.array_join(F.array_sort(T.ref_ids(F.col("raw"))), ",").alias("refs"))


def sf06_implements(spark, sf):
    word = F.when(F.col("doc_id") % 4 == 0, "implements").when(F.col("doc_id") % 4 == 1, "@spec").when(F.col("doc_id") % 4 == 2, "see").otherwise("@specification")
    said = F.concat(F.lit(" // "), word, F.lit(" SPEC-"), D.text("doc_id"), F.lit(" DEC-1"))
    return _after_text(spark, sf, said).select("doc_id", F.array_join(F.array_sort(T.implemented_specs(F.col("raw"))), ",").alias("specs"))


def _symbols(spark, sf):
    """A symbol for each part: a method, a type or a field of its brand's module."""
    rest = F.when(F.col("p_partkey") % 3 == 0, "m().").when(F.col("p_partkey") % 3 == 1, "").otherwise("f.")
    return table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("file"), F.concat(F.lit("index npm pkg 1.0 `"), "p_brand", F.lit("`/C"), D.text("p_partkey"), F.lit("#"), rest).alias("symbol"))


def sf20_symbols(spark, sf):
    kind, name = symbols.symbol_kind("symbol"), symbols.symbol_name("symbol")
    return _symbols(spark, sf).select("p_partkey", kind.alias("kind"), name.alias("name"), symbols.canonical_id(F.col("file"), kind, name).alias("id"))


def sf12_last_segment(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.last_segment(F.translate("url", "-", "\\")).alias("segment"))


def sf14_module_path(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.module_path(F.concat(F.lit(".\\/"), "url")).alias("path"))


def sf15_dir_of(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.dir_of(F.col("url")).alias("dir"))


def sf16_file_of(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.file_of(F.concat("p_brand", F.lit("#"), "p_name", F.lit("#x"))).alias("file"))


def sf17_failure_reason(spark, sf):
    return D.health(spark, sf).where("failed is not null").select("ordinal", T.failure_reason(F.col("failed")).alias("reason"))


def sf22_feedback_mapping(spark, sf):
    return feedback.signals(D.feedback_events(spark, sf)).groupBy(F.round("delta", 6).alias("delta")).agg(F.count("*").alias("n"))


def src03_detect_language(spark, sf):
    ends = F.array(*[F.lit(x) for x in (".TS", ".tsx", ".py", ".go", ".java", ".kt", ".rs", ".h", ".rb", ".php", ".dart", ".cs", ".mjs")])
    path = F.concat(F.lit("a/b"), F.element_at(ends, (F.col("doc_id") % 13 + 1).cast("int")))
    return table(spark, sf, "documents").select("doc_id", T.language_of(path).alias("language"))


def w13_branch_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.branch_name(F.col("url")).alias("name"))


def hard05_utf16_length(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.utf16_length(F.concat("text", F.lit("\U0001f600"))).alias("units"))


def _stored(spark, sf):
    p = table(spark, sf, "part")
    provider = F.when(F.col("p_partkey") % 6 == 0, "scip").when(F.col("p_partkey") % 10 == 0, F.lit(None).cast("string")).otherwise("tree-sitter")
    return p.select(D.text("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_size").cast("long").alias("start_line"), F.when(F.col("p_partkey") % 14 > 0, (F.col("p_partkey") % 10) / 10).alias("confidence"), provider.alias("provider"))


def _batch(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        D.text("p_partkey").alias("id"), F.concat("p_name", F.lit("!")).alias("name"), F.col("p_brand").alias("file"), F.lit(1).cast("long").alias("start_line"), F.lit(0.5).alias("confidence"),
        F.when(F.col("p_partkey") % 4 == 0, "scip").otherwise("tree-sitter").alias("provider"), F.lit(0).alias("ordinal"),
        F.array(*[F.lit(c) for c in ("name", "file", "confidence", "provider")]).alias("present"),
    )


def w02_merge_nodes(spark, sf):
    return merge.upsert_nodes(_stored(spark, sf), _batch(spark, sf))


_STORED = """stored AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_brand AS file, CAST(p_size AS BIGINT) AS start_line, CASE WHEN p_partkey % 14 > 0 THEN (p_partkey % 10) / 10.0::DOUBLE END AS confidence,
  CASE WHEN p_partkey % 6 = 0 THEN 'scip' WHEN p_partkey % 10 = 0 THEN NULL ELSE 'tree-sitter' END AS provider FROM part),
batch AS (SELECT CAST(p_partkey AS VARCHAR) AS id, concat(p_name, '!') AS name, p_brand AS file, 0.5::DOUBLE AS confidence, CASE WHEN p_partkey % 4 = 0 THEN 'scip' ELSE 'tree-sitter' END AS provider FROM part),
judged AS (SELECT coalesce(s.id, b.id) AS id, s.name AS n0, s.file AS f0, s.start_line, s.confidence AS c0, s.provider AS p0, b.name AS n1, b.file AS f1, b.confidence AS c1, b.provider AS p1, s.id IS NULL AS fresh,
  b.id IS NOT NULL AND (s.id IS NULL OR coalesce(s.provider = b.provider, false) OR coalesce(b.confidence > s.confidence, false)) AS w FROM stored s FULL JOIN batch b ON s.id = b.id)"""


def w03_merge_edges(spark, sf):
    """All calls, stored by the extractor and written again by the index with another count; edges without both ends are told by a test."""
    stored = D.calls(spark, sf).select("src", "dst", "call_count", F.lit(0.8).alias("confidence"), F.when(F.col("call_count") % 2 == 0, "scip").otherwise("tree-sitter").alias("provider"))
    batch = D.calls(spark, sf).select("src", "dst", (F.col("call_count") + 100).alias("call_count"), F.when(F.col("dst") > F.col("src"), 0.9).otherwise(0.5).alias("confidence"), F.lit("scip").alias("provider"), F.lit(0).alias("ordinal"), F.array(*[F.lit(c) for c in ("call_count", "confidence", "provider")]).alias("present"))
    parts = D.functions(spark, sf)
    return merge.upsert_edges(stored, batch, parts, parts)


def w05_origin(spark, sf):
    """All suppliers as stored specs, written again by every order line that names them, as declared, annotated or referenced."""
    ranked = lambda c: F.element_at(F.array(F.lit("referenced"), F.lit("annotated"), F.lit("declared")), (c % 3 + 1).cast("int"))
    stored = table(spark, sf, "supplier").select(D.text("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.lit("open").alias("status"), F.lit(0.5).alias("confidence"), F.when(F.col("s_suppkey") % 4 > 0, ranked(F.col("s_suppkey"))).alias("origin"))
    lines = table(spark, sf, "lineitem")
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    present = F.array(*[F.lit(c) for c in ("title", "origin")])
    batch = lines.select(D.text("l_suppkey").alias("id"), F.concat(F.lit("t"), seq.cast("string")).alias("title"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("double").alias("confidence"), ranked(F.col("l_orderkey") % 7 % 3).alias("origin"), seq.alias("ordinal"), present.alias("present"))
    return merge.upsert_nodes(stored, batch)


def sf26_graph_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.graph_name(F.col("url")).alias("name"))


def ext04_qualify(spark, sf):
    """Functions of a part's file: an order line spans the days from its ship date on; ids name the scopes around."""
    start = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    seq = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal")
    kind = F.when(F.col("l_linenumber") == 1, "class").otherwise("function").alias("kind")
    lines = table(spark, sf, "lineitem").select(D.text("l_partkey").alias("file"), kind, F.concat(F.lit("f"), seq.cast("string")).alias("name"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"), seq)
    return ranges.qualify(lines).select("ordinal", "id")


def w06_migration(spark, sf):
    from ..schema import struct

    return merge.with_declared_columns(_stored(spark, sf).drop("confidence"), struct("Function"))


def agg10_pending(spark, sf):
    return merge.pending_migrations({"Function": _stored(spark, sf), "Other": _batch(spark, sf)})


def w14_orphans(spark, sf):
    """Documents that no label mentions: the set difference that garbage collection uses."""
    a = table(spark, sf, "documents").select(F.col("doc_id").alias("key"))
    b = table(spark, sf, "labels").select(F.col("doc_id").alias("key"))
    return a.join(b, "key", "left_anti")


def sage01_apply_feedback(spark, sf):
    return feedback.apply_feedback(D.judged_nodes(spark, sf), D.feedback_events(spark, sf)).withColumn("confidence", F.round("confidence", 9))


def sage02_feedback_trace(spark, sf):
    t = feedback.feedback_trace(D.judged_nodes(spark, sf), D.feedback_events(spark, sf))
    return t.select("node_id", F.col("seq.event_id").alias("event_id"), F.round("before", 9).alias("before"), F.round("after", 9).alias("after"))


def sage03_evolution(spark, sf):
    """The same as a stream that is read file by file."""
    stream = spark.readStream.schema(table(spark, sf, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/events.parque[t]")  # a pattern, as the table may be one file
    return evolved(D.judged_nodes(spark, sf), D.as_feedback(stream)).withColumn("confidence", F.round("confidence", 9))


def sage04_top_by_confidence(spark, sf):
    return feedback.top_by_confidence(D.judged_nodes(spark, sf), 25)


def agg04_health_summary(spark, sf):
    return health.summary(D.health(spark, sf))


def h03_blindspots(spark, sf):
    return health.blindspots(D.health(spark, sf)).select("path", "failed", "error_nodes")


def _result_files(spark, sf):
    """The files of an answer: those of all labelled documents."""
    return D.health(spark, sf).join(table(spark, sf, "labels").select(F.col("doc_id").alias("ordinal")), "ordinal", "left_semi").select(F.col("path").alias("file"))


def join22_touched(spark, sf):
    return health.touched_blindspots(D.health(spark, sf), _result_files(spark, sf)).select("path")


def h01_index_health(spark, sf):
    return health.index_health(D.health(spark, sf), _result_files(spark, sf)).select("files_indexed", "partial", "failed", "blindspots_total", "possibly_incomplete", F.array_join("blindspots", ",").alias("blindspots"))


def join21_healing(spark, sf):
    now = D.health(spark, sf)
    before = now.select("path", F.when(F.col("ordinal") % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("failed")).alias("failed"), F.when(F.col("ordinal") % 3 == 0, 0).otherwise(F.col("error_nodes") + F.when(F.col("ordinal") % 5 == 0, 1).otherwise(0)).alias("error_nodes"))
    return health.healing(before, now)


def agg05_signatures(spark, sf):
    return health.signature_buckets(D.health(spark, sf)).select("signature", "files", "language", F.array_join("samples", ",").alias("samples"))


def agg06_failures(spark, sf):
    return health.failure_buckets(D.health(spark, sf)).select("reason", "files", F.array_join("languages", ",").alias("languages"), F.array_join("samples", ",").alias("samples"))


def agg03_skipped_languages(spark, sf):
    return resolve.skipped_languages(D.health(spark, sf), ["en", "fr"])


def set02_relation_union(spark, sf):
    a = D.impacts(spark, sf).withColumn("rel", F.lit("IMPACTS"))
    b = D.supersedes(spark, sf).withColumn("rel", F.lit("SUPERSEDES"))
    c = D.calls(spark, sf).select("src", "dst").withColumn("rel", F.lit("CALLS"))
    return a.unionByName(b).unionByName(c).groupBy("rel").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"))


_T = f"{D.HEALTH}, dirs AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM health WHERE ordinal IN (SELECT doc_id FROM labels)), bad AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM health WHERE failed IS NOT NULL OR error_nodes > 0), touched AS (SELECT DISTINCT path FROM bad b WHERE EXISTS (SELECT 1 FROM dirs d WHERE d.dir = b.dir OR (d.dir <> '' AND b.dir <> '' AND (starts_with(b.dir, d.dir || '/') OR starts_with(d.dir, b.dir || '/')))))"

_ID = "(?i)(?:^|[^A-Za-z0-9_])((?:XSPEC|SPEC|XADR|ADR|DEC)-[0-9]+)"

SQL = {
    "src07_knowledge_nodes": f'WITH {_DOCS} SELECT id, label, title, status, "date", confidence, origin FROM nodes',
    "sf10_knowledge_edges": f"WITH {_DOCS} SELECT rel, src, dst FROM edges",
    "sf09_parse_knowledge": f"WITH {_DOCS} SELECT p.ordinal, p.id, CASE WHEN p.id LIKE 'SPEC%' THEN 'Spec' WHEN p.id IS NOT NULL THEN 'Decision' END AS kind, CASE WHEN p.id IS NOT NULL THEN CAST(count(r.ref) AS INTEGER) END AS n_refs, CASE WHEN p.id IS NOT NULL THEN coalesce(string_agg(r.ref, ',' ORDER BY r.ref), '') END AS refs FROM parsed p LEFT JOIN refs r ON r.ordinal = p.ordinal GROUP BY p.ordinal, p.id",
    "agg11_knowledge_counts": f"WITH {_DOCS} SELECT (SELECT count(*) FROM nodes WHERE label = 'Spec') AS specs, (SELECT count(*) FROM nodes WHERE label = 'Decision') AS decisions, (SELECT count(*) FROM edges WHERE rel = 'IMPACTS') AS impacts, (SELECT count(*) FROM edges WHERE rel = 'SUPERSEDES') AS supersedes, (SELECT count(*) FROM edges WHERE rel = 'RELATES') AS relates, (SELECT count(*) FROM parsed) AS docs_scanned, (SELECT count(*) FROM parsed WHERE id IS NULL) AS docs_unresolved",
    "join25_stubs": f"WITH {_DOCS} SELECT id, label FROM nodes WHERE origin = 'referenced'",
    "agg07_unresolved_clusters": "SELECT concat(upper(lang), '_R') AS prefix, count(*) AS n, array_to_string(list_slice(list(concat('a/', upper(lang), '_R-', doc_id, '.md') ORDER BY doc_id), 1, 3), ',') AS samples FROM documents GROUP BY lang HAVING count(*) >= 3 ORDER BY n DESC, prefix LIMIT 3",
    "src06_markdown_nodes": f"WITH {_DOCS} SELECT coalesce(f_id, fallback_id) AS id, coalesce(f_title, heading, f_id, fallback_id) AS title, f_status AS status FROM fields",
    "src06_markdown_edges": f"WITH {_DOCS} SELECT DISTINCT src, dst FROM (SELECT coalesce(f_id, fallback_id) AS src, trim(unnest(regexp_extract_all(body, '\\[\\[([^\\]]+)\\]\\]', 1))) AS dst FROM fields) WHERE src <> dst",
    "sf01_front_matter": f"WITH {_DOCS} SELECT ordinal, f_id AS id, f_title AS title, CASE WHEN front = '' THEN 0 ELSE 5 END::INTEGER AS n_fields, CAST(length(body) AS INTEGER) AS body_length FROM fields",
    "sf02_extract_refs": f"WITH {_DOCS} SELECT ordinal, array_to_string(list_transform(regexp_extract_all(body, '\\[\\[([^\\]]+)\\]\\]', 1), lambda x: trim(x)), '|') AS refs FROM fields",
    "sf03_first_heading": f"WITH {_DOCS} SELECT ordinal, nullif(regexp_extract(content, '(?m)^#\\s+(.+)$', 1), '') AS heading FROM content",
    "sf04_classify_ref": f"WITH said AS (SELECT doc_id, upper(nullif(regexp_extract(concat(text, ' see x', source, ' spec-', doc_id, ' adr-7'), '{_ID}', 1), '')) AS ref FROM documents) SELECT doc_id, ref, CASE WHEN regexp_matches(ref, '^X?SPEC-') THEN 'Spec' WHEN ref IS NOT NULL THEN 'Decision' END AS kind FROM said",
    "sf05_ref_ids": f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(concat(text, ' dec-', doc_id % 9, ', SPEC-', doc_id, ' and MYSPEC-5 and DEC-', doc_id % 9), '{_ID}', 1), lambda x: upper(x)))), ',') AS refs FROM documents",
    "sf06_implements": f"""WITH said AS (SELECT doc_id, concat(text, ' // ', CASE doc_id % 4 WHEN 0 THEN 'implements' WHEN 1 THEN '@spec' WHEN 2 THEN 'see' ELSE '@specification' END, ' SPEC-', doc_id, ' DEC-1') AS raw FROM documents)
  SELECT doc_id, CASE WHEN regexp_matches(raw, '(?i)(?:^|[^A-Za-z0-9_])(?:implements|@spec)(?:[^A-Za-z0-9_]|$)|@implements(?:[^A-Za-z0-9_]|$)')
  THEN array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(raw, '{_ID}', 1), lambda x: upper(x)), lambda x: regexp_matches(x, '^X?SPEC-')))), ',') ELSE '' END AS specs FROM said""",
    "sf20_symbols": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'other' END AS kind, concat('C', p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '.m' ELSE '' END) AS name,
  concat(p_brand, CASE WHEN p_partkey % 3 = 1 THEN '#class:' ELSE '#' END, 'C', p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '.m' ELSE '' END) AS id FROM part""",
    "sf12_last_segment": "SELECT page_id, regexp_extract(translate(url, '-', chr(92)), '[^/\\\\]*$') AS segment FROM pages",
    "sf14_module_path": "SELECT page_id, regexp_replace(regexp_replace(replace(concat('.', chr(92), '/', url), chr(92), '/'), '^\\./', ''), '^/+', '') AS path FROM pages",
    "sf15_dir_of": "SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir FROM pages",
    "sf16_file_of": "SELECT p_partkey, split_part(concat(p_brand, '#', p_name, '#x'), '#', 1) AS file FROM part",
    "sf17_failure_reason": f"WITH {D.HEALTH} SELECT ordinal, 'cannot read ''<x>'' at line <n>' AS reason FROM health WHERE failed IS NOT NULL",
    "sf22_feedback_mapping": f"WITH {D.FEEDBACK} SELECT round(delta, 6) AS delta, count(*) AS n FROM deltas GROUP BY 1",
    "src03_detect_language": "SELECT doc_id, ['typescript','tsx','python','go','java','kotlin','rust','cpp','ruby','php','dart','csharp','javascript'][doc_id % 13 + 1] AS language FROM documents",
    "w13_branch_names": "SELECT page_id, concat(left(regexp_replace(url, '[^A-Za-z0-9._-]', '-', 'g'), 60), '-', left(sha1(url), 8)) AS name FROM pages",
    "hard05_utf16_length": "SELECT doc_id, CAST(length(text) + 2 + (SELECT count(*) FROM (SELECT unnest(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')))) AS BIGINT) AS units FROM documents",
    "w02_merge_nodes": f"WITH {_STORED} SELECT id, CASE WHEN w THEN n1 ELSE n0 END AS name, CASE WHEN w THEN f1 ELSE f0 END AS file, start_line, CASE WHEN w AND NOT (NOT fresh AND coalesce(p0 = p1, false) AND c0 IS NOT NULL) THEN c1 ELSE c0 END AS confidence, CASE WHEN w THEN p1 ELSE p0 END AS provider FROM judged",
    "w03_merge_edges": f"""WITH {D.CALLS}, judged AS (SELECT *, call_count % 2 = 0 OR dst > src AS w FROM calls)
  SELECT src, dst, CASE WHEN w THEN call_count + 100 ELSE call_count END AS call_count, CASE WHEN NOT w THEN 0.8::DOUBLE WHEN dst > src THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence, CASE WHEN w THEN 'scip' ELSE 'tree-sitter' END AS provider FROM judged""",
    "w05_origin": """WITH ranked AS (SELECT CAST(l_suppkey AS VARCHAR) AS id, l_orderkey * 10 + l_linenumber AS seq, l_orderkey % 7 % 3 AS r FROM lineitem),
  stored AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 3 ELSE -1 END AS r FROM supplier),
  best AS (SELECT id, max(r) AS r FROM ranked GROUP BY id), last AS (SELECT ranked.id, max(seq) AS seq FROM ranked JOIN best ON best.id = ranked.id AND best.r = ranked.r GROUP BY ranked.id)
  SELECT coalesce(s.id, b.id) AS id, CASE WHEN b.r >= coalesce(s.r, -1) THEN concat('t', seq) ELSE s_name END AS title, CASE WHEN s.id IS NOT NULL THEN 'open' END AS status, CASE WHEN s.id IS NOT NULL THEN 0.5::DOUBLE END AS confidence,
  CASE greatest(coalesce(b.r, -1), coalesce(s.r, -1)) WHEN 0 THEN 'referenced' WHEN 1 THEN 'annotated' WHEN 2 THEN 'declared' END AS origin
  FROM stored s FULL JOIN best b ON s.id = b.id LEFT JOIN last ON last.id = b.id""",
    "sf26_graph_names": "SELECT page_id, coalesce(nullif(left(regexp_replace(url, '[^A-Za-z0-9._-]', '-', 'g'), 80), ''), 'graph') AS name FROM pages",
    "ext04_qualify": """WITH d AS (SELECT CAST(l_partkey AS VARCHAR) AS file, CASE WHEN l_linenumber = 1 THEN 'class' ELSE 'function' END AS kind, l_orderkey * 10 + l_linenumber AS ordinal, concat('f', l_orderkey * 10 + l_linenumber) AS name,
  date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS s, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INTEGER) AS e FROM lineitem),
  around AS (SELECT d.file, d.ordinal, d.s, d.e, string_agg(o.name, '.' ORDER BY o.s, -o.e, o.ordinal) AS scopes FROM (SELECT DISTINCT * FROM d) d JOIN d o ON o.file = d.file AND o.s <= d.s AND o.e >= d.e AND o.e - o.s > d.e - d.s GROUP BY d.file, d.ordinal, d.s, d.e)
  SELECT d.ordinal, CASE WHEN kind = 'class' THEN concat(d.file, '#class:', name) ELSE concat(d.file, '#', coalesce(scopes || '.', ''), name) END AS id FROM d LEFT JOIN around a ON a.file = d.file AND a.ordinal = d.ordinal AND a.s = d.s AND a.e = d.e""",
    "w06_migration": f"WITH {_STORED} SELECT id, name, file, start_line, CAST(NULL AS DOUBLE) AS confidence, coalesce(provider, 'tree-sitter') AS provider FROM stored",
    "agg10_pending": f"WITH {_STORED} SELECT 'Function' AS \"table\", count(*) FILTER (provider IS NULL) AS pending FROM stored UNION ALL SELECT 'Other', 0",
    "w14_orphans": "SELECT doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "sage01_apply_feedback": f"""WITH {D.FEEDBACK}, lists AS (SELECT node_id, list(delta ORDER BY ts, event_id) AS d FROM deltas GROUP BY node_id)
  SELECT id, round(CASE WHEN d IS NULL THEN confidence ELSE list_reduce(d, lambda a, x: greatest(0.1::DOUBLE, least(1.0::DOUBLE, a + x)), coalesce(confidence, 0.5::DOUBLE)) END, 9) AS confidence FROM judged LEFT JOIN lists ON node_id = id""",
    "sage02_feedback_trace": f"""WITH {D.FEEDBACK}, prefixes AS (SELECT node_id, event_id, list(delta) OVER (PARTITION BY node_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS d FROM deltas),
  states AS (SELECT node_id, event_id, d, coalesce(confidence, 0.5::DOUBLE) AS start FROM prefixes JOIN judged ON id = node_id)
  SELECT node_id, event_id, round(CASE WHEN len(d) = 1 THEN start ELSE list_reduce(d[1:len(d) - 1], lambda a, x: greatest(0.1::DOUBLE, least(1.0::DOUBLE, a + x)), start) END, 9) AS before,
  round(list_reduce(d, lambda a, x: greatest(0.1::DOUBLE, least(1.0::DOUBLE, a + x)), start), 9) AS after FROM states""",
    "sage04_top_by_confidence": f"WITH {D.FEEDBACK} SELECT id, coalesce(confidence, 0) AS confidence FROM judged ORDER BY judged.confidence DESC NULLS LAST, id LIMIT 25",
    "agg04_health_summary": f"WITH {D.HEALTH} SELECT count(*) AS total, count(*) FILTER (failed IS NULL AND error_nodes = 0) AS clean, count(*) FILTER (failed IS NULL AND error_nodes > 0) AS partial, count(failed) AS failed FROM health",
    "h03_blindspots": f"WITH {D.HEALTH} SELECT path, failed, error_nodes FROM health WHERE failed IS NOT NULL OR error_nodes > 0",
    "join22_touched": f"WITH {_T} SELECT path FROM touched",
    "h01_index_health": f"WITH {_T} SELECT (SELECT count(*) FROM health) AS files_indexed, (SELECT count(*) FROM health WHERE failed IS NULL AND error_nodes > 0) AS partial, (SELECT count(failed) FROM health) AS failed, (SELECT count(*) FROM touched) AS blindspots_total, (SELECT count(*) > 0 FROM touched) AS possibly_incomplete, (SELECT string_agg(path, ',' ORDER BY path) FROM (SELECT path FROM touched ORDER BY path LIMIT 20)) AS blindspots",
    "join21_healing": f"""WITH {D.HEALTH}, runs AS (SELECT path, failed IS NULL AND error_nodes = 0 AS now, (ordinal % 4 = 0 OR failed IS NULL) AND (CASE WHEN ordinal % 3 = 0 THEN 0 ELSE error_nodes + CASE WHEN ordinal % 5 = 0 THEN 1 ELSE 0 END END) = 0 AS was FROM health)
  SELECT path, CASE WHEN now THEN 'healed' ELSE 'regressed' END AS change FROM runs WHERE was <> now""",
    "agg05_signatures": f"WITH {D.HEALTH}, each AS (SELECT path, language, ordinal, unnest(signatures) AS signature FROM health) SELECT signature, count(*) AS files, arg_min(language, ordinal) AS language, array_to_string(list_slice(list(path ORDER BY ordinal), 1, 5), ',') AS samples FROM each GROUP BY signature",
    "agg06_failures": f"WITH {D.HEALTH} SELECT 'cannot read ''<x>'' at line <n>' AS reason, count(*) AS files, (SELECT string_agg(language, ',' ORDER BY language) FROM (SELECT DISTINCT language FROM health WHERE failed IS NOT NULL)) AS languages, array_to_string(list_slice(list(path ORDER BY ordinal), 1, 5), ',') AS samples FROM health WHERE failed IS NOT NULL HAVING count(*) > 0",
    "agg03_skipped_languages": "SELECT lang AS language, count(*) AS files, 'no extractor' AS reason FROM documents WHERE lang NOT IN ('en', 'fr') GROUP BY lang",
    "set02_relation_union": f"WITH {D.KNOWLEDGE}, {D.CALLS} SELECT 'IMPACTS' AS rel, count(*) AS edges, count(DISTINCT src) AS sources FROM impacts UNION ALL SELECT 'SUPERSEDES', count(*), count(DISTINCT src) FROM supersedes UNION ALL SELECT 'CALLS', count(*), count(DISTINCT src) FROM calls",
}

SQL["sage03_evolution"] = SQL["sage01_apply_feedback"]

QUERIES = {k: globals()[k] for k in SQL}
