"""Extraction and the symbol overlay on source text written from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..extract import project
from ..functions import text as T
from ..operators import ranges
from . import driver as D


def _files(spark, sf):
    """A file per brand: a function per part, which calls the parts that follow it in an order; every tenth part's file names a spec."""
    inner = D.steps(spark, sf).groupBy("src").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("f"), "dst", F.lit("();")))), " ").alias("body"))
    parts = D.functions(spark, sf).join(inner, F.col("id") == F.col("src"), "left")
    line = F.concat(F.lit("function f"), "id", F.lit("() { "), F.coalesce("body", F.lit("")), F.lit(" } // implements SPEC-"), (F.col("ordinal") % 10).cast("string"))
    return parts.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda x: x["line"]), "\n").alias("source")).select(F.concat(F.lit("src/"), "file", F.lit(".ts")).alias("path"), "source")


def ext15_extract_calls(spark, sf):
    return project.extract_project(_files(spark, sf))["CALLS"]


def ext01_extract_functions(spark, sf):
    return project.extract_project(_files(spark, sf))["Function"].select("id", "name", "file", "start_line")


def ext09_implements(spark, sf):
    return project.extract_project(_files(spark, sf))["IMPLEMENTS"]


#: A function that calls another, in each language; ``@`` stands for a part's number.
_SNIPPETS = {
    "ts": "function f@() { g@(); } // c@", "tsx": "function f@() { g@(); } // c@", "js": "function f@() { g@(); } // c@", "cs": "class C { void f@() { g@(); } } // c@", "py": "def f@():\n    g@()  # c@\n",
    "go": "func f@() { g@() } // c@", "java": "class C { void f@() { g@(); } } // c@", "kt": "fun f@() { g@() } // c@", "rs": "fn f@() { g@(); } // c@", "cc": "void f@() { g@(); } // c@",
    "rb": "def f@\n  g@() # c@\nend\n", "php": "<?php function f@() { g@(); } // c@", "dart": "void f@() { g@(); } // c@",
}


def ext02_languages(spark, sf):
    """A file per part, its language by its number."""
    n = (F.col("ordinal") % len(_SNIPPETS) + 1).cast("int")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), n)
    files = D.functions(spark, sf).select(F.concat(F.lit("p"), "id", F.lit("."), pick(_SNIPPETS)).alias("path"), F.replace(pick(_SNIPPETS.values()), F.lit("@"), F.col("id")).alias("source"))
    found = project.scan_files(files).where("kind in ('function', 'call', 'comment')")
    return found.select("file", "language", "kind", F.coalesce("name", F.regexp_extract("text", "c[0-9]+", 0)).alias("name"))


def _occurrences(spark, sf):
    """Each part is a symbol, defined in its brand's file at its number; each step is a use inside its caller."""
    parts = D.functions(spark, sf)
    defined = parts.select(F.col("id").alias("symbol"), F.lit(1).alias("symbol_roles"), "file", F.col("ordinal").alias("row"))
    used = D.steps(spark, sf).join(parts.select(F.col("id").alias("src"), "file", F.col("ordinal").alias("row")), "src").select(F.col("dst").alias("symbol"), F.lit(0).alias("symbol_roles"), "file", "row")
    all_ = defined.unionByName(used)
    return all_.select("symbol", "symbol_roles", "file", "row", F.lit("function").alias("kind"), F.lit(0).alias("doc_idx"), F.monotonically_increasing_id().alias("occ_idx"))


def _scopes(spark, sf):
    return D.functions(spark, sf).select("id", "file", F.col("ordinal").alias("start"), F.col("ordinal").alias("end"), "ordinal")


def join19_symbol_edges(spark, sf):
    return ranges.index_edges(_occurrences(spark, sf), _scopes(spark, sf))[1]


def agg14_symbol_counts(spark, sf):
    return ranges.index_edges(_occurrences(spark, sf), _scopes(spark, sf))[2]


def join17_definition_sites(spark, sf):
    return ranges.definition_sites(_occurrences(spark, sf)).select("symbol", "file", "row")


def fil04_path_suffix(spark, sf):
    first = D.functions(spark, sf).agg(F.min("file")).first()[0]
    return D.functions(spark, sf).select(F.concat(F.lit("src/"), "file").alias("id")).distinct().where(T.path_matches(F.col("id"), first))


def fil05_same_subtree(spark, sf):
    a = D.health(spark, sf).select(T.dir_of(F.col("path")).alias("dir"))
    return a.where(T.same_subtree(F.col("dir"), F.lit("src1"))).groupBy("dir").agg(F.count("*").alias("files"))


_SITE = "CASE WHEN a.file = b.file THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END"
_LANGUAGE = dict(ts="typescript", tsx="tsx", js="javascript", cs="csharp", py="python", go="go", java="java", kt="kotlin", rs="rust", cc="cpp", rb="ruby", php="php", dart="dart")
SQL = {
    "ext02_languages": f"""WITH f AS (SELECT p_partkey AS n, {list(_SNIPPETS)}[p_partkey % {len(_SNIPPETS)} + 1] AS suffix, {list(_LANGUAGE.values())}[p_partkey % {len(_SNIPPETS)} + 1] AS language FROM part), k AS (SELECT * FROM (VALUES ('function', 'f'), ('call', 'g'), ('comment', 'c')) AS t(kind, letter))
  SELECT concat('p', n, '.', suffix) AS file, language, kind, concat(letter, n) AS name FROM f CROSS JOIN k""",
    "ext15_extract_calls": f"WITH {D.FUNCTIONS}, {D.CALLS} SELECT concat('src/', a.file, '.ts#f', src) AS src, concat('src/', b.file, '.ts#f', dst) AS dst, call_count, {_SITE} AS confidence, 'tree-sitter' AS provider FROM calls JOIN functions a ON a.id = src JOIN functions b ON b.id = dst",
    "ext01_extract_functions": f"WITH {D.FUNCTIONS} SELECT concat('src/', file, '.ts#f', id) AS id, concat('f', id) AS name, concat('src/', file, '.ts') AS file, row_number() OVER (PARTITION BY file ORDER BY ordinal) AS start_line FROM functions",
    "ext09_implements": f"WITH {D.FUNCTIONS} SELECT DISTINCT concat('src/', file, '.ts') AS src, concat('SPEC-', ordinal % 10) AS dst FROM functions",
    "join19_symbol_edges": f"WITH {D.CALLS} SELECT src, dst, call_count, 0.9::DOUBLE AS confidence, 'scip' AS provider FROM calls",
    "agg14_symbol_counts": f"WITH {D.FUNCTIONS}, {D.CALLS} SELECT (SELECT count(*) FROM functions) AS symbols, (SELECT count(*) FROM functions) AS resolved, 0 AS unresolved, (SELECT CAST(sum(call_count) AS BIGINT) FROM calls) AS call_sites, 0 AS outside, 0 AS recursive",
    "join17_definition_sites": f'WITH {D.FUNCTIONS} SELECT id AS symbol, file, ordinal AS "row" FROM functions',
    "fil04_path_suffix": f"WITH {D.FUNCTIONS} SELECT concat('src/', min(file)) AS id FROM functions",
    "fil05_same_subtree": f"WITH {D.HEALTH} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(*) AS files FROM health WHERE starts_with(path, 'src1/') GROUP BY 1",
}

QUERIES = {k: globals()[k] for k in SQL}
