"""Interval joins within one file: scopes, enclosing functions, index occurrences.

All joins are equality joins on file and grid cell with the interval test as a further condition, never a nested loop over a
table or a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import INDEX_CONFIDENCE, INDEX_PROVIDER

def _cell(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(4.0), level)).cast("long")


def _bins(start: Column, end: Column) -> Column:
    """Cells ``(level, number)`` of fourfold wider grids, two neighbours at most of the level on which the interval is shorter than a cell."""
    level = F.ceil(F.log2(F.greatest(end - start, F.lit(0)).cast("double") + 1) / 2).cast("int")
    return F.transform(F.sequence(_cell(start, level), _cell(end, level)), lambda n: F.struct(level.alias("level"), n.alias("cell")))


def around(sites: DataFrame, scopes: DataFrame) -> DataFrame:
    """``sites(file, start, end, ...)`` with every scope ``(f, s, e, ...)`` of their file that contains them, bounds included.

    An interval lies in the one or two cells of a grid about as wide as itself, a site asks the cell of its start on each level that has scopes: an equality
    join on file, level and cell, so that a file of many scopes is no group of all pairs. A site meets those scopes only that are around its start or in the same cell.
    """
    placed = scopes.withColumn("at", F.explode(_bins(F.col("s"), F.col("e")))).select(*scopes.columns, F.col("at.level").alias("on_level"), F.col("at.cell").alias("on_cell"))
    levels = F.broadcast(placed.agg(F.collect_set("on_level").alias("levels")))  # one row, no more levels than a number has pairs of bits
    asked = F.transform("levels", lambda k: F.struct(k.alias("level"), _cell(F.col("start"), k).alias("cell")))
    wanted = sites.crossJoin(levels).withColumn("at", F.explode(asked)).select(*sites.columns, F.col("at.level").alias("level"), F.col("at.cell").alias("cell"))
    inside = F.expr("file = f and level = on_level and cell = on_cell and s <= start and e >= end")
    return wanted.join(placed, inside).select(*sites.columns, *scopes.columns)


def containing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """``inner(file, start, end, ...)`` with each wider ``outer(file, start, end, ...)`` around it as ``(f, s, e, ...)``."""
    names = {"file": "f", "start": "s", "end": "e"}
    found = around(inner, outer.select(*[F.col(c).alias(names.get(c, f"outer_{c}")) for c in outer.columns]))
    return found.where((F.col("e") - F.col("s")) > (F.col("end") - F.col("start")))


def qualify(definitions: DataFrame) -> DataFrame:
    """``definitions(file, kind, name, start, end, ordinal)`` with ``id``.

    A function's id names all functions and classes that strictly contain it, the outermost first; a
    class is never qualified.
    """
    d = definitions.select("file", "kind", "name", "start", "end", "ordinal")
    functions = d.where("kind = 'function'")
    scope = F.struct("s", (-F.col("e")).alias("e"), F.col("outer_ordinal").alias("o"), F.col("outer_name").alias("scope"))
    held = containing(functions, d.select("file", "start", "end", "ordinal", "name")).select(*d.columns, scope.alias("scope"))
    # Functions themselves go along without a scope, which collect_list leaves out: one shuffle, and those without a scope stay.
    both = held.unionByName(functions.withColumn("scope", F.lit(None).cast(held.schema["scope"].dataType)))
    grouped = both.groupBy(*d.columns).agg(F.array_sort(F.collect_list("scope")).alias("scopes"), F.count_if(F.col("scope").isNull()).alias("times"))
    joined = grouped.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    path = F.array_join(F.concat(F.transform("scopes", lambda x: x["scope"]), F.array("name")), ".")
    named = joined.select("file", "kind", "name", "start", "end", "ordinal", F.concat("file", F.lit("#"), path).alias("id"))
    return named.unionByName(d.where("kind = 'class'").withColumn("id", F.concat("file", F.lit("#class:"), "name")))


def smallest_containing(sites: DataFrame, scopes: DataFrame, how: str = "inner") -> DataFrame:
    """``sites(site, file, start, end)`` with the id of the narrowest ``scopes(id, file, start, end, ordinal)`` around each.

    Bounds are inclusive; of equally narrow scopes the first by ordinal wins.
    """
    s = scopes.select(F.col("file").alias("f"), F.col("id").alias("scope_id"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("ordinal").alias("o"))
    asked = sites.select("site", "file", "start", "end")
    found = around(asked, s).groupBy("site", "file", "start", "end").agg(F.min_by("scope_id", F.struct((F.col("e") - F.col("s")).alias("span"), "o")).alias("scope_id"))
    if how == "inner":
        return found
    alone = asked.join(found.select("site"), "site", "left_anti").distinct()
    return found.unionByName(alone.withColumn("scope_id", F.lit(None).cast(dict(found.dtypes)["scope_id"])))


def definition_sites(occurrences: DataFrame) -> DataFrame:
    """The first definition of each symbol that is no local: ``(symbol, file, row)``."""
    ours = occurrences.where(F.col("symbol_roles").bitwiseAND(F.lit(1)) != 0).where(~F.col("symbol").startswith("local ")).where("kind != 'other'")
    first = Window.partitionBy("symbol").orderBy("doc_idx", "occ_idx")
    return ours.withColumn("n", F.row_number().over(first)).where("n = 1").select("symbol", "kind", "file", F.col("row").alias("row"))


def index_edges(occurrences: DataFrame, scopes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Overlay of a symbol index ``(symbol, symbol_roles, kind, file, doc_idx, occ_idx, row)`` on scopes.

    Returns the definitions ``(symbol, id, kind)``, id null when no scope holds them; the call edges
    ``(src, dst, call_count, confidence, provider)``; and one row of counts.
    """
    sites = definition_sites(occurrences)
    asked = sites.select(F.col("symbol").alias("site"), "file", F.col("row").alias("start"), F.col("row").alias("end"), "kind")
    placed = smallest_containing(asked, scopes, "left").select(F.col("site").alias("symbol"), F.col("scope_id").alias("id"))
    definitions = sites.select("symbol", "kind").join(placed, "symbol").select("symbol", "id", "kind")
    targets = definitions.where("id is not null and kind = 'function'").select("symbol", F.col("id").alias("dst"))
    uses = occurrences.where(F.col("symbol_roles").bitwiseAND(F.lit(1)) == 0).join(targets, "symbol")
    # A place is sought once, however many uses it has.
    uses = uses.groupBy("file", "row", "dst").agg(F.count("*").alias("n"))
    places = uses.select(F.struct("file", "row").alias("site"), "file", F.col("row").alias("start"), F.col("row").alias("end")).distinct()
    functions = scopes.where("kind = 'function'") if "kind" in scopes.columns else scopes
    callers = uses.join(smallest_containing(places, functions).select("site.file", "site.row", F.col("scope_id").alias("src")), ["file", "row"], "left").select("src", "dst", "n")
    edges = callers.where("src is not null and src != dst").groupBy("src", "dst").agg(F.sum("n").alias("call_count"))
    edges = edges.select("src", "dst", "call_count", F.lit(INDEX_CONFIDENCE).alias("confidence"), F.lit(INDEX_PROVIDER).alias("provider"))
    counts = definitions.agg(F.count("*").alias("symbols"), F.count("id").alias("resolved"), F.count_if(F.col("id").isNull()).alias("unresolved"))
    sum_ = lambda c: F.coalesce(F.sum(c), F.lit(0))
    used = callers.agg(sum_("n").alias("call_sites"), sum_(F.when(F.col("src").isNull(), F.col("n"))).alias("outside"), sum_(F.when(F.col("src") == F.col("dst"), F.col("n"))).alias("recursive"))
    return definitions, edges, counts.crossJoin(used)


def index_nodes(definitions: DataFrame, scopes: DataFrame) -> DataFrame:
    """``(id, kind, name, file, start_line)`` of the scopes that a symbol index defines, once each, however many symbols resolve to one."""
    found = definitions.where("id is not null").select("id").distinct()
    first = F.min_by(F.struct("kind", "name", "file", "start_line"), "start_line").alias("s")
    return scopes.join(found, "id", "left_semi").groupBy("id").agg(first).select("id", "s.kind", "s.name", "s.file", "s.start_line")


def overlap(files: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Files of the tree that the index has too; none at all is an error, as the overlay would be void."""
    found = files.select("file").distinct().join(occurrences.select("file").distinct(), "file", "left_semi")
    if found.isEmpty():
        raise ValueError("no file of this tree occurs in the symbol index; are its paths relative to the same root?")
    return found
