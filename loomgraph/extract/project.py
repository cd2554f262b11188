"""Extraction of a whole tree: one pass over the files, then joins."""

from __future__ import annotations

import io
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..lineage import cut, spread
from ..operators import ranges, resolve
from . import lexical

_SCHEMA = "file string, language string, kind string, name string, start long, end long, line long, ordinal long, text string, failed string, error_nodes int, error_extent long, source_extent long, signatures array<string>"


_COLUMNS = [x.split()[0] for x in _SCHEMA.split(", ")]
_MOST_ROWS = 20_000


def _scanned(file: str, language: str, source: str) -> Iterator[list[tuple]]:
    """The rows of a file piece by piece; places and lines are those of the whole file, numbers go on from piece to piece."""
    line, extent, errors, error_extent, marks, numbers = 0, 0, 0, 0, {}, [0, 0, 0]
    for at, text in lexical.pieces(source, language):
        got, rows = lexical.extract(text, language), []
        for k, ((kind, name, start, end), n) in enumerate(zip(got.definitions, lexical.line_of(text, [d[2] for d in got.definitions]), strict=True), numbers[0]):
            rows.append((file, language, kind, name, at + start, at + end, line + n, k) + (None,) * 6)
        for k, (name, start) in enumerate(got.calls, numbers[1]):
            rows.append((file, language, "call", name, at + start, at + start + len(name), None, k) + (None,) * 6)
        for k, (comment, start) in enumerate(got.comments, numbers[2]):
            rows.append((file, language, "comment", None, at + start, None, None, k, comment) + (None,) * 5)
        numbers = [x + len(y) for x, y in zip(numbers, (got.definitions, got.calls, got.comments), strict=True)]
        line += text.count("\n")
        extent += len(text.encode("utf-16-le")) // 2
        errors += len(got.errors)
        error_extent += sum(e[1] for e in got.errors)
        marks |= dict.fromkeys(lexical.signature(language, e[2]) for e in got.errors)
        yield rows
    yield [(file, language, "file") + (None,) * 7 + (errors, error_extent, extent, list(marks))]


def _file_rows(file: str, language: str, source: str) -> Iterator[list[tuple]]:
    """The rows of a file, or its failure alone: what a long file has is held back on disk until its end is reached."""
    with tempfile.TemporaryFile() if len(source) > lexical.PIECE else io.BytesIO() as held:
        try:
            for rows in _scanned(file, language, source):
                pickle.dump(rows, held, pickle.HIGHEST_PROTOCOL)
        except Exception as e:  # one file must not fail the others
            yield [(file, language, "file") + (None,) * 6 + (str(e)[:200], 0, 0, len(source.encode("utf-16-le")) // 2, [])]
            return
        size = held.tell()
        held.seek(0)
        while held.tell() < size:
            yield pickle.load(held)


def scan_files(files: DataFrame) -> DataFrame:
    """One row per definition, call, comment and file of ``files(path, source[, language])``; a file that breaks its extractor yields only its failure."""
    language = F.coalesce(F.col("language"), T.language_of(F.col("path"))) if "language" in files.columns else T.language_of(F.col("path"))
    rows = files.select(T.posix_path(F.col("path")).alias("file"), language.alias("language"), F.coalesce("source", F.lit("")).alias("source"))

    def table(rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=_COLUMNS)
        for c in ("start", "end", "line", "ordinal", "error_nodes", "error_extent", "source_extent"):
            made[c] = made[c].astype("Int64")
        return made

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for file, lang, source in pdf.itertuples(index=False):
                for rows in _file_rows(file, lang, source):
                    out += rows
                    if len(out) >= _MOST_ROWS:
                        yield table(out)
                        out = []
            if out:
                yield table(out)

    return spread(rows).mapInPandas(scan, _SCHEMA)


def extract_code_graph(files: DataFrame) -> dict[str, DataFrame]:
    """The same tables as :func:`extract_project`, each file by itself: calls resolve against the names of their own file only."""
    return extract_project(files, own_names_only=True)


def extract_project(files: DataFrame, own_names_only: bool = False) -> dict[str, DataFrame]:
    """The tables of a tree: Function, Class, Module, Spec stubs, DEFINES, IMPLEMENTS, CALLS, plus resolved calls, health and counts."""
    flat = cut(scan_files(files), "extract")
    definitions = flat.where("kind in ('function', 'class')")
    ids = ranges.qualify(definitions.select("file", "kind", "name", "start", "end", "ordinal")).join(definitions.select("file", "ordinal", F.col("kind"), "line"), ["file", "ordinal", "kind"])
    ids = cut(ids, "ids")
    functions = ids.where("kind = 'function'")
    sites = flat.where("kind = 'call'").select(F.struct("ordinal", F.col("name").alias("callee")).alias("site"), "file", "start", "end")
    around = ranges.smallest_containing(sites, functions.select("file", "id", "start", "end", "ordinal"))
    raw = around.select(F.col("scope_id").alias("from_id"), "site.callee", "file")
    resolved = resolve.resolve_calls(raw, resolve.bare_names(functions.select("file", "name", "id", "ordinal")))
    if own_names_only:
        local = F.col("outcome") == "local"
        resolved = resolved.withColumns({"to_id": F.when(local, F.col("to_id")), "outcome": F.when(local, F.col("outcome")).otherwise("unresolved")})
    resolved = cut(resolved, "resolved")
    specs = flat.where("kind = 'comment'").select(F.col("file").alias("src"), F.explode(T.implemented_specs(F.col("text"))).alias("dst")).distinct()
    seen = functions.groupBy("id").agg(F.min_by(F.struct("name", "file", "line"), "ordinal").alias("f"))
    none = lambda t: F.lit(None).cast(t)
    health = flat.where("kind = 'file'").select(F.col("file").alias("path"), "language", "failed", "error_nodes", "error_extent", "source_extent", "signatures")
    return {
        "Function": seen.select("id", "f.name", "f.file", F.col("f.line").alias("start_line"), F.lit(1.0).alias("confidence"), F.lit("tree-sitter").alias("provider")),
        "Class": ids.where("kind = 'class'").select("id", "name", "file", F.lit("tree-sitter").alias("provider")).distinct(),
        "Module": health.select(F.col("path").alias("id"), "path").distinct(),
        "Spec": specs.select(F.col("dst").alias("id"), none("string").alias("title"), none("string").alias("status"), none("double").alias("confidence"), F.lit("annotated").alias("origin")).distinct(),
        "DEFINES": functions.select(F.col("file").alias("src"), F.col("id").alias("dst")).distinct(),
        "IMPLEMENTS": specs,
        "CALLS": resolve.build_call_edges(resolved),
        "resolved": resolved,
        "health": health,
        "counts": resolve.resolution_counts(resolved),
    }
