"""Scalar functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"^[\s\x{FEFF}\x{A0}]+|[\s\x{FEFF}\x{A0}]+$"
FRONT = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$"
#: An artifact id. Explicit classes instead of \b, which looks at letters of any script here.
ARTIFACT = r"(?i)(?<![A-Za-z0-9_])(?:XSPEC|SPEC|XADR|ADR|DEC)-(?:[0-9]+(?![A-Za-z0-9_])|[A-Za-z0-9](?:[A-Za-z0-9_-]*[A-Za-z0-9])?)"
RELATION_FIELDS = ("related", "depends_on", "impacts", "impacted_by", "supersedes", "implements")
LANGUAGES = [
    (".tsx", "tsx"), (".ts", "typescript"), (".mts", "typescript"), (".cts", "typescript"), (".cs", "csharp"), (".py", "python"), (".go", "go"),
    (".java", "java"), (".kt", "kotlin"), (".kts", "kotlin"), (".rs", "rust"), (".cpp", "cpp"), (".cc", "cpp"), (".cxx", "cpp"), (".hpp", "cpp"),
    (".hh", "cpp"), (".h", "cpp"), (".rb", "ruby"), (".php", "php"), (".dart", "dart"),
]


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; Spark's trim knows only the blank."""
    return F.regexp_replace(c, BLANK, "")


def front_matter(content: Column) -> tuple[Column, Column]:
    """The fields as a map (last key wins) and the body of a document."""
    text = F.regexp_replace(content, r"^\x{FEFF}", "")
    has = text.rlike(FRONT)
    lines = F.filter(F.transform(F.split(F.regexp_extract(text, FRONT, 1), r"\r?\n"), strip), lambda x: x.rlike(r"^[A-Za-z0-9_-]+\s*:"))
    value = lambda x: F.regexp_replace(strip(F.regexp_extract(x, r"(?s)^[A-Za-z0-9_-]+\s*:\s*(.*)$", 1)), "^[\"']|[\"']$", "")
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([A-Za-z0-9_-]+)\s*:", 1).alias("key"), value(x).alias("value")))
    # Last key wins without a session setting.
    merged = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["key"]), F.create_map(p["key"], p["value"])))
    fields = F.when(has, merged).otherwise(F.create_map().cast("map<string,string>"))
    return fields, F.when(has, F.regexp_extract(text, FRONT, 2)).otherwise(text)


def link_refs(body: Column) -> Column:
    """Distinct [[targets]] in order."""
    found = F.transform(F.regexp_extract_all(body, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)), strip)
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def first_heading(body: Column) -> Column:
    found = F.regexp_extract(body, r"(?m)^#\s+(.+)$", 1)
    return F.when(found != "", strip(found))


def classify_ref(raw: Column) -> Column:
    """The first artifact id, in upper case, or null."""
    found = F.upper(F.regexp_extract(raw, ARTIFACT, 0))
    return F.when(found != "", found)


def ref_ids(text: Column) -> Column:
    """All artifact ids in upper case, distinct and in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ARTIFACT), F.lit(0)), F.upper))


def ref_kind(id_: Column) -> Column:
    return F.when(id_.rlike("^X?SPEC-"), "Spec").when(id_.isNotNull(), "Decision")


def implemented_specs(comment: Column) -> Column:
    """Spec ids of a comment that says it implements something."""
    gate = comment.rlike(r"(?i)(?<![A-Za-z0-9_])implements(?![A-Za-z0-9_])|@implements(?![A-Za-z0-9_])|@spec(?![A-Za-z0-9_])")
    return F.when(gate, F.filter(ref_ids(comment), lambda x: x.rlike("^X?SPEC-"))).otherwise(F.array().cast("array<string>"))


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def posix_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def module_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(posix_path(path), r"^\./", ""), "^/+", "")


def dir_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def file_of(id_: Column) -> Column:
    return F.substring_index(id_, "#", 1)


def failure_reason(message: Column) -> Column:
    """A message with its paths, quoted parts and numbers replaced, so that equal causes are equal."""
    part = "[A-Za-z0-9_.@-]+"
    steps = [(r"[A-Za-z]:[\\][^ \t\n'\"]+", "<path>"), (f"(?:[.]{{0,2}}/)?(?:{part}/)+{part}", "<path>"), ("'[^']*'", "'<x>'"), ('"[^"]*"', '"<x>"'), ("[0-9]+", "<n>"), (r"\s+", " ")]
    return F.left(strip(reduce(lambda c, s: F.regexp_replace(c, *s), steps, message)), F.lit(200))


def language_of(path: Column) -> Column:
    low = F.lower(path)
    found = reduce(lambda c, s: c.when(low.endswith(s[0]), s[1]), LANGUAGES[1:], F.when(low.endswith(LANGUAGES[0][0]), LANGUAGES[0][1]))
    return found.otherwise("javascript")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def branch_name(branch: Column) -> Column:
    safe = F.left(F.regexp_replace(branch, "[^A-Za-z0-9._-]", "-"), F.lit(60))
    return F.concat(safe, F.lit("-"), F.substring(F.sha1(branch), 1, 8))


def graph_name(name: Column) -> Column:
    safe = F.left(F.regexp_replace(name, "[^A-Za-z0-9._-]", "-"), F.lit(80))
    return F.when(safe == "", "graph").otherwise(safe)


def same_subtree(a: Column, b: Column) -> Column:
    """Whether one directory is the other or lies below it; the top is only itself."""
    below = a.startswith(F.concat(b, F.lit("/"))) | b.startswith(F.concat(a, F.lit("/")))
    return (a == b) | ((a != "") & (b != "") & below)


def path_matches(id_: Column, wanted: str) -> Column:
    w = F.lit(wanted)
    return (id_ == w) | id_.endswith(F.concat(F.lit("/"), w)) | w.endswith(F.concat(F.lit("/"), id_))


def error_signature(raw: Column) -> Column:
    return F.substring(F.sha2(raw, 256), 1, 12)


def feedback_signal(kind: Column) -> tuple[Column, Column]:
    """Sign and default weight of a feedback event."""
    sign = F.when(kind == "test_fail", -1.0).when(kind.isin("test_pass", "human_fix"), 1.0).otherwise(0.0)
    weight = F.when(kind == "test_fail", 1.0).when(kind == "test_pass", 0.4).when(kind == "human_fix", 0.6).otherwise(0.0)
    return sign, weight
