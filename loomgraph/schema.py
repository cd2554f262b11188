"""The declared graph tables, their domains and the identity rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

NODES = {
    "Function": "id string, name string, file string, start_line long, confidence double, provider string",
    "Class": "id string, name string, file string, provider string",
    "Module": "id string, path string",
    "Spec": "id string, title string, status string, confidence double, origin string",
    "Decision": "id string, title string, date string, confidence double, origin string",
    "Doc": "id string, title string, status string, confidence double, origin string",
}
#: relation: source label, target label, further columns
RELATIONS = {
    "CALLS": ("Function", "Function", ", call_count long, confidence double, provider string"),
    "IMPORTS": ("Module", "Module", ""),
    "DEFINES": ("Module", "Function", ""),
    "IMPLEMENTS": ("Module", "Spec", ""),
    "IMPACTS": ("Decision", "Spec", ""),
    "SUPERSEDES": ("Decision", "Decision", ""),
    "RELATES": ("Spec", "Spec", ""),
    "REFERENCES": ("Doc", "Doc", ""),
}
DISPLAY = {"Function": "name", "Class": "name", "Module": "path", "Spec": "title", "Decision": "title", "Doc": "title"}
ORIGIN_RANK = {"declared": 3, "annotated": 2, "referenced": 1}
DEFAULT_PROVIDER = "tree-sitter"
INDEX_PROVIDER = "scip"
LOCAL_CONFIDENCE, GLOBAL_CONFIDENCE, INDEX_CONFIDENCE = 0.8, 0.5, 0.9
JUDGED = ("Function", "Spec", "Decision", "Doc")


def ddl(table: str) -> str:
    return NODES[table] if table in NODES else "src string, dst string" + RELATIONS[table][2]


def struct(table: str) -> StructType:
    return StructType.fromDDL(ddl(table))


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], ddl(table))


def confidence_label(name: str) -> str:
    """The label as declared, whatever the case; ValueError lists the valid ones."""
    for label in JUDGED:
        if label.lower() == str(name).strip().lower():
            return label
    raise ValueError(f"no confidence is kept for {name!r}; valid labels: {', '.join(JUDGED)}")


def clamp(value, low: int, high: int, default: int) -> int:
    """An integer within bounds; what is no finite number gives the default."""
    try:
        number = float(value)
        return max(low, min(high, int(number)))
    except (TypeError, ValueError, OverflowError):
        return default
