"""Nulls, empty and very long texts, repeated rows, empty tables, columns with clashing names."""

import math

import pytest

from loomgraph.llm import bpe, decontamination, embeddings, language, near_dup, privacy, quality, secrets, substrings, toxicity

DDL = "doc_id long, text string, lang string, row int, node string, key int, score double, edge int, kept int, doc_ID_2 int, `a.b` int, group_id int, token_ids int, label_id int, values int"
LONG = "lorem ipsum dolor " * 30_000
ROWS = [(1, "some words in a row", "en"), (1, "some words in a row", "en"), (None, "no id here", "en"), (3, None, "en"), (4, "", None), (5, LONG, "en"), (6, "some words in a row", None), (7, " \n\t", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *[1] * 3, 1.0, *[1] * 8) if False else (r[0], r[1], r[2], 1, "n", 1, 1.0, 1, 1, 1, 1, 1, 1, 1, 1) for r in ROWS], DDL)


def _bench(spark):
    return spark.createDataFrame([(None, "x"), (1, None)], "item_id long, text string")


def _labels(spark):
    return spark.createDataFrame([(1, 1), (5, 0), (5, None), (None, 0)], "doc_id long, quality int")


REPORTS = {
    "secrets": lambda s, d: secrets.find_secrets(d),
    "substrings": lambda s, d: substrings.repeated_spans(d),
    "decontamination": lambda s, d: decontamination.find_contamination(d, _bench(s)),
    "quality": lambda s, d: quality.score_documents(d, _labels(s)),
    "privacy": lambda s, d: privacy.sanitised_documents(d),
    "near_dup": lambda s, d: near_dup.near_duplicate_groups(d),
    "language": lambda s, d: language.identify(d),
    "toxicity": lambda s, d: toxicity.toxic_documents(d),
    "bpe": lambda s, d: bpe.encode_documents(d),
}
REWRITES = {
    "secrets": lambda s, d: secrets.redact_secrets(d),
    "substrings": lambda s, d: substrings.without_repeats(d),
    "decontamination": lambda s, d: decontamination.decontaminated(d, _bench(s)),
    "privacy": lambda s, d: privacy.sanitise(d),
    "near_dup": lambda s, d: near_dup.deduplicated(d),
    "toxicity": lambda s, d: toxicity.clean_documents(d),
}
WANT = {"secrets": 0, "decontamination": 0, "quality": 8, "privacy": 0, "near_dup": 3, "language": 8, "toxicity": 0, "bpe": 8}


@pytest.mark.parametrize("name", REPORTS)
def test_reports(spark, docs, name):
    found = REPORTS[name](spark, docs)
    if name == "substrings":  # the long text repeats itself from end to end; its first line is the one occurrence that stays
        rows = found.collect()
        held = {k for r in rows for k in range(r["start_word"], r["start_word"] + r["words"])}
        assert {r["doc_id"] for r in rows} == {5} and held == set(range(90_000)) and any(r["first"] for r in rows)
    else:
        assert found.count() == WANT[name]
    assert REPORTS[name](spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", REWRITES)
def test_rewrites_keep_rows_and_columns(spark, docs, name):
    out = REWRITES[name](spark, docs)
    assert out.columns == docs.columns
    rows = out.collect()
    if name == "near_dup":
        assert sorted((r["doc_id"] or 0) for r in rows) == [0, 1, 3, 4, 5, 7]
    else:
        assert len(rows) == len(ROWS)
        if name == "substrings":
            assert sorted(str(r["text"]) for r in rows if r["doc_id"] != 5) == sorted(str(r[1]) for r in ROWS if r[0] != 5)
            left = next(r["text"] for r in rows if r["doc_id"] == 5)
            assert left.strip() and len(left) < 10_000 and not set(left.split()) - {"lorem", "ipsum", "dolor"}
        else:
            assert sorted(str(r["text"]) for r in rows) == sorted(str(r[1]) for r in ROWS)
    empty = REWRITES[name](spark, docs.limit(0))
    assert empty.columns == docs.columns and empty.count() == 0


def test_bpe_replaces_its_own_columns(spark, docs):
    out = bpe.with_tokens(docs)
    assert out.columns[-2:] == ["n_tokens", "token_ids"] and out.columns.count("token_ids") == 1
    assert out.count() == len(ROWS)


@pytest.mark.parametrize("name", REPORTS)
def test_one_short_document(spark, name):
    for text in ("ab", "one two", None):
        one = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
        assert REPORTS[name](spark, one).count() == (1 if name in ("quality", "language", "bpe") else 0)


def test_vectors(spark):
    """Clashing column names, text ids, ties at the threshold, repeated rows, rows without a vector, another width."""
    tie = [0.95, math.sqrt(1 - 0.95**2)]
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("b", [2.0, 0.0]), ("c", tie), ("d", [0.0, 1.0]), ("e", None), ("f", []), ("g", [0.0, 0.0]), ("h", [1.0, None]), ("i", [float("nan"), 1.0]), (None, [1.0, 0.0]), ("j", [1.0, 0.0, 0.0]), ("k", [1.0, 0.0, 0.0])]
    ddl = "name string, w array<double>, id int, v int, cell int, bucket int, own int, class_id int, copies int, links int, h1 int, h2 int, `a.b` int"
    vectors = spark.createDataFrame([(*r, *[1] * 11) for r in rows], ddl)
    got = sorted(tuple(r) for r in embeddings.near_links(vectors, "name", "w").collect())
    want = [("a", "a", 1, 3), ("b", "b", 2, 3), ("b", "b", 2, 3), ("c", "c", 1, 3), ("d", "d", 1, 0), *((x, None, 0, 0) for x in "efghi"), ("j", "j", 2, 1), ("k", "j", 2, 1)]
    assert got == want
    assert embeddings.near_links(vectors.limit(0), "name", "w").count() == 0
