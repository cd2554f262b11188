"""Words learnt from labelled documents: recall and precision by language on held-out labels."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_recall_and_precision_by_language(spark):
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    found = {r["doc_id"] for r in toxicity.toxic_documents(docs, labels=labels.where(~held)).collect()}
    rows = labels.where(held).join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", "lang", "toxic").collect()
    for lang, least in (("en", 0.9), ("fr", 0.85), ("de", 0.85), ("es", 0.6)):  # es has some 20 toxic documents to learn from
        toxic = {r["doc_id"] for r in rows if r["lang"] == lang and r["toxic"]}
        clean = {r["doc_id"] for r in rows if r["lang"] == lang and not r["toxic"]}
        assert len(toxic & found) / len(toxic) >= least, lang
        assert len(clean & found) / len(clean) <= 0.02, lang


def test_copies_are_no_evidence(spark):
    """A word of many copies of one toxic document is not learnt; one in different surroundings is."""
    texts = [("zwork blarg plim", 1)] * 9 + [(f"n{'abcdefghi'[k]} quorf m{'abcdefghi'[k]}", 1) for k in range(9)] + [(f"plain {'abcdefghi'[k % 9]} words", 0) for k in range(300)]
    docs = spark.createDataFrame([(i, t, "xx") for i, (t, _) in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)] + [(None, 1), (0, None)], "doc_id long, toxic int")
    assert toxicity.learn(docs, labels) == {"quorf"}
    assert toxicity.learn(docs, labels.limit(0)) == frozenset()
    assert toxicity.score_text("Quorf and quorf.", frozenset({"quorf"}))[0] >= toxicity.THRESHOLD > toxicity.score_text("one quorf", frozenset({"quorf"}))[0]
    kept = {r["doc_id"] for r in toxicity.clean_documents(docs, labels=labels).collect()}
    assert kept == set(range(len(texts)))


def test_learnt_words_are_brute_force(spark, monkeypatch):
    """Recounted in plain Python from the documents; words too many to broadcast are counted by a join with the same result."""
    rng = random.Random(8)
    texts, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        some = [f"w{'abcdefghij'[rng.randrange(10)]}{'klmnopqrst'[rng.randrange(10)]}" for _ in range(rng.randrange(3, 30))]
        if toxic and i % 8 == 0:
            some.insert(rng.randrange(len(some)), rng.choice(["vexo", "Vexa", "idiot"]))
        if rng.random() < 0.02:
            some.insert(0, "vexa")
        texts.append((i, " ".join(some), rng.choice(["aa", "bb", None])))
        labels.append((i, int(toxic)))
    texts.append((900, None, "aa"))
    docs, marks = spark.createDataFrame(texts, "doc_id long, text string, lang string"), spark.createDataFrame([*labels, (900, 1)], "doc_id long, toxic int")
    around, clean, of = {}, {}, {}
    for (_, text, lang), (_, toxic) in zip(texts, labels, strict=False):
        lang = lang or ""
        of[lang, toxic] = of.get((lang, toxic), 0) + 1
        words = ["", *text.lower().split(), ""]
        for w in set(words) - {""}:
            k = words.index(w)
            if toxic:
                around.setdefault((lang, w), set()).add((words[k - 1], words[k + 1]))
            else:
                clean[lang, w] = clean.get((lang, w), 0) + 1
    often = {k: len(v) for k, v in around.items() if len(v) >= toxicity.SUPPORT and k[1] not in toxicity.CLASS}
    ratio = lambda t, nt, c, nc: math.log((t + 0.5) / (nt + 1)) - math.log((c + 0.5) / (nc + 1))
    total = lambda held, w: sum(n for (_, x), n in held.items() if x == w)
    size = lambda t: sum(n for (_, x), n in of.items() if x == t)
    want = {
        w
        for (lang, w), n in often.items()
        if ratio(n, of[lang, 1], clean.get((lang, w), 0), of[lang, 0]) >= toxicity.RATIO and ratio(total(often, w), size(1), total(clean, w), size(0)) >= toxicity.RATIO
    }
    assert want and toxicity.learn(docs, marks) == want
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 0)
    assert toxicity.learn(docs, marks) == want
