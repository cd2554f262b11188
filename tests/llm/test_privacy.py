"""Sanitisation: every disclosure against plain Python, planted terms, edges."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import privacy
from loomgraph.llm.words import split_words
from small_frames import frame, prose, words


def corpus():
    rng = random.Random(6)
    texts = [f"Zorblatt {prose(rng, 5, 300)} the common {prose(rng, 12, 300)} anna@mail.example.com {prose(rng, 4, 300)}" for _ in range(5)]
    texts += [f"the common {prose(rng, 30, 300)}" for _ in range(1195)]
    texts += ["the common unheard Quixotl 7788x word: bob@mail.example.com", "the common call +1 (706) 555-3138 or 4644 3483 9801 0899 from 10.2.3.4 in 1999, version 1.2.3"]
    texts += ["list " + " ".join(f"p{k}@lists.example.org w{k % 300}x" for k in range(400))] * 3
    return [*texts, "", None]


def brute_force(texts):
    """(text, term) -> disclosure, the largest over the entities of the text."""
    n = sum(t is not None for t in texts)
    own, both, docs, terms, held = Counter(), Counter(), Counter(), {}, defaultdict(set)
    for t in texts:
        if t is None:
            continue
        docs.update(set(words(t)))
        spans = privacy.entities(t)
        if spans:
            at, parts = 0, []
            for s, e, _ in spans:
                parts.append(t[at:s])
                held[t].add(privacy._value(t, s, e))
                at = e
            terms[t] = set(words("\n".join([*parts, t[at:]])))
            own.update(held[t])
            both.update((e, w) for e in held[t] for w in terms[t])
    out = {}
    for t in terms:
        for e in held[t]:
            for w in terms[t]:
                k, m, z2 = both[e, w], docs[w], privacy.Z**2
                p = k / m
                low = (p + z2 / (2 * m) - privacy.Z * math.sqrt(p * (1 - p) / m + z2 / (4 * m * m))) / (1 + z2 / m)
                out[t, w] = max(out.get((t, w), -9), math.log(low * n / own[e]) / math.log(n / own[e]))
    return {k: v for k, v in out.items() if v >= privacy.DISCLOSURE}


def test_disclosures_are_brute_force(spark):
    texts = corpus()
    docs = frame(spark, texts)
    private = privacy._private(docs, [F.col("text")])
    name = {}
    for t in set(texts) - {None}:
        for w, h in zip(words(t), split_words([t]).hashes.view(np.int64).tolist(), strict=True):
            name[h] = w
    keys = {r["key"]: r["text"] for r in docs.where("text is not null").select(F.md5("text").alias("key"), "text").collect()}
    got = {(keys[r["key"]], name[r["term"]]): r["disclosure"] for r in privacy.disclosures(docs, private).collect()}
    want = brute_force(texts)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {w for t, w in want if t == texts[1200]} >= {"unheard", "quixotl", "7788x"} and all((t, "zorblatt") in want for t in texts[:5])


def test_sanitised_texts(spark):
    texts = corpus()
    docs = frame(spark, texts)
    got = {r["doc_id"]: r for r in privacy.sanitised_documents(docs).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 1200, 1201, 1202, 1203, 1204}
    assert all("<NAME>" in got[i]["text"] and "<EMAIL>" in got[i]["text"] and "Zorblatt" not in got[i]["text"] and "the common" in got[i]["text"] for i in range(5))
    assert got[1200]["text"] == "the common  <NAME> <NUMBER> : <EMAIL>" and got[1200]["terms"] == 4
    assert "<PHONE>" in got[1201]["text"] and "<CARD>" in got[1201]["text"] and "<IP>" in got[1201]["text"] and "0899" not in got[1201]["text"]
    assert got[1202]["entities"] == 400 and "@" not in got[1202]["text"]
    whole = {r["doc_id"]: r["text"] for r in privacy.sanitise(docs).collect()}
    assert all(whole[i] == (got[i]["text"] if i in got else t) for i, t in enumerate(texts)) and len(whole) == len(texts)


def test_an_entity_everywhere_discloses_nothing(spark):
    got = privacy.sanitised_documents(frame(spark, ["Ülm İx a@b.example"] * 3)).collect()
    assert [(r["text"], r["terms"]) for r in got] == [("Ülm İx <EMAIL>", 0)] * 3
