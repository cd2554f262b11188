"""Repeated spans against every window of ``LEAST_WORDS`` words, and removal from texts whose lower case has other bytes."""

import random
from collections import Counter

from loomgraph.llm import substrings
from small_frames import frame, prose, words


def covered(tokens):
    """The places of words that lie in a window of ``LEAST_WORDS`` words which occurs twice."""
    n = substrings.LEAST_WORDS
    seen = Counter(tuple(t[i : i + n]) for t in tokens for i in range(len(t) - n + 1))
    return {(d, i + k) for d, t in enumerate(tokens) for i in range(len(t) - n + 1) if seen[tuple(t[i : i + n])] > 1 for k in range(n)}


def test_spans_are_all_long_repeats(spark):
    rng = random.Random(21)
    texts = [prose(rng, rng.randrange(80, 200)) for _ in range(30)]
    for size in (49, 50, 51, 60, 68, 75, 90, 140):
        passage = prose(rng, size)
        for d in rng.sample(range(30), 3):
            w = texts[d].split()
            at = rng.randrange(len(w) + 1)
            if size % 2:
                texts[d] = " ".join([*w[:at], passage, *w[at:]])
            else:
                texts[d] += " " + passage
    texts += [texts[4], texts[4], "", None, "Ünder " * 3 + texts[9]]
    got = substrings.repeated_spans(frame(spark, texts)).collect()
    tokens = [words(t or "") for t in texts]
    assert {(r["doc_id"], r["start_word"] + k) for r in got for k in range(r["words"])} == covered(tokens)
    for r in got:
        assert tokens[r["source_id"]][r["source_word"] : r["source_word"] + substrings.K] == tokens[r["doc_id"]][r["start_word"] : r["start_word"] + substrings.K]
    again = substrings.repeated_spans(frame(spark, [t for t in substrings.without_repeats(frame(spark, texts)).orderBy("doc_id").toPandas()["text"]])).count()
    assert again == 0


def test_removal_keeps_case_and_bytes(spark):
    rng = random.Random(22)
    passage = prose(rng, 55)
    head, tail = "İstanbul IS A Big City ẞ ", " Ⱥ The End, İİ"
    texts = [passage, head + passage.upper() + tail, head]
    cut = {r["doc_id"]: r["text"] for r in substrings.without_repeats(frame(spark, texts)).collect()}
    assert cut == {0: passage, 1: head + tail, 2: head}


def test_ties_repeats_and_cycles(spark):
    line = " ".join(f"a{k}" for k in range(7))
    texts = [" ".join([line] * 30), "x", " ".join([line] * 30), "lorem ipsum dolor " * 3000]
    got = substrings.repeated_spans(frame(spark, texts)).collect()
    tokens = [words(t) for t in texts]
    assert {(r["doc_id"], r["start_word"] + k) for r in got for k in range(r["words"])} == covered(tokens)
    assert all(r["copies"] > 1 for r in got)
