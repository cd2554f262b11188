"""Small frames and prose for the tests of the training-data operators."""

from loomgraph.llm.words import split_words

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)], DDL)


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def words(text):
    w = split_words([text])
    raw = text.lower().encode()
    return [raw[s:e].decode() for s, e in zip(w.starts, w.ends, strict=True)]
