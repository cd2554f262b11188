"""The pipeline against its stages in plain Python."""

import os

import corpus_pipeline
from loomgraph.llm import bpe, decontamination, near_dup, secrets, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_are_brute_force(spark, tmp_path):
    base = "the river walks under seven old stones and nobody in the valley knows its proper name any more today"
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    texts = [
        base, base, base.replace("seven", "eight") + " indeed", "You are an idiot and you are scum.", f"prefix words {item} suffix words",
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" follows', None, "", "short and clean", "You are not an idiot.",
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = [(i, t) for i, t in enumerate(texts) if toxicity.score_text(t)[0] < toxicity.THRESHOLD]
    idf = near_dup.document_frequencies(spark.createDataFrame(left, "doc_id long, text string").select("text"))
    kept = []
    for i, t in left:
        sets = lambda x: (lambda s: (s[1], near_dup.weights(s[1], s[2], idf)))(near_dup.shingle_sets([x]))
        if t is None or not any(u is not None and (u == t or near_dup.jaccard(sets(u), sets(t)) >= near_dup.THRESHOLD) for _, u in kept):
            kept.append((i, t))
    test = decontamination.TestSet.of([0], [item])
    clean = [(i, t) for i, t in kept if not decontamination.matches([t], test)]
    judge = secrets.Judge(secrets.SEED.encode())
    encoder = bpe.Encoder(bpe.load_vocabulary())
    want = {i: judge.redact(t) for i, t in clean}
    assert {i: r["text"] for i, r in got.items()} == want and set(want) == {0, 5, 6, 7, 8, 9}
    assert all(r["token_ids"] == (None if r["text"] is None else encoder.encode(r["text"]).tolist()) for r in got.values())
    assert "<secret>" in got[5]["text"] and got[5]["n_chars"] == len(got[5]["text"])


def test_stage_contract(spark):
    if not os.path.isdir(SF):
        return
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), SF).columns == docs.columns


def test_edges(spark, tmp_path):
    """Nulls, an empty and a very long text, repeated rows, clashing columns; an empty table."""
    long = " ".join(f"word{k} goes" for k in range(60_000))
    rows = [(1, "some words in a row", "en"), (1, "some words in a row", "en"), (None, "no id here", "en"), (3, None, "en"), (4, "", None), (8, "", "en"), (5, long, "en"), (6, "some words in a row", None)]
    ddl = "doc_id long, text string, lang string, n_chars long, row int, node string, group_id int, low int, token_ids int, kept int, `a.b` int"
    docs = spark.createDataFrame([(*r, 0, 1, "n", 1, 1, 1, 1, 7) for r in rows], ddl)
    for name, some, want in (("full", docs, [None, 1, 3, 4, 5]), ("empty", docs.limit(0), [])):
        at = tmp_path / name
        some.write.parquet(str(at / "documents.parquet"))
        spark.createDataFrame([(0, "alpha beta gamma delta epsilon zeta"), (None, None)], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
        spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(at / "labels.parquet"))
        got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(at)).collect()}
        assert sorted(got, key=lambda x: x or 0) == want
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path / "full")).collect()}
    assert got[5]["text"] == long and got[5]["n_tokens"] == len(got[5]["token_ids"]) > 60_000
    assert got[3]["token_ids"] is None and got[4]["token_ids"] == [] and got[1]["a.b"] == 7 and got[1]["node"] == "n"
