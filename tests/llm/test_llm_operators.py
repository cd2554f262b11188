"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import itertools
import random

import numpy as np
import pytest

from loomgraph.llm import bpe, decontamination, embeddings, language, near_dup, quality, secrets, substrings, toxicity
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


# 1 secrets
def test_secrets(spark):
    rng = random.Random(1)
    value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    mixed = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32))
    texts = [f'x token = "{value}" y', f"api_key: '{mixed}'", 'password = "changeme123changeme123"', "the secret of the forest was kept", 'token = "0123456789abcdef0123456789abcdef"', f"plain {value} hash", f'token = "{value}" token = "{value}"']
    got = secrets.find_secrets(frame(spark, texts)).collect()
    assert sorted((r["doc_id"], r["start"]) for r in got) == [(0, texts[0].index(value)), (1, texts[1].index(mixed)), (6, 9), (6, 9 + len(value) + 11)]
    assert all(value not in str(r) and mixed not in str(r) for r in got)
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(frame(spark, texts)).collect()}
    assert clean[0] == 'x token = "<secret>" y' and clean[2] == texts[2] and clean[6].count("<secret>") == 2


# 2 substrings
def test_repeated_spans_cover_brute_force(spark):
    rng = random.Random(2)
    passage, short = prose(rng, 60), prose(rng, 20)
    texts = [prose(rng, 120) for _ in range(12)]
    texts[1] += " " + passage + " " + prose(rng, 40)
    texts[5] = prose(rng, 30) + " " + passage
    texts[7] += " " + short
    texts[8] = short + " " + texts[8]
    texts.append(texts[3])
    texts.append("again and " * 200)
    got = substrings.repeated_spans(frame(spark, texts)).collect()
    tokens = [words(t) for t in texts]
    seen = {}
    for d, t in enumerate(tokens):
        for i in range(len(t) - substrings.K + 1):
            seen.setdefault(tuple(t[i : i + substrings.K]), []).append((d, i))
    covered = {(d, i + k) for at in seen.values() if len(at) > 1 for d, i in at for k in range(substrings.K)}
    for r in got:
        assert {(r["doc_id"], r["start_word"] + k) for k in range(r["words"])} <= covered
        assert tokens[r["source_id"]][r["source_word"] : r["source_word"] + substrings.K] == tokens[r["doc_id"]][r["start_word"] : r["start_word"] + substrings.K]
    assert {r["doc_id"] for r in got} == {1, 3, 5, 12, 13}
    for d in (1, 5):
        own = [r for r in got if r["doc_id"] == d]
        assert len(own) == 1 and own[0]["words"] == 60 and own[0]["first"] == (d == 1) and own[0]["paths"] == 1
    cut = {r["doc_id"]: r["text"] for r in substrings.without_repeats(frame(spark, texts)).collect()}
    assert cut[1] == texts[1] and words(cut[5]) == tokens[5][:30] and cut[0] == texts[0] and len(cut) == len(texts)


def test_every_window_of_fifty_has_an_edge():
    rng = random.Random(4)
    for _ in range(40):
        text, at, _ = substrings.kmers([prose(rng, 50, rng.choice([3, 50, 4000]))])
        assert at.size


def test_compaction(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (9, 4), (6, 7), (7, 8), (8, 6)], "a long, b long")
    edges = spark.createDataFrame([(i,) for i in range(1, 10)], "edge long")
    got = {r["edge"]: r["path"] for r in substrings.compacted(spark, links, edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 9, 6: 6, 7: 7, 8: 8}  # a branch at 4; 6, 7, 8 are a cycle


# 3 decontamination
def test_longest_matches_are_brute_force(spark):
    rng = random.Random(3)
    items = [prose(rng, 30, 60), prose(rng, 8), prose(rng, 40, 60), prose(rng, 3), "", None]
    texts = [prose(rng, 200, 60) for _ in range(10)]
    texts[2] += " " + items[0] + " " + prose(rng, 10)
    texts[4] = " ".join(items[2].split()[5:25]) + " " + texts[4]
    texts[6] += " " + items[1].upper().replace(" ", ", ")
    texts[7] += " " + items[3]
    texts += [items[3].upper() + "!", items[3] + " more"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["words"] for r in decontamination.find_contamination(frame(spark, texts), bench).collect()}
    want = {}
    for d, i in itertools.product(range(len(texts)), range(4)):
        a, b = words(texts[d]), words(items[i])
        longest = max((k for k in range(len(b) + 1) for s in range(len(b) - k + 1) if k and any(a[x : x + k] == b[s : s + k] for x in range(len(a) - k + 1))), default=0)
        if (longest >= min(decontamination.LEAST_WORDS, len(b))) if len(b) >= decontamination.SEED else a == b:
            want[d, i] = longest
    assert got == want and {(2, 0), (4, 2), (6, 1), (10, 3)} <= set(got)
    kept = {r["doc_id"] for r in decontamination.decontaminated(frame(spark, texts), bench).collect()}
    assert kept == set(range(12)) - {d for d, _ in want}


def test_ties_take_the_first_match_and_long_prefixes_agree():
    rng = random.Random(31)
    item = prose(rng, 40)
    test = decontamination.TestSet.of([7, 8], [item, item])
    text = f"{item} stop {item}"
    assert decontamination.matches([text, text], test) == [(t, i, 40, 0, 0) for t in (0, 1) for i in (0, 1)]
    for least in (1, 2, 5, 9, 16, 17, 25, 33, 40):
        assert decontamination.matches([f"x {item} y"], test, least) == [(0, i, 40, 1, 0) for i in (0, 1)]
    assert not decontamination.matches([" ".join(item.split()[:39])], test, 40)
    again = decontamination.TestSet.of([1], ["go " * 30])
    assert decontamination.matches(["go " * 100, "go " * 12], again) == [(0, 0, 30, 0, 0)]


# 4 quality
def test_quality_held_out(spark):
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        body = " ".join(rng.choice(["river", "stone", "walks", "under", "letter", "seven", "garden"]) for _ in range(rng.randrange(20, 60)))
        texts.append(body if good else (" ".join(w.upper() + "!!" for w in body.split()) if i % 2 else " ".join(w + " " + w for w in body.split())))
        labels.append((i, int(good)))
    known = spark.createDataFrame([x for x in labels if x[0] < 200] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r["quality"] for r in quality.score_documents(frame(spark, texts), known).collect()}
    held = [got[i] == y for i, y in labels if i >= 200]
    assert len(got) == 300 and sum(held) / len(held) > 0.95
    one = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    assert {r["quality"] for r in quality.score_documents(frame(spark, texts[:5]), one).collect()} == {1}


def test_dual_coordinate_descent_is_optimal():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    y = x[:, 0] + 0.3 * rng.normal(size=60) > 0
    w, b = quality.dual_coordinate_descent([np.arange(5)] * 60, list(x), y, 5, epochs=400)
    loss = lambda w, b: (w @ w + b * b) / 2 + np.maximum(0, 1 - np.where(y, 1, -1) * (x @ w + b)).sum()
    at = loss(w, b)
    assert all(loss(w + d[:5], b + d[5]) >= at - 0.02 for d in rng.normal(scale=0.05, size=(200, 6)))


# 6 near duplicates
def test_near_duplicates_are_brute_force(spark):
    rng = random.Random(7)
    base = [prose(rng, rng.randrange(60, 150)) for _ in range(40)]
    texts = list(base)
    for b in base[:20]:
        for _ in range(3):
            w = b.split()
            for _ in range(rng.randrange(0, 9)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}y"
            texts.append(" ".join(w))
    got = {r["doc_id"]: r["group_id"] for r in near_dup.near_duplicate_groups(frame(spark, texts)).collect()}
    idf = near_dup.document_frequencies(frame(spark, texts).select("text"))
    sets = []
    for t in texts:
        _, s, c = near_dup.shingle_sets([t])
        sets.append((s, near_dup.weights(s, c, idf)))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if near_dup.jaccard(sets[i], sets[j]) >= near_dup.THRESHOLD]
    for i, j in pairs:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    found = sum(got.get(i, -1) == got.get(j, -2) for i, j in pairs)
    assert found / len(pairs) >= 0.9
    assert all(find(i) == find(g) for i, g in got.items())
    kept = {r["doc_id"] for r in near_dup.deduplicated(frame(spark, texts)).collect()}
    assert kept == {i for i in range(len(texts)) if got.get(i, i) == i}


def test_one_word_texts_and_nodes_that_clash(spark):
    texts = ["Hello", "other text here", "hello.", "HELLO", "lone", "Hello", "one two"]
    groups = {r["doc_id"]: r["group_id"] for r in near_dup.near_duplicate_groups(frame(spark, texts)).collect()}
    assert groups == {0: 0, 2: 0, 3: 0, 5: 0}
    docs = frame(spark, texts)
    node = {r["doc_id"]: r["n"] for r in docs.select("doc_id", near_dup._node("text", []).alias("n")).collect()}
    split = {r["doc_id"]: r["n"] for r in docs.select("doc_id", near_dup._node("text", [node[0]]).alias("n")).collect()}
    assert split[0] == split[5] != node[0] and all(split[i] == node[i] for i in (1, 2, 3, 4, 6))
    assert near_dup._clashes(docs, "text") == []


def test_sampling_estimates_weighted_jaccard():
    rng = random.Random(8)
    a = prose(rng, 300)
    b = " ".join(a.split()[:200] + prose(rng, 100).split())
    at, s, c = near_dup.shingle_sets([a, b])
    weight = np.ones(s.size, np.float32) * (1 + np.log(c)).astype(np.float32)
    same = near_dup.samples(at, s, weight, 2)
    cut = int((at == 0).sum())
    want = near_dup.jaccard((s[:cut], weight[:cut]), (s[cut:], weight[cut:]))
    assert abs((same[0] == same[1]).mean() - want) < 0.25


# 7 language
def test_language(spark):
    rng = random.Random(9)
    parts = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "ung", "ein", "er"], "cc": ["eau", "oux", "tion", "ê"]}
    rows = []
    for k in range(600):
        lang = rng.choice(list(parts))
        rows.append((k, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(10, 40))), lang))
    rows += [(1000, "", "aa"), (1001, None, "bb"), (1002, "12 34 !!", None), (1003, "зздкфлж цвгхщ" * 20, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert sum(got[k]["language"] == lang for k, _, lang in rows[:600]) > 590 and len(got) == len(rows)
    assert all(got[k]["language"] == "und" for k in (1000, 1001, 1002, 1003)) and got[1000]["bits"] is None


def test_language_model_is_a_distribution(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(["abab abba", "baba", "aab", "bbab ab", "abcab"] * 4)], "doc_id long, text string, lang string")
    model = language.train(docs)
    letters = [ord(c) for c in "abc "]
    for head in ("   ", " ab", "aba", "zzz"):
        base = sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(head))
        codes = np.array([base | c for c in letters], np.uint64)
        assert abs(2 ** model.log_probabilities(codes)[:, 0] @ np.ones(4) + model.log_probabilities(np.array([base | ord("q")], np.uint64)).__rpow__(2).sum() - 1) < 1e-5


# 8 toxicity
@pytest.mark.parametrize(("text", "toxic"), [("You are an idiot.", True), ("You are not an idiot.", False), ("He said you are an idiot.", False), ("I will kill you.", True), ("I will not kill you.", False), ("They kill time.", False), ("This is trash. You are pathetic.", True), ("", False), (None, False), ("x " * 50_000 + "you moron", True)])
def test_toxicity(text, toxic):
    assert (toxicity.score_text(text)[0] >= toxicity.THRESHOLD) == toxic


def test_toxicity_composition():
    """The composed table gives what its parts give one after the other."""
    rng = random.Random(10)
    parts = [toxicity.negation(), toxicity.reported(), toxicity.targeted(), toxicity.weighing()]
    for _ in range(300):
        classes = [rng.randrange(10) for _ in range(12)]
        weight, row = 0.0, classes
        for p in parts:
            state, out = 0, []
            for c in row:
                state, c2, w = p.step[state][c]
                weight += w
                out.append(c2)
            row = out
        assert abs(toxicity.GRAMMAR.run(classes)[0] - weight) < 1e-9


# 9 BPE
def test_bpe_is_exact(spark):
    import tiktoken

    tokens = bpe.load_vocabulary()
    exact = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rng = random.Random(11)
    texts = ["", " ", "hello world", "Ünïcödé 漢字 😀👍🏽", "a" * 3000, "\x00\n\n\t x", "<|endoftext|>", None]
    texts += ["".join(chr(rng.choice([32, 97, 98, 101, 116, 104, 0x4E2D, 0x1F600, 10, 48])) for _ in range(rng.randrange(1, 80))) for _ in range(120)]
    got = {r["doc_id"]: r for r in bpe.encode_documents(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i]["exact"]
        assert got[i]["token_ids"] == (None if t is None else exact.encode_ordinary(t))
        assert got[i]["n_tokens"] == (0 if t is None else len(got[i]["token_ids"]))
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(bpe.encode_documents(frame(spark, texts))).collect()}
    assert [back[i] for i in range(len(texts))] == texts


# 10 embeddings
@pytest.mark.parametrize("spread", [0.02, 0.15])
def test_pairs_are_exact(spark, spread):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(60, 16))
    x = (centres[rng.integers(0, 60, 400)] + spread * rng.normal(size=(400, 16))).astype(np.float32)
    x[7] = x[9]
    x[11] = 2 * x[12]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 0), (901, [], 0), (902, [0.0] * 16, 0), (903, [float("nan")] * 16, 0), (904, [1.0, 2.0], 0), (905, [2.0, 4.1], 0), (906, [1.0, None], 0), (None, x[7].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = u @ u.T >= 0.95 - 1e-6
    np.fill_diagonal(near, False)
    want = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(np.triu(near))), strict=True) if 9 not in (i, j)}
    got = {(r["id_a"], r["id_b"]) for r in embeddings.near_pairs(df, home_points=50).collect()}
    assert got == want | {(904, 905)}
    told = {r["vec_id"]: r for r in embeddings.near_links(df, home_points=50).collect()}
    assert {i: told[i]["links"] for i in range(400)} == dict(enumerate(near.sum(1).tolist()))
    assert all(told[i]["class_id"] is None and told[i]["links"] == told[i]["copies"] == 0 for i in (900, 901, 902, 903, 906))
    assert told[904]["links"] == told[905]["links"] == 1 and told[9]["class_id"] == told[7]["class_id"] == 7 and told[9]["copies"] == 2 and told[11]["class_id"] == 11
    assert len(told) == 407
    assert embeddings.near_pairs(df.limit(0)).count() == 0 and embeddings.near_links(df.limit(0)).count() == 0


def test_hot_cluster_clashing_columns_and_ids_of_text(spark):
    rng = np.random.default_rng(13)
    hot = rng.normal(size=8)
    x = np.concatenate([hot + 0.02 * rng.normal(size=(150, 8)), rng.normal(size=(100, 8)), np.repeat(hot[None], 50, 0)]).astype(np.float32)
    rows = [(f"v{i:03d}", v.tolist(), 1, 2, "b", 3, 4) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>, h1 int, class_id int, bucket string, id int, links int")
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = (u @ u.T >= 0.95 - 1e-6).sum(1) - 1
    got = {r["vec_id"]: r for r in embeddings.near_links(df, home_points=20).collect()}
    assert {k: r["links"] for k, r in got.items()} == {f"v{i:03d}": int(n) for i, n in enumerate(want)}
    assert got["v299"]["class_id"] == "v250" and got["v250"]["copies"] == 50


def test_a_tie_with_the_threshold_is_a_link(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, -1.0])], "vec_id int, embedding array<double>")
    assert [(r["id_a"], r["id_b"], r["similarity"]) for r in embeddings.near_pairs(df, threshold=0.6).collect()] == [(1, 2, 0.6)]


def test_links_equal_their_sql(spark):
    import duckdb

    from loomgraph.llm import registry

    sf = "/root/testdata/sf0.001"
    embeddings_ = duckdb.sql(f"select * from '{sf}/embeddings.parquet'")  # noqa: F841
    want = duckdb.sql(registry.SQL["op10_embedding_pairs"].replace("embeddings", "embeddings_")).fetchall()
    got = registry.op10_embedding_pairs(spark, sf).select("vec_id", "class_id", "copies", "links").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 500
