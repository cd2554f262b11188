"""Toxicity by a weighted finite-state pattern grammar.

Words become classes (strong insult, mild insult, threat verb, target, negation, report,
intention, intensifier, clause end, other). Small transducers rewrite the class sequence:
negation cancels an insult or threat a few words later, reported speech tones it down, a target
nearby sharpens it, a threat counts only with its target. Their composition is one dense
transition table, which each clause holding a trigger word runs through. Clauses without a
trigger score 0 under every path of the grammar, so they are never run.

The lexicon is a start in five languages; where labelled documents are given, mild insults are also
learnt from them: words whose log ratio of toxic to clean documents is ``RATIO`` or more in one
language, and over all labels too, and that stand in toxic documents of that language between ``SUPPORT``
different pairs of neighbours (copies of a document are no evidence). A learnt word is as strong as a mild insult, so that one by itself, without a target, makes no document toxic.
However many words are learnt, all count; they are a lexicon, whose size is that of the labels' toxic vocabulary.

Defined results: a null or empty text scores 0; without labels of both kinds nothing is learnt; every matched clause of a text counts, however
long the text; a repeated row is scored like the first; an empty table gives an empty result;
columns other than the id and the text are ignored. A document is toxic when its score is at
least ``threshold``; a score equal to it is toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import batches_of, discard, materialize

THRESHOLD = 1.0
RATIO = 3.0
SUPPORT = 4
WORDS_AT_ONCE = 100_000
BROADCAST_LABELS = 500_000
OTHER, STRONG, MILD, THREAT, TARGET, NEG, REPORT, INTENT, VERY, END = range(10)
# Rewritten classes; the last transducer gives their weights.
CANCELLED, STRONG_REP, MILD_REP, THREAT_REP, STRONG_HIT, MILD_HIT, THREAT_HIT, STRONG_REP_HIT, MILD_REP_HIT, THREAT_REP_HIT = range(10, 20)
N_CLASSES = 20

LEXICON = {
    STRONG: "idiot idiots moron morons scum loser losers imbecile imbeciles bastard bastards asshole assholes bitch bitches scumbag scumbags dumbass retard retards vermin subhuman cretin degenerate idiota idiotas imbécil gilipollas pendejo cabrón connard connasse salaud abruti crétin enculé dummkopf arschloch vollidiot schwachkopf hurensohn miststück",
    MILD: "stupid pathetic clown clowns trash worthless disgusting garbage filth filthy dumb ugly repulsive useless braindead estúpido estúpida asqueroso patético débile minable dégoûtant blöd erbärmlich widerlich wertlos",
    THREAT: "kill murder hurt destroy strangle stab shoot burn beat crush slaughter matar mataré tuer tuerai umbringen töten",
    TARGET: "you your yours yourself u ur he she they them him her his their these those tú usted ustedes vosotros tu toi vous ils elles du dich dir ihr sie",
    NEG: "not no never neither nor without isn't aren't wasn't weren't don't doesn't didn't won't can't cannot ain't hardly nobody nunca jamás ne pas jamais kein keine nicht nie",
    REPORT: "said says say wrote writes reported reportedly claimed claims alleged according quoted quotes called calls shouted yelled accused dijo dice selon sagte schrieb",
    INTENT: "will gonna going shall i'll we'll must should want wants voy vais werde",
    VERY: "very so such total complete utter absolute really fucking damn bloody muy très sehr",
}
CLASS = {w: c for c, words in LEXICON.items() for w in words.split()}
CLASS |= {w.replace("'", "’"): c for w, c in CLASS.items() if "'" in w}
WEIGHT = {STRONG: 1.0, MILD: 0.6, STRONG_HIT: 1.5, MILD_HIT: 1.0, THREAT_HIT: 2.0, STRONG_REP: 0.25, MILD_REP: 0.15, STRONG_REP_HIT: 0.35, MILD_REP_HIT: 0.25, THREAT_REP_HIT: 0.5}

TRIGGERS = frozenset(w for c in (STRONG, MILD, THREAT) for w in LEXICON[c].split())
_PART = re.compile(r"\w+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_END = re.compile(r"[.!?;\n]+")


class Transducer:
    """A complete deterministic transducer: ``step[state][class] = (state, class, weight)``."""

    def __init__(self, step: list[list[tuple[int, int, float]]]):
        self.step = step

    def __rshift__(self, after: Transducer) -> Transducer:
        """The composition: this one's output classes are the other's input; weights add up."""
        index, todo, rows = {(0, 0): 0}, [(0, 0)], []
        for p, q in todo:
            row = []
            for c in range(N_CLASSES):
                p2, c2, w1 = self.step[p][c]
                q2, c3, w2 = after.step[q][c2]
                if (p2, q2) not in index:
                    index[p2, q2] = len(index)
                    todo.append((p2, q2))
                row.append((index[p2, q2], c3, w1 + w2))
            rows.append(row)
        return Transducer(rows)

    def run(self, classes: list[int]) -> tuple[float, int]:
        """Total weight and number of weighted steps."""
        state, total, hits = 0, 0.0, 0
        step = self.step
        for c in classes:
            state, _, w = step[state][c]
            if w:
                total += w
                hits += 1
        return total, hits


def _same(states: int) -> list[list[tuple[int, int, float]]]:
    return [[(s, c, 0.0) for c in range(N_CLASSES)] for s in range(states)]


def negation(reach: int = 4) -> Transducer:
    """An insult or threat up to ``reach`` words after a negation is cancelled, with those right after it."""
    step = _same(reach + 1)
    for s in range(reach + 1):
        for c in range(N_CLASSES):
            step[s][c] = (max(0, s - 1), c, 0.0)
            if c in (STRONG, MILD, THREAT) and s:
                step[s][c] = (reach, CANCELLED, 0.0)
        step[s][NEG] = (0 if s == reach else reach, NEG, 0.0)  # two negations in a row assert
        step[s][END] = (0, END, 0.0)
    return Transducer(step)


def reported() -> Transducer:
    """Whatever follows a verb of saying in its clause is someone else's speech."""
    step = _same(2)
    step[0][REPORT] = (1, REPORT, 0.0)
    step[1][END] = (0, END, 0.0)
    for plain, toned in ((STRONG, STRONG_REP), (MILD, MILD_REP), (THREAT, THREAT_REP)):
        step[1][plain] = (1, toned, 0.0)
    return Transducer(step)


def targeted(reach: int = 4) -> Transducer:
    """An insult near after a target is sharper; a threat becomes one when intention precedes it and a target follows.

    States: 0 nothing; 1..reach a target was seen that many steps ago at most; then pairs for an
    intention, and for a threat (plain, reported) waiting for its target.
    """
    none, seen, intent, wait, wait_rep = 0, range(1, reach + 1), range(reach + 1, 2 * reach + 1), range(2 * reach + 1, 3 * reach + 1), range(3 * reach + 1, 4 * reach + 1)
    step = _same(4 * reach + 1)
    for s in range(4 * reach + 1):
        fade = none if s == none or (s - 1) % reach == 0 else s - 1
        hot = s in seen
        for c in range(N_CLASSES):
            step[s][c] = (fade, c, 0.0)
        step[s][TARGET] = (seen[-1], THREAT_HIT if s in wait else THREAT_REP_HIT if s in wait_rep else TARGET, 0.0)
        step[s][INTENT] = (intent[-1], INTENT, 0.0)
        step[s][VERY] = (s, VERY, 0.0)
        step[s][END] = (none, END, 0.0)
        for plain, hit in ((STRONG, STRONG_HIT), (MILD, MILD_HIT), (STRONG_REP, STRONG_REP_HIT), (MILD_REP, MILD_REP_HIT)):
            step[s][plain] = (s if hot else fade, hit if hot else plain, 0.0)
        for plain, waiting in ((THREAT, wait), (THREAT_REP, wait_rep)):
            step[s][plain] = (waiting[-1] if s in intent else fade, plain, 0.0)
    return Transducer(step)


def weighing() -> Transducer:
    return Transducer([[(0, c, WEIGHT.get(c, 0.0)) for c in range(N_CLASSES)]])


GRAMMAR = negation() >> reported() >> targeted() >> weighing()


def score_text(text: str | None, learnt: frozenset[str] = frozenset()) -> tuple[float, int]:
    """Score and number of matched clauses."""
    if not text or not _triggered(low := text.lower(), learnt):
        return 0.0, 0
    total, matched = 0.0, 0
    for clause in _END.split(low):
        if not _triggered(clause, learnt):
            continue
        w, hits = GRAMMAR.run([CLASS.get(x) or (MILD if x in learnt else OTHER) for x in _WORD.findall(clause)])
        if hits:
            total += w
            matched += 1
    return total, matched


def _triggered(low: str, learnt: frozenset[str]) -> bool:
    parts = _PART.findall(low)
    return not TRIGGERS.isdisjoint(parts) or not (learnt.isdisjoint(parts) and learnt.isdisjoint(_WORD.findall(low)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_id: str = "doc_id", label_col: str = "toxic") -> frozenset[str]:
    """The words that mark toxic documents; counts are exact and run over all labelled documents, of toxic ones by surroundings."""
    marks = labels.select(F.col(label_id).alias("label_id"), F.col(label_col).cast("double").alias("label")).where("label_id is not null and label is not null")
    marks = marks.groupBy("label_id").agg((F.avg("label") > 0.5).alias("toxic"))
    # A label takes some 60 bytes, so that 30 MB are broadcast at most; beyond this number both sides shuffle.
    small = marks.count() <= BROADCAST_LABELS
    lang = F.coalesce(F.col(lang_col), F.lit("")) if lang_col in docs.columns else F.lit("")
    texts = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text"), lang.alias("lang")).where("text is not null")
    rows = texts.join(F.broadcast(marks) if small else marks, "label_id").select("lang", "text", "toxic")
    sizes = {(r["lang"], r["toxic"]): r["n"] for r in rows.groupBy("lang", "toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = (sum(n for (_, t), n in sizes.items() if t == x) for x in (True, False))
    if not n_toxic or not n_clean:
        return frozenset()
    known = F.col("word").isin(sorted(CLASS))
    often = materialize(docs.sparkSession, _surroundings(rows.where("toxic")).where((F.col("around") >= SUPPORT) & ~known), "toxic-words")
    # What is broadcast has a bound; beyond it the clean documents' words are counted whole and joined. The result is the same.
    few = often.select("word").distinct().limit(WORDS_AT_ONCE + 1).collect()
    if not few:
        return frozenset()
    clean = _document_counts(rows.where("not toxic"), frozenset(r["word"] for r in few) if len(few) <= WORDS_AT_ONCE else None)
    clean = materialize(docs.sparkSession, clean, "clean-words")
    sums = docs.sparkSession.createDataFrame([(x, sizes.get((x, True), 0), sizes.get((x, False), 0)) for x in sorted({x for x, _ in sizes})], "lang string, of_toxic long, of_clean long")

    def ratio(toxic: Column, of_toxic: Column, clean: Column, of_clean: Column) -> Column:
        return F.log((toxic + 0.5) / (of_toxic + 1)) - F.log((F.coalesce(clean, F.lit(0)) + 0.5) / (of_clean + 1))

    by_lang = often.join(clean, ["lang", "word"], "left").join(sums, "lang")
    by_lang = by_lang.where(ratio(F.col("around"), F.col("of_toxic"), F.col("docs"), F.col("of_clean")) >= RATIO).select("word").distinct()
    over_all = often.groupBy("word").agg(F.sum("around").alias("around")).join(clean.groupBy("word").agg(F.sum("docs").alias("docs")), "word", "left")
    over_all = over_all.where(ratio(F.col("around"), F.lit(n_toxic), F.col("docs"), F.lit(n_clean)) >= RATIO)
    found = frozenset(r["word"] for r in over_all.join(by_lang, "word", "left_semi").select("word").collect())
    discard(often)
    discard(clean)
    return found


def _surroundings(rows: DataFrame) -> DataFrame:
    """``(lang, word, around)``: between how many pairs of neighbours each word first stands in a document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: set[tuple[str, str, str]] = set()
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = ["", *_WORD.findall(text.lower()), ""]
                first = {w: k for k, w in reversed([*enumerate(words)][1:-1])}
                held.update((lang, w, f"{words[k - 1]} {words[k + 1]}") for w, k in first.items())
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*held, strict=True)], ["lang", "word", "pair"])

    found = rows.select("lang", "text").mapInArrow(scan, "lang string, word string, pair string")
    return found.select("lang", "word", F.xxhash64("pair").alias("pair")).distinct().groupBy("lang", "word").agg(F.count("*").alias("around"))


def _document_counts(rows: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """``(lang, word, docs)``: how many documents of a language hold each of the words, or each word there is."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: Counter[tuple[str, str]] = Counter()
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = set(_WORD.findall(text.lower()))
                held.update((lang, w) for w in (found if shared.value is None else shared.value & found))
            if held:
                langs, words = zip(*held, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(words), pa.array(held.values(), pa.int64())], ["lang", "word", "docs"])

    return rows.select("lang", "text").mapInArrow(scan, "lang string, word string, docs long").groupBy("lang", "word").agg(F.sum("docs").alias("docs"))


def toxicity_score(text: Column, learnt: frozenset[str] = frozenset()) -> Column:
    """The score as a column, for filters that keep whole rows."""

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([score_text(t, learnt)[0] for t in texts], dtype="float64")

    return score(text)


def toxic_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, labels: DataFrame | None = None) -> DataFrame:
    """``(doc_id, score, clauses)`` of each row whose score reaches the threshold. One scan after learning, no shuffle of texts."""
    kind = docs.schema[id_col].dataType.simpleString()
    learnt = frozenset() if labels is None else learn(docs, labels, id_col, text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in batches_of(batches, "text"):
            found = [score_text(t, learnt) for t in texts]
            keep = [i for i, (s, _) in enumerate(found) if s >= threshold]
            if keep:
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(keep)), pa.array([round(found[i][0], 4) for i in keep]), pa.array([found[i][1] for i in keep], pa.int32())], ["doc_id", "score", "clauses"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, f"doc_id {kind}, score double, clauses int")


def clean_documents(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, labels: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """The rows below the threshold, with all their columns."""
    learnt = frozenset() if labels is None else learn(docs, labels, id_col, text_col)
    return docs.where(toxicity_score(F.col(text_col), learnt) < F.lit(threshold))
