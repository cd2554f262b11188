"""Substring dedup by compaction of a de Bruijn graph.

1. One scan cuts each text into words and takes a k-mer of ``K`` words wherever the hash of the next
   ``ANCHOR`` words is the least among ``WINDOW`` neighbouring places. Places chosen so depend on the text
   alone, so equal passages have equal k-mers; every passage of ``LEAST_WORDS`` words holds
   one at least. The k-mers are the edges of the graph.
2. Edges that occur twice or more, anywhere, are kept with their source coordinates.
3. An edge leads to the one that follows it in some text. Where an edge has one successor which has it
   as its one predecessor, the path doesn't branch; such paths compact by pointer doubling, one join
   per doubling, until each edge knows its path's head. Edges of a cycle (a line that is repeated
   over and over) have none and stay paths of their own.
4. In each row, edges whose neighbours follow each other in two sources or more join to spans. Spans break
   where it turns from first occurrences to later ones, so that removing what isn't ``first`` leaves each
   passage once.
5. Source coordinates verify the spans: the words before the first edge and after the last are compared
   with those at the source, one by one, and the span grows until they differ. A stretch of adjoining spans
   is reported when it has ``LEAST_WORDS`` words or more, so nothing shorter is, and nothing that
   long is missed.

Ends are those of the common passage with the span's source; a third text that shares a longer
passage than that source is a further occurrence, whose own span tells so. Adjoining spans of a row may overlap
by less than ``WINDOW`` words.

Defined results: null, empty and shorter texts have no spans; long texts are searched whole; repeats
within a text count as those between texts; of equal rows the one read first is the first; of two
sources the first occurrence is taken, for the first occurrence itself the last; an
empty table gives an empty result; other columns, whatever their names, are ignored by the report
and kept by removal. Removal cuts the original text, whose case and bytes elsewhere stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from .common import discard, materialize, mix64, release, strings_by_size
from .words import char_places, grams, split_words

K = 32
WINDOW = 19
ANCHOR = 8
LEAST_WORDS = K + WINDOW - 1
CHARS_AT_ONCE = 500_000


def kmers(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, first word, hash)`` of each chosen k-mer, in order."""
    w = split_words(texts)
    total = w.hashes.size
    none = np.zeros(0, np.int64)
    if total < K:
        return none, none, none
    h, whole = grams(w, ANCHOR)
    last = np.repeat(w.offsets[1:], np.diff(w.offsets))
    whole = np.arange(total) + K <= last  # a k-mer fits
    h = np.where(whole, h, np.uint64(0xFFFFFFFFFFFFFFFF))
    # Least hash of every window, by doubling; then the place that holds it.
    least, size = h.copy(), 1
    while size < WINDOW:
        step = min(size, WINDOW - size)
        least[:-step] = np.minimum(least[:-step], least[step:])
        size += step
    chosen = np.zeros(total, bool)
    inside = whole.copy()
    for k in range(WINDOW):  # place i is chosen when a window that begins at i - k has it as its least
        n = total - k
        chosen[k:] |= (h[k:] == least[:n]) & inside[:n] & inside[k:]
    at = np.flatnonzero(chosen)
    # The hash of K words from sums of powers: order matters, length is fixed.
    with np.errstate(over="ignore"):
        full = np.zeros(at.size, np.uint64)
        for k in range(K):
            full = full * np.uint64(0x9FB21C651E98DF25) + w.hashes[at + k]
    text = np.searchsorted(w.offsets, at, "right") - 1
    return text, at - w.offsets[text], mix64(full).view(np.int64)


def _paths(docs: DataFrame, id_col: str, text_col: str, row_col: str | None) -> DataFrame:
    """``(row, doc_id, key, edges, starts)`` of each row with an edge; ``key`` is the text's digest."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for run in strings_by_size((t or "" for t in texts), CHARS_AT_ONCE):
                text, start, edge = kmers([texts[i] for i in run])
                has = np.unique(text)
                if not has.size:
                    continue
                offsets = pa.array(np.append(np.searchsorted(text, has), text.size).astype(np.int32))
                where = pa.array(has + run[0])
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(where) for c in ("row", "doc_id", "key")), pa.ListArray.from_arrays(offsets, pa.array(edge)), pa.ListArray.from_arrays(offsets, pa.array(start.astype(np.int32)))], ["row", "doc_id", "key", "edges", "starts"])
            release()

    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(number.alias("row"), F.col(id_col).alias("doc_id"), F.md5(text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, f"row long, doc_id {kind}, key string, edges array<long>, starts array<int>")


def _repeated(spark, paths: DataFrame) -> DataFrame:
    """``(row, doc_id, i, edge, start)`` of each occurrence of an edge that occurs twice or more."""
    often = paths.select(F.explode("edges").alias("edge")).groupBy("edge").count().where("count > 1").select("edge")
    all_ = paths.select("row", "doc_id", F.posexplode(F.arrays_zip("edges", "starts")).alias("i", "at")).select("row", "doc_id", "i", F.col("at.edges").alias("edge"), F.col("at.starts").alias("start"))
    return materialize(spark, all_.join(often, "edge", "left_semi").select("row", "doc_id", "i", "edge", "start"), "repeated")


def compacted(spark, links: DataFrame, edges: DataFrame) -> DataFrame:
    """``(edge, path)``: the head of each edge's nonbranching path; ``links(a, b)`` are distinct.

    An edge on a nonbranching cycle is its own path.
    """
    # Only links that are the one way in as well as the one way out compact.
    way_out = links.groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("n")).where("n = 1 and a != b").select("a", "b")
    way_in = links.groupBy("b").agg(F.count("*").alias("n")).where("n = 1").select("b")
    back = way_out.join(way_in, "b", "left_semi").select(F.col("b").alias("edge"), F.col("a").alias("before"))
    now = materialize(spark, edges.join(back, "edge", "left").select("edge", F.coalesce("before", "edge").alias("to"), F.col("before").isNull().alias("ended"), F.least("edge", F.coalesce("before", "edge")).alias("least")), "compact")
    seen = None
    while True:
        left, least = now.where("not ended").agg(F.count("*"), F.bit_xor(F.xxhash64("edge", "least"))).first()
        if not left or (left, least) == seen:
            return now.select("edge", F.when(F.col("ended"), F.col("to")).otherwise(F.col("edge")).alias("path"))
        seen = (left, least)
        ahead = now.select(F.col("edge").alias("to"), F.col("to").alias("to2"), F.col("ended").alias("ended2"), F.col("least").alias("least2"))
        moved = now.where("not ended").join(ahead, "to").select("edge", F.col("to2").alias("to"), F.col("ended2").alias("ended"), F.least("least", "least2").alias("least"))
        after = materialize(spark, now.where("ended").unionByName(moved), "compact")
        discard(now)
        now = after


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, start_word, words, copies, paths, first, source_id, source_word)`` of each repeated span.

    ``copies`` is the least number of occurrences among its edges, ``paths`` the number of compacted
    paths it runs through, ``first`` whether it holds their first occurrences; the source is another
    occurrence of it.
    """
    return _spans(docs, id_col, text_col).select("doc_id", "start_word", "words", "copies", "paths", "first", "source_id", "source_word")


def _spans(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    rows = materialize(spark, _paths(docs, id_col, text_col, row_col), "paths")
    found = _repeated(spark, rows)
    place = F.struct("row", "i", "doc_id", "start")
    known = found.groupBy("edge").agg(F.count("*").alias("copies"), F.min(place).alias("low"), F.max(place).alias("high"))
    by_row = Window.partitionBy("row").orderBy("i")
    step = found.select("row", "i", "edge", F.lead("i").over(by_row).alias("i2"), F.lead("edge").over(by_row).alias("edge2")).where("i2 = i + 1")
    links = materialize(spark, step.groupBy(F.col("edge").alias("a"), F.col("edge2").alias("b")).agg(F.count("*").alias("n")), "links")
    paths = compacted(spark, links.select("a", "b"), known.select("edge"))
    nodes = materialize(spark, known.join(paths, "edge"), "nodes")
    discard(paths)
    is_first = (F.col("low.row") == F.col("row")) & (F.col("low.i") == F.col("i"))
    joined = found.join(nodes, "edge").select("row", "doc_id", "i", "edge", "start", "copies", "path", is_first.alias("first"), F.when(is_first, F.col("high")).otherwise(F.col("low")).alias("other"))
    before = joined.withColumns({"i0": F.lag("i").over(by_row), "edge0": F.lag("edge").over(by_row), "first0": F.lag("first").over(by_row)})
    before = before.join(links.where("n > 1").select(F.col("a").alias("edge0"), F.col("b").alias("edge"), F.lit(True).alias("linked")), ["edge0", "edge"], "left")
    apart = F.when((F.col("i0") == F.col("i") - 1) & F.col("linked"), 0).otherwise(1)
    new = F.when((apart == 0) & (F.col("first0") == F.col("first")), 0).otherwise(1)
    upto = by_row.rowsBetween(Window.unboundedPreceding, 0)
    spans = before.withColumns({"run": F.sum(new).over(upto), "stretch": F.sum(apart).over(upto)}).groupBy("row", "run").agg(
        F.first("stretch").alias("stretch"),
        F.first("doc_id").alias("doc_id"),
        F.min("start").alias("from"),
        (F.max("start") + K).cast("int").alias("to"),
        F.min("copies").alias("copies"),
        F.count_distinct("path").cast("int").alias("paths"),
        F.first("first").alias("first"),
        F.min_by("other", "i").alias("other"),
        F.max_by("other", "i").alias("other_end"),
    )
    spans = materialize(spark, spans, "spans")
    for used in (found, links, nodes):
        discard(used)
    grown = materialize(spark, _grown(docs, text_col, rows.select("row", "key"), spans), "grown")
    discard(rows)
    discard(spans)
    return grown


def _grown(docs: DataFrame, text_col: str, keys: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans that are long enough, with the words at both ends that equal those at their sources."""
    spark = docs.sparkSession
    left = F.struct(F.lit(False).alias("right"), F.col("from").alias("at"), F.col("other.row").alias("row2"), F.col("other.start").alias("at2"))
    right = F.struct(F.lit(True).alias("right"), F.col("to").alias("at"), F.col("other_end.row").alias("row2"), (F.col("other_end.start") + K).cast("int").alias("at2"))
    ends = spans.select("row", "run", F.explode(F.array(left, right)).alias("e")).select("row", "run", "e.*")
    ends = ends.join(keys, "row").join(keys.select(F.col("row").alias("row2"), F.col("key").alias("key2")), "row2")
    ends = materialize(spark, ends.select("row", "run", "right", "key", "at", "key2", "at2"), "ends")
    asked = ends.select("key", "at", "right").unionByName(ends.select(F.col("key2").alias("key"), F.col("at2").alias("at"), "right"))
    asked = asked.groupBy("key").agg(F.collect_set(F.struct("at", "right")).alias("asked"))  # no more than the text has places
    texts = docs.select(F.md5(text_col).alias("key"), F.col(text_col).alias("text")).where("key is not null")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            keys_, texts_, asks = (b.column(c).to_pylist() for c in ("key", "text", "asked"))
            fresh = []
            for i, key in enumerate(keys_):  # copies follow each other
                if key != last:
                    fresh.append(i)
                last = key
            for run in strings_by_size((texts_[i] for i in fresh), CHARS_AT_ONCE):
                own = [fresh[i] for i in run]
                out = surroundings([texts_[i] for i in own], [[(x["at"], x["right"]) for x in asks[i]] for i in own])
                of, at, right_, words, sizes = out
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys_[own[i]] for i in of]), pa.array(at, pa.int32()), pa.array(right_), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(words))],
                    ["key", "at", "right", "words"],
                )
            release()

    around = texts.join(asked, "key").sortWithinPartitions("key").mapInArrow(read, "key string, at int, right boolean, words array<int>").dropDuplicates(["key", "at", "right"])
    around = materialize(spark, around, "around")
    both = ends.join(around, ["key", "at", "right"]).join(around.select(F.col("key").alias("key2"), F.col("at").alias("at2"), "right", F.col("words").alias("words2")), ["key2", "at2", "right"])
    differ = F.array_position(F.zip_with("words", "words2", lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    more = both.select("row", "run", "right", F.when(differ == 0, F.size("words")).otherwise(differ - 1).cast("int").alias("more"))
    more = more.groupBy("row", "run").agg(F.max(F.when(~F.col("right"), F.col("more"))).alias("before"), F.max(F.when(F.col("right"), F.col("more"))).alias("after"))
    whole = spans.join(more, ["row", "run"]).withColumns({"start_word": F.col("from") - F.col("before"), "end": F.col("to") + F.col("after"), "source_word": F.col("other.start") - F.col("before")})
    stretch = Window.partitionBy("row", "stretch")
    long = whole.withColumn("long", F.max("end").over(stretch) - F.min("start_word").over(stretch)).where(F.col("long") >= LEAST_WORDS)
    return long.select("row", "doc_id", "start_word", (F.col("end") - F.col("start_word")).alias("words"), "copies", "paths", "first", F.col("other.doc_id").alias("source_id"), "source_word")


def surroundings(texts: list[str], asked: list[list[tuple[int, bool]]]) -> tuple[list[int], list[int], list[bool], np.ndarray, list[int]]:
    """For each place asked for: its text, the place and side, and up to ``WINDOW`` words to that side of it, the nearest first, as 32-bit hashes."""
    w = split_words(texts)
    low = w.hashes.astype(np.uint32).view(np.int32)
    of, at, right, parts = [], [], [], []
    for i, places in enumerate(asked):
        first, last = int(w.offsets[i]), int(w.offsets[i + 1])
        for place, after in places:
            p = first + place
            of.append(i)
            at.append(place)
            right.append(after)
            parts.append(low[p : min(p + WINDOW, last)] if after else low[max(p - WINDOW, first) : p][::-1])
    return of, at, right, np.concatenate(parts) if parts else np.zeros(0, np.int32), [x.size for x in parts]


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns; from each text the words of later occurrences are cut."""
    spark = docs.sparkSession
    # Written once with its row numbers, so that a recomputed scan can't number rows otherwise.
    packed = materialize(spark, docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("kept"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").alias("doc_id")), "numbered")
    spans = _spans(packed, "doc_id", "text", "row").where("not first").groupBy("row").agg(F.collect_list(F.struct("start_word", "words")).alias("cuts"))
    spans = materialize(spark, spans, "cuts")
    @F.pandas_udf(StringType())
    def cut(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([t if c is None or t is None else _cut(t, [(x["start_word"], x["words"]) for x in c]) for t, c in zip(texts, cuts, strict=True)], dtype=object)

    joined = packed.join(spans, "row", "left").withColumn("text", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(cut("text", "cuts")))
    return joined.select(*(F.col("text").alias(c) if c == text_col else F.col(f"kept.`{c}`").alias(c) for c in docs.columns))


def _cut(text: str, cuts: list[tuple[int, int]]) -> str:
    w = split_words([text])
    place = char_places(text)
    at, parts = 0, []
    for start, n in sorted(cuts):
        begin, end = place(int(w.starts[start])), place(int(w.ends[start + n - 1]))
        if end <= at:
            continue
        parts.append(text[at : max(begin, at)])
        at = end
    return "".join([*parts, text[at:]])
