"""Embedding near-dup pairs by dual traversal of cover trees.

Vectors are scaled to length 1, so a cosine of ``threshold`` is the distance
``eps = sqrt(2 - 2 * threshold)``. Equal vectors are one class; only a class's vector is compared, and its links count
for each of its copies.

Classes go to the nearest of a net of centres, and a cell with more than ``HOME_POINTS`` of them is cut into buckets of
about that many. A partner of point ``p`` in another cell can't lie farther from ``p`` than ``eps``, so ``p`` visits a cell
only if its centre is at most ``d(p, own centre) + 2 * eps`` away (triangle) and the plane midway between both
centres at most ``eps``; of two buckets the parity of their numbers says in which one their points meet. Each task
holds one bucket's home points; visitors stream past, so its memory has a bound however many they are.

In each bucket the home points get a cover tree, and so do the visitors of each batch: nested levels, the radius halves
from level to level, each point of a level within the radius of its parent; what a level's balls don't cover, as in data
without clusters, stays one node. Two trees are traversed together: a pair of nodes whose distance is more than
``eps`` plus both covering radii is pruned; one whose distance plus both radii is within ``eps`` consists of links
only and is counted without looking at its points; of the rest both nodes are split, down to leaves that are compared
exactly. The result is exactly the links within the threshold, whichever centres were drawn.

Defined results: null vectors, and those that are empty, hold a null or a non-finite number or have no
direction (all 0), have no class and no links; vectors are compared with those of their own width; equal vectors are links of
similarity 1, repeated rows too; a similarity equal to the threshold is a link (within 1e-6); rows with a null id are
left out, nor do they count; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

THRESHOLD = 0.95
HOME_POINTS = 4_096
MOST_CENTRES = 1 << 15
MOST_PARTITIONS = 20_000
LEAF = 32
HEADS_AT_ONCE = 64
BLOCK = 1_024
SLACK = 1e-6
#: Distances come from single precision products, whose root is off by this at most near 0.
LOOSE = 1e-2


class CoverTree:
    """Nodes in arrays: ``centre`` (a row), ``radius`` (to its farthest descendant), ``children`` and ``members``."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        if len(points):
            everyone = np.arange(len(points))
            far = distances(points, points[:1])[:, 0]
            todo = [(self._node(0, everyone, far), far, float(far.max()))]
            while todo:
                todo += self._split(*todo.pop())

    def _node(self, centre: int, members: np.ndarray, far: np.ndarray) -> int:
        self.centre.append(centre)
        self.radius.append(float(far.max()))
        self.children.append([])
        self.members.append(members)
        return len(self.centre) - 1

    def _split(self, node: int, far: np.ndarray, level: float) -> list[tuple[int, np.ndarray, float]]:
        """The children of a node, each with the distances of its members and the radius of their level."""
        members = self.members[node]
        if members.size <= LEAF or self.radius[node] <= LOOSE:
            return []
        level = min(level, self.radius[node]) / 2
        points = self.points[members]
        owner = np.where(far <= level, 0, -1)
        near = far.copy()
        heads = [self.centre[node]]
        open_ = np.flatnonzero(owner < 0)
        while open_.size:
            block = open_[:: max(1, open_.size // HEADS_AT_ONCE)][:HEADS_AT_ONCE]
            d = distances(points[open_], points[block])
            # A head that a former one of the block covers is none.
            within = distances(points[block], points[block]) <= level
            chosen: list[int] = []
            for k in range(block.size):
                if not within[k, chosen].any():
                    chosen.append(k)
            d = d[:, chosen]
            best = d.argmin(1)
            least = d[np.arange(open_.size), best]
            taken = least <= level
            owner[open_[taken]] = len(heads) + best[taken]
            near[open_[taken]] = least[taken]
            heads += members[block[chosen]].tolist()
            few = taken.sum() < max(open_.size / 4, 2 * len(chosen))
            open_ = open_[~taken]
            if few:
                break
        sizes = np.bincount(owner[owner >= 0], minlength=len(heads))
        own = np.flatnonzero(sizes >= LEAF)
        if not own.size or sizes.max() == members.size:
            # All in one child: the level was too wide for this node, so go on below with the next.
            return self._split(node, far, level) if own.size and level > LOOSE else []
        found = []
        for k in own.tolist():
            mine = np.flatnonzero(owner == k)
            child = self._node(int(heads[k]), members[mine], near[mine])
            self.children[node].append(child)
            found.append((child, near[mine], level))
        loose = np.flatnonzero(~np.isin(owner, own))
        if loose.size:
            self.children[node].append(self._node(self.centre[node], members[loose], far[loose]))
        return found


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between unit vectors."""
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def traverse(left: CoverTree, right: CoverTree, eps: float, compare: Callable, whole: Callable | None = None) -> None:
    """Calls ``compare(rows, rows, same)`` for pairs of leaves and, if given, ``whole(rows, rows, same)`` for pairs of nodes that are within ``eps`` throughout; of a tree with itself each pair once."""
    if not left.centre or not right.centre:
        return
    same = left is right
    (ca, ra), (cb, rb) = ((np.array(t.centre), np.array(t.radius)) for t in (left, right))
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        twin = same and i == j
        apart = 0.0 if twin else float(distances(left.points[ca[i]][None], right.points[cb[j]][None])[0, 0])
        if whole and apart + ra[i] + rb[j] + LOOSE <= eps:
            whole(left.members[i], right.members[j], twin)
            continue
        kids_a, kids_b = np.array(left.children[i] or [i]), np.array(right.children[j] or [j])
        if not left.children[i] and not right.children[j]:
            compare(left.members[i], right.members[j], twin)
            continue
        keep = distances(left.points[ca[kids_a]], right.points[cb[kids_b]]) <= eps + ra[kids_a][:, None] + rb[kids_b][None] + LOOSE
        if twin:
            keep = np.triu(keep)
        x, y = np.nonzero(keep)
        todo += zip(kids_a[x].tolist(), kids_b[y].tolist(), strict=True)


class Side:
    """Points of a task: their class ids, copies and vectors as given; ``links`` counts up."""

    def __init__(self, ids: pa.Array, copies: np.ndarray, raw: np.ndarray):
        self.ids, self.copies, self.raw = ids, copies.astype(np.float64), raw
        exact = raw.astype(np.float64)
        self.unit = (exact / np.linalg.norm(exact, axis=1, keepdims=True)).astype(np.float32)
        self.links = np.zeros(len(raw))


def _exact(a: Side, b: Side, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    p, q = a.raw[x].astype(np.float64), b.raw[y].astype(np.float64)
    return np.einsum("ij,ij->i", p, q) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1))


def meet(a: Side, b: Side, trees: tuple[CoverTree, CoverTree], threshold: float, pairs: list | None = None) -> None:
    """Adds the links of two sides, or of one with itself, to their counts, or to ``pairs`` as ``(row, row, similarity)``."""
    eps = math.sqrt(max(0.0, 2 - 2 * threshold))
    margin = 1e-5 + 2e-7 * a.unit.shape[1]

    def compare(rows: np.ndarray, others: np.ndarray, twin: bool) -> None:
        for s in range(0, rows.size, BLOCK):
            for t in range(s if twin else 0, others.size, BLOCK):
                x, y = rows[s : s + BLOCK], others[t : t + BLOCK]
                likeness = a.unit[x] @ b.unit[y].T
                if likeness.max() < threshold - margin:
                    continue
                close = likeness >= threshold - margin
                if twin and s == t:
                    close = np.triu(close, 1)
                if pairs is None:  # what lies within the margin is judged exactly, the rest at once
                    sure = close & (likeness > threshold + margin)
                    hits = sure.astype(np.float32)
                    a.links[x] += hits @ b.copies[y]
                    b.links[y] += a.copies[x] @ hits
                    close &= ~sure
                i, j = np.nonzero(close)
                if i.size:
                    found = _exact(a, b, x[i], y[j])
                    keep = found >= threshold - SLACK
                    i, j = x[i[keep]], y[j[keep]]
                    if pairs is None:
                        np.add.at(a.links, i, b.copies[j])
                        np.add.at(b.links, j, a.copies[i])
                    else:
                        pairs.append((i, j, found[keep]))

    def whole(rows: np.ndarray, others: np.ndarray, twin: bool) -> None:
        if twin:
            a.links[rows] += a.copies[rows].sum() - a.copies[rows]
        else:
            a.links[rows] += b.copies[others].sum()
            b.links[others] += a.copies[rows].sum()

    traverse(*trees, eps, compare, whole if pairs is None else None)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one width."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(len(column), -1)


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v, h1, h2)`` of each row with an id; ``v`` is null where there is no direction."""
    v = F.col(vector_col).cast("array<float>")
    # Squares of tiny numbers vanish in single precision, so the norm is taken in double.
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sound = (square > 0) & (square < float("inf"))
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.when(sound, v).alias("v"))
    return rows.withColumns({"h1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "h2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v"))})


def _classes(rows: DataFrame) -> DataFrame:
    """``(h1, h2, class_id, copies, v)`` of each class of equal vectors, by 128 bits of hash."""
    return rows.where("v is not null").groupBy("h1", "h2").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"), F.first("v").alias("v"))


def _nets(classes: DataFrame, home_points: int) -> dict[int, tuple[int, np.ndarray]]:
    """By width of the vectors the number of the first cell and the centres, ``MOST_CENTRES`` and 64 MB of them at most."""
    counts = {r["width"]: r["count"] for r in classes.groupBy(F.size("v").alias("width")).count().collect()}
    share = (64 << 20) / max(1, sum(8 * w * math.ceil(n / home_points) for w, n in counts.items()))
    nets, first = {}, 0
    for width, n in sorted(counts.items()):
        # Which classes become centres changes the cells' sizes only, never the links.
        wanted = max(1, min(MOST_CENTRES, int(math.ceil(n / home_points) * min(1.0, share))))
        drawn = classes.where(F.size("v") == width).orderBy("h1", "h2").limit(wanted).select("v").collect()
        centres = np.array([r["v"] for r in drawn], np.float64)
        nets[width] = first, (centres / np.linalg.norm(centres, axis=1, keepdims=True)).astype(np.float32)
        first += len(centres)
    return nets


def _by_width(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = np.asarray(b.column("v").value_lengths())
    for width in np.unique(sizes).tolist():
        yield width, b.take(pa.array(np.flatnonzero(sizes == width)))


def _unit(raw: np.ndarray) -> np.ndarray:
    exact = raw.astype(np.float64)
    return (exact / np.linalg.norm(exact, axis=1, keepdims=True)).astype(np.float32)


def _met(classes: DataFrame, threshold: float, home_points: int, listed: bool) -> DataFrame:
    """``(id_a, id_b, similarity)`` of linked classes, the smaller id first; if not ``listed``, ``(class_id, links)`` in parts that add up."""
    spark = classes.sparkSession
    kind = classes.schema["class_id"].dataType.simpleString()
    eps = math.sqrt(max(0.0, 2 - 2 * threshold))
    nets = spark.sparkContext.broadcast(_nets(classes, home_points))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for width, b in _by_width(whole):
                first, centres = nets.value[width]
                own = np.concatenate([distances(u, centres).argmin(1) for u in _pieces(_unit(_matrix(b.column("v"))))])
                yield pa.RecordBatch.from_arrays([pa.array((own + first).astype(np.int32)), *(b.column(c) for c in ("h1", "class_id", "copies", "v"))], ["cell", "h1", "class_id", "copies", "v"])

    homes = materialize(spark, classes.select("h1", "class_id", "copies", "v").mapInArrow(assign, f"cell int, h1 long, class_id {kind}, copies long, v array<float>"), "homes")
    cells = sum(len(c) for _, c in nets.value.values())
    held = np.zeros(cells, np.int64)
    for r in homes.groupBy("cell").count().collect():
        held[r["cell"]] = r["count"]
    cuts = np.maximum(1, -(-held // (2 * home_points)))
    starts = spark.sparkContext.broadcast(np.concatenate([[0], np.cumsum(cuts)]))
    buckets = int(cuts.sum())

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = starts.value
        for whole in batches:
            for width, b in _by_width(whole):
                first, centres = nets.value[width]
                units, own_cells = _unit(_matrix(b.column("v"))), np.asarray(b.column("cell"))
                chunk = np.asarray(b.column("h1")).astype(np.uint64) % np.diff(edge)[own_cells].astype(np.uint64)
                own_bucket = edge[own_cells] + chunk.astype(np.int64)
                low = edge[first]
                cell_of = np.repeat(np.arange(len(centres)), np.diff(edge[first : first + len(centres) + 1]))
                numbers = low + np.arange(cell_of.size)
                at = 0
                for u in _pieces(units, cell_of.size):
                    here, cell = own_bucket[at : at + len(u)], own_cells[at : at + len(u)] - first
                    d = distances(u, centres)
                    mine = d[np.arange(len(u)), cell][:, None]
                    plane = (d * d - mine * mine) <= 2 * (eps + LOOSE) * distances(centres[cell], centres) + LOOSE
                    may = (d <= mine + 2 * eps + LOOSE) & plane
                    may[np.arange(len(u)), cell] = True
                    may = may[:, cell_of]
                    odd = (numbers[None] + here[:, None]) % 2 == 1
                    meets = np.where(odd, numbers[None] < here[:, None], numbers[None] > here[:, None])  # each two buckets meet in one of them, evenly spread
                    p, k = np.nonzero((may & meets) | (numbers[None] == here[:, None]))
                    rows = pa.array(p + at)
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[k].astype(np.int32)), pa.array(here[p].astype(np.int32)), *(b.column(c).take(rows) for c in ("class_id", "copies", "v"))], ["bucket", "own", "class_id", "copies", "v"])
                    at += len(u)

    sent = homes.mapInArrow(visit, f"bucket int, own int, class_id {kind}, copies long, v array<float>")
    partitions = max(1, min(buckets, MOST_PARTITIONS))
    placed = sent.repartitionById(partitions, F.col("bucket") % partitions).sortWithinPartitions("bucket", F.col("bucket") != F.col("own"), "own")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, home = -1, [], None
        for b in batches:
            at, own = np.asarray(b.column("bucket")), np.asarray(b.column("own"))
            guest = at != own
            for s, e in _runs(at, guest):
                if not guest[s]:
                    if at[s] != bucket:
                        yield from _finished(home or _settled(parts, threshold, listed), listed)
                        bucket, parts, home = int(at[s]), [], None
                    parts.append(b.slice(s, e - s))
                    continue
                if at[s] != bucket:  # a bucket without home points
                    yield from _finished(home or _settled(parts, threshold, listed), listed)
                    bucket, parts, home = int(at[s]), [], None
                if not parts and home is None:
                    continue
                if home is None:
                    home, parts = _settled(parts, threshold, listed), []
                for x, y in _near_alike(own[s:e]):
                    visitors = _side(b.slice(s + x, y - x))
                    pairs: list | None = [] if listed else None
                    meet(home[0], visitors, (home[1], CoverTree(visitors.unit)), threshold, pairs)
                    yield from _finished((visitors, None, None), False) if not listed else _listed(home[0], visitors, pairs)
            release()
        yield from _finished(home or _settled(parts, threshold, listed), listed)

    schema = f"id_a {kind}, id_b {kind}, similarity double" if listed else f"class_id {kind}, links long"
    return placed.mapInArrow(compare, schema)


def _pieces(units: np.ndarray, width: int = 4_096) -> Iterator[np.ndarray]:
    """Row blocks that give matrices of some million cells."""
    step = max(64, (1 << 22) // max(1, width))
    for s in range(0, len(units), step):
        yield units[s : s + step]


def _runs(at: np.ndarray, guest: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero((np.diff(at) != 0) | (np.diff(guest.astype(np.int8)) != 0)) + 1
    bounds = [0, *edges.tolist(), len(at)]
    yield from zip(bounds[:-1], bounds[1:], strict=True)


def _near_alike(own: np.ndarray, least: int = 256) -> Iterator[tuple[int, int]]:
    """Runs of visitors from one bucket, which lie close together; small ones join the next."""
    bounds = [*(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
    s = 0
    for e in bounds:
        if e - s >= least or e == len(own):
            yield s, e
            s = e


def _side(b: pa.RecordBatch) -> Side:
    return Side(b.column("class_id"), np.asarray(b.column("copies")), _matrix(b.column("v")))


def _settled(parts: list[pa.RecordBatch], threshold: float, listed: bool) -> tuple[Side, CoverTree, list | None] | None:
    """The home points of a bucket with their tree, met among themselves."""
    if not parts:
        return None
    home = _side(pa.Table.from_batches(parts).combine_chunks().to_batches()[0])
    tree = CoverTree(home.unit)
    pairs: list | None = [] if listed else None
    meet(home, home, (tree, tree), threshold, pairs)
    return home, tree, pairs


def _finished(side: tuple[Side, CoverTree | None, list | None] | None, listed: bool) -> Iterator[pa.RecordBatch]:
    if side and listed:
        yield from _listed(side[0], side[0], side[2])
    elif side:
        some = np.flatnonzero(side[0].links)
        if some.size:
            yield pa.RecordBatch.from_arrays([side[0].ids.take(pa.array(some)), pa.array(np.rint(side[0].links[some]).astype(np.int64))], ["class_id", "links"])


def _listed(a: Side, b: Side, pairs: list) -> Iterator[pa.RecordBatch]:
    for i, j, likeness in pairs:
        x, y = a.ids.take(pa.array(i)), b.ids.take(pa.array(j))
        swap = pa.array([p > q for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)])
        low, high = pc.if_else(swap, y, x), pc.if_else(swap, x, y)
        yield pa.RecordBatch.from_arrays([low, high, pa.array(np.round(likeness, 6))], ["id_a", "id_b", "similarity"])


def near_pairs(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, home_points: int = HOME_POINTS) -> DataFrame:
    """``(id_a, id_b, similarity)`` of every two classes whose cosine reaches the threshold; the ids are the classes' smallest, :func:`near_links` has their members."""
    rows = _rows(vectors, id_col, vector_col)
    classes = materialize(vectors.sparkSession, _classes(rows), "classes")
    return _met(classes, threshold, home_points, True)


def near_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, home_points: int = HOME_POINTS) -> DataFrame:
    """``(vec_id, class_id, copies, links)`` of each row with an id.

    ``class_id`` is the smallest id of the rows with an equal vector, ``copies`` their number; ``links`` counts the other rows
    whose vectors are within the threshold, copies among them.
    """
    spark = vectors.sparkSession
    rows = _rows(vectors, id_col, vector_col)
    classes = materialize(spark, _classes(rows), "classes")
    links = _met(classes, threshold, home_points, False).groupBy("class_id").agg(F.sum("links").alias("links"))
    told = classes.select("h1", "h2", "class_id", "copies").join(links, "class_id", "left")
    own = rows.select(F.col("id").alias("vec_id"), "h1", "h2").join(told, ["h1", "h2"], "left")
    none = F.lit(0).cast("long")
    return own.select("vec_id", "class_id", F.coalesce("copies", none).alias("copies"), (F.coalesce("links", none) + F.greatest(F.coalesce("copies", none) - 1, none)).alias("links"))
