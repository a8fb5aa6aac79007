"""Hard-negative mining with cover trees over norm-augmented candidates.

Each candidate gets one more component that brings all of a block to the same norm; a cover tree over those points halves
the covering radius by a fixed factor a level. Seen from an anchor, a node of covering radius r around a centre has
inner products between those of the nearest and the farthest point of a cap of that radius, so whole nodes lie above or
below what is looked for. Nodes are visited best bound first; nodes outside all windows, or below the last of enough results, are skipped;
leaves are verified exactly.
"""

from __future__ import annotations

import heapq
import math
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .vectors import Block, as_longs, best, comparable, pack

#: Points of a leaf, and by what a level's covering radius is less than the one's above.
LEAF, FACTOR = 128, 1.2

#: Part of the largest inner product that bounds are widened by, for rounding.
SLACK = 1e-7

#: Doubles below this are longs.
LONGS = 9.2e18


def unit(x: np.ndarray) -> float:
    """The largest component: trees and bounds are in this unit, so that no square is beyond a double."""
    return max(1.0, float(np.abs(x).max(initial=0)))


class CoverTree:
    """Nodes in level order: ``spans`` (their points, once the points are in ``order``), ``centers``, ``radii``, ``children``."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        x = x / unit(x)
        squares = (x * x).sum(axis=1)
        points = np.column_stack([x, np.sqrt(squares.max(initial=0) - squares)])
        away = lambda who, c: np.sqrt(((points[who] - points[c]) ** 2).sum(axis=1))
        everyone = np.arange(len(x))
        waiting, self.members, self.centers, self.radii, self.children = deque([(everyone, 0, away(everyone, 0))]), [], [], [], []
        made = 1
        while waiting:
            who, center, far = waiting.popleft()
            radius = float(far.max())
            self.members.append(who)
            self.centers.append(center)
            self.radii.append(radius)
            self.children.append((0, 0))
            if len(who) <= leaf or radius == 0:
                continue
            cover, own, nearest, heads = radius / FACTOR, far, np.zeros(len(who), dtype=np.int64), [center]
            while far.max() > cover:  # the farthest point is a centre of the next level until all are covered
                heads.append(int(who[np.argmax(far)]))
                d = away(who, heads[-1])
                nearest[closer := d < far] = len(heads) - 1
                far = np.minimum(far, d)
            groups = np.argsort(nearest, kind="stable")
            starts = np.searchsorted(nearest[groups], np.arange(len(heads) + 1))
            kept, rest = [], []
            for c, g in zip(heads, np.split(groups, starts[1:-1]), strict=True):
                if 4 * len(g) >= leaf:
                    kept.append((who[g], c, far[g]))
                else:
                    rest.append(g)
            rest = np.concatenate(rest) if rest else np.zeros(0, np.int64)
            kept += [(who[g], center, own[g]) for g in np.split(rest, range(leaf, len(rest), leaf)) if len(g)]  # small children share leaves around the node's centre
            self.children[-1] = made, made + len(kept)
            made += len(kept)
            waiting += kept


def tree_columns(x: np.ndarray, ids: np.ndarray, known: np.ndarray, labels: np.ndarray) -> dict:
    """A block's columns with its tree: points in the order of the leaves, so that each leaf is a stretch."""
    tree = CoverTree(x)
    leaves = [n for n, (a, b) in enumerate(tree.children) if a == b]
    order, spans = np.concatenate([tree.members[n] for n in leaves]), np.zeros((len(tree.centers), 2), np.int64)
    spans[leaves, 1] = np.cumsum([len(tree.members[n]) for n in leaves])
    spans[leaves, 0] = spans[leaves, 1] - [len(tree.members[n]) for n in leaves]
    back = np.empty(len(x), np.int64)
    back[order] = np.arange(len(x))
    nodes = np.column_stack([spans, back[tree.centers], np.array(tree.children)])
    return pack(x[order], ids[order], known[order], labels[order]) | {"nodes": nodes.astype(np.int64).tobytes(), "radii": np.array(tree.radii).tobytes()}


class Tree(Block):
    """A block with its tree, unpacked."""

    def __init__(self, row: dict):
        super().__init__(row)
        self.start, self.end, self.center, self.child, self.last = np.frombuffer(row["nodes"], np.int64).reshape(-1, 5).T
        self.radii = np.frombuffer(row["radii"], np.float64)
        self.unit = unit(self.x)
        self.norm = float(np.sqrt(((self.x / self.unit) ** 2).sum(axis=1).max(initial=0)))

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product (anchors by nodes) that a point within a node's covering radius can have.

        All points lie on a sphere, so a chord of length r is an angle, and angles add up.
        """
        own = unit(anchors)
        size = np.sqrt(((anchors / own) ** 2).sum(axis=1))[:, None] * self.norm
        near = np.divide((anchors / own) @ (self.x[self.center] / self.unit).T, size, out=np.zeros((len(anchors), len(self.center))), where=size > 0)
        angle = np.arccos(np.clip(near, -1, 1))
        reach = 2 * np.arcsin(np.clip(self.radii / (2 * self.norm), 0, 1)) if self.norm else np.zeros(len(self.radii))
        near, far = np.cos(np.maximum(0, angle - reach)) + SLACK, np.cos(np.minimum(np.pi, angle + reach)) - SLACK
        low, high = (size * side * min(own * self.unit, 1e300) for side in (far, near))
        return np.minimum(low, LONGS), np.maximum(high, -LONGS)


def descend(tree: Tree, x: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, allowed: np.ndarray, windows: list[tuple], k: int) -> list[tuple[np.ndarray, ...]]:
    """For each window (least, most; None: without a limit) the k best of the ``allowed`` points, as (score, known, ids).

    ``low`` and ``high`` bound the nodes' inner products with ``q``.
    """
    found = [(np.zeros(0), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in windows]
    floors = [-math.inf if a is None else a for a, _ in windows]  # what a result needs; the k-th best once there are k
    ceilings = [math.inf if b is None else b for _, b in windows]
    low, high = low.tolist(), high.tolist()

    def wanted(n: int) -> list[int]:
        return [w for w, (least, most) in enumerate(zip(floors, ceilings, strict=True)) if high[n] >= least and low[n] <= most]

    queue = [(-high[0], 0)]
    while queue:
        _, n = heapq.heappop(queue)
        if not (into := wanted(n)):
            continue
        if tree.child[n] < tree.last[n]:
            for c in range(tree.child[n], tree.last[n]):
                if wanted(c):
                    heapq.heappush(queue, (-high[c], c))
            continue
        leaf = slice(tree.start[n], tree.end[n])
        score = as_longs(x[leaf] @ q)
        some = np.flatnonzero(allowed[leaf] & (score >= min(floors[w] for w in into)).astype(bool))
        if not len(some):
            continue
        score, known, ids = score[some], tree.known[leaf][some], tree.ids[leaf][some]
        for w in into:
            fits = ((score >= floors[w]) & (score <= ceilings[w])).astype(bool)
            if not fits.any():
                continue
            both = [np.concatenate(pair) for pair in zip(found[w], (score[fits], known[fits], ids[fits]), strict=True)]
            order = best(*both, k)
            found[w] = tuple(v[order] for v in both)
            if len(order) == k:
                floors[w] = found[w][0][-1]
    return found


def _windows(score: int, low: int, high: int) -> tuple[int, int]:
    """The integer scores n with low * score <= 100 * n <= high * score."""
    return -(-low * score // 100), high * score // 100


def mine(lane: dict, trees: list[dict], k: int, span: tuple[int, int] | None, positives: dict[int, list[tuple]] | None) -> list[dict]:
    """Best rows of ``trees`` for each anchor of ``lane``: of its own label, or, with ``positives``, within a window below each."""
    anchors, out = Block(lane), []
    for one in map(Tree, trees):
        qs, x = comparable(anchors.x, one.x)
        low, high = one.bounds(np.pad(anchors.x, ((0, 0), (0, max(0, one.x.shape[1] - anchors.x.shape[1]))))[:, : one.x.shape[1]])
        for i, q in enumerate(qs):
            same = one.labels == anchors.labels[i]
            if positives is None:
                asked, windows = [(0, None, None)], [(None, None)]
                allowed = same & ~(one.known & (one.ids == anchors.ids[i]))
            else:
                asked = positives.get(i, [])
                windows, allowed = [_windows(s, *span) for _, _, s in asked], ~same
            if not asked or not len(x):
                continue
            for (place, positive, p_score), (score, known, ids) in zip(asked, descend(one, x, q, low[i], high[i], allowed, windows, k), strict=True):
                out += [
                    {"lane": lane["lane"], "anchor": int(anchors.ids[i]), "anchor_key": i, "place": place, "positive": positive, "positive_score": p_score, "id": int(d) if there else None, "score": int(s)}
                    for s, there, d in zip(score, known, ids, strict=True)
                ]
    return out


_FOUND = "lane int, anchor long, anchor_key int, place int, positive long, positive_score long, id long, score long"
_FOUND_SCHEMA = pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.int64()) for c in _FOUND.split(", ")])


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    anchors: DataFrame, candidates: DataFrame, *, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256
) -> DataFrame:
    """For each anchor and each of its ``positives`` best rows of the same label, the ``negatives`` best rows of other labels whose
    score is from ``low`` to ``high`` percent of the positive's.

    Columns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. Scores are inner products of
    components floor(scale * x) as longs (beyond that range the nearest long); ties go to the smaller id, null ids last. Rows
    with a null label or vector, or a null or non-finite component, take no part; a shorter vector counts as one followed by
    zeros. An anchor's own rows (with its id) are no positives; repeated rows count as often as they occur (a positive that
    occurs twice has its negatives twice), anchors alike in id, vector and label are one. An anchor without positives, or a window without
    rows, gives none. Empty tables give no rows; further columns do nothing.
    """
    plain = lambda df: vectors.plain_rows(df, id_col, vector, label).filter("label IS NOT NULL")
    many, parts = vectors.blocks(plain(candidates), scale, "trees", more=tree_columns, more_ddl="nodes binary, radii binary")
    few, n = vectors.lanes(plain(anchors).filter("id IS NOT NULL"), scale, "anchors")
    best_own = vectors.tiles(few, n, many, parts, lambda lane, trees: mine(lane, trees, positives, None, None), _FOUND_SCHEMA, _FOUND)
    chosen = vectors.written(_first(best_own, ["anchor", "lane", "anchor_key"], positives), "positives")
    asked = few.join(chosen.groupBy("lane").agg(F.collect_list(F.struct("anchor_key", "rank", "id", "score")).alias("asked")), "lane")

    def below(lane: dict, trees: list[dict]) -> list[dict]:
        each: dict[int, list[tuple]] = {}
        for a in lane["asked"]:
            each.setdefault(a["anchor_key"], []).append((a["rank"], a["id"], a["score"]))
        return mine(lane, trees, negatives, (low, high), each)

    found = vectors.tiles(asked, n, many, parts, below, _FOUND_SCHEMA, _FOUND)
    ranked = _first(found, ["anchor", "lane", "anchor_key", "place"], negatives)
    return ranked.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
