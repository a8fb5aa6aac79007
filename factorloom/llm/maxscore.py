"""Exact top-k search by inner product: MaxScore over shards of postings.

A component is a term. A shard keeps, for each term, its postings (all documents where most hold the term, else the ids
and impacts of those that do) and the largest and least impact, which bound what the term can add to a score. For each
query the terms are ordered by their bounds; those at the end whose bounds together can't reach the score of the k-th
best document so far are non-essential. The postings of the others are traversed; the documents met there are probed
for the non-essential terms, most important first, and only while what is left could still make them competitive. The
shards' best documents are merged. Every bound is an upper one, so results are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .vectors import Block, as_longs, best, comparable

#: Documents of a shard that are scored in full to give each query its first threshold; documents of a posting block.
HEAD, STRETCH = 128, 4096

#: Terms that are probed together.
STEP = 4


class Postings:
    """Postings of a matrix (documents by terms)."""

    def __init__(self, x: np.ndarray):
        self.n, self.rows = len(x), np.ascontiguousarray(x.T)
        held = (self.rows != 0).sum(axis=1)
        self.docs = [None if 4 * h >= self.n else np.flatnonzero(row) for h, row in zip(held, self.rows, strict=True)]
        self.impacts = [row if d is None else row[d] for d, row in zip(self.docs, self.rows, strict=True)]
        zero = np.array([d is not None for d in self.docs], dtype=bool)
        self.high, self.low = (np.where(zero, limit(of(axis=1), 0), of(axis=1)) for of, limit in ((self.rows.max, np.maximum), (self.rows.min, np.minimum)))

    def competitive(self, q: np.ndarray, least: float | None) -> tuple[np.ndarray, np.ndarray]:
        """The documents whose score is ``least`` (None: anything) or more, and their scores."""
        bounds = np.where(q > 0, q * self.high, q * self.low)
        order = np.argsort(-bounds, kind="stable")
        rest = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)
        enough = [] if least is None else np.flatnonzero(rest < least)
        essential = int(enough[0]) if len(enough) else len(order)
        score, met = np.zeros(self.n, dtype=self.rows.dtype), np.full(self.n, not len(enough))
        for t in order[:essential]:
            if self.docs[t] is None:
                score += q[t] * self.impacts[t]
                met[:] = True
            else:
                score[self.docs[t]] += q[t] * self.impacts[t]
                met[self.docs[t]] = True
        docs = np.flatnonzero(met)
        score = score[docs]
        for j in range(essential, len(order) + STEP, STEP):
            if least is not None:
                keep = (score + rest[min(j, len(order))] >= least).astype(bool)
                docs, score = docs[keep], score[keep]
            if not len(docs) or j >= len(order):
                break
            terms = order[j : j + STEP]
            score = score + q[terms] @ self.rows[np.ix_(terms, docs)]
        return docs, score


def search(lane: dict, shards: list[dict], k: int) -> list[dict]:
    """The k best documents of ``shards`` for each query of ``lane``."""
    queries = Block(lane)
    top: list[tuple[np.ndarray, ...]] = [(np.zeros(0), np.zeros(0, bool), np.zeros(0, np.int64))] * len(queries.ids)

    def take(i: int, one: Block, docs: np.ndarray, score: np.ndarray) -> None:
        others = ~(one.known[docs] & (one.ids[docs] == queries.ids[i]))
        new = as_longs(score[others]), one.known[docs][others], one.ids[docs][others]
        score, known, ids = (np.concatenate(pair) for pair in zip(top[i], new, strict=True))
        order = best(score, known, ids, k)
        top[i] = score[order], known[order], ids[order]

    for one in map(Block, shards):
        qs, x = comparable(queries.x, one.x)
        for i, score in enumerate(qs @ x[:HEAD].T):
            take(i, one, np.arange(len(score)), score)
        for at in range(HEAD, len(x), STRETCH):
            postings = Postings(x[at : at + STRETCH])
            for i, q in enumerate(qs):
                docs, score = postings.competitive(q, top[i][0][-1] if len(top[i][0]) == k else None)
                take(i, one, docs + at, score)
    return [
        {"query": int(queries.ids[i]), "vector_key": i, "id": int(d) if known else None, "score": int(s)}
        for i, found in enumerate(top) for s, known, d in zip(*found, strict=True)
    ]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, *, id_col: str = "vec_id", vector: str = "embedding", scale: float = 256) -> DataFrame:
    """For each row of ``queries`` the ``k`` candidates with the highest inner product of components floor(scale * x).

    Columns query_id, rank (from 1), vec_id, score (long; beyond its range the nearest long). Ties go to the smaller id. A query's
    own rows, those with its id, are no candidates for it. Null vectors and those with null or non-finite components take
    no part; a shorter vector counts as one followed by zeros, an empty one scores 0 with all. Queries need an id; candidates
    with a null id come after equal scores. Repeated candidates count as often as they occur; queries alike in id and
    vector are one, others that share an id each have their ranks. Empty tables give no rows; further columns do nothing.
    """
    many, parts = vectors.blocks(vectors.plain_rows(candidates, id_col, vector), scale, "shards")
    few, n = vectors.lanes(vectors.plain_rows(queries, id_col, vector).filter("id IS NOT NULL"), scale, "queries")
    schema = pa.schema([("lane", pa.int32()), ("query", pa.int64()), ("vector_key", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

    def work(lane: dict, shards: list[dict]) -> list[dict]:
        return [{"lane": lane["lane"]} | r for r in search(lane, shards, k)]

    found = vectors.tiles(few, n, many, parts, work, schema, "lane int, query long, vector_key int, id long, score long")
    order = Window.partitionBy("query", "lane", "vector_key").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
