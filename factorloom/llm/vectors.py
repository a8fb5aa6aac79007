"""Vectors as integer matrices in blocks of bounded size, and the tiles in which blocks of queries meet blocks of candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, written

#: Most candidates of a block and, about, most queries of a lane.
BLOCK, LANE = 8192, 4096

#: Most tasks of one pass over all tiles.
TASKS = 50_000

#: Sums of doubles that hold integers are exact below this.
EXACT = 2**53

PACKED = "n int, dim int, kind string, data binary, ids binary, known binary, labels binary"
_FIELDS = [("n", pa.int32()), ("dim", pa.int32()), ("kind", pa.string()), *((c, pa.binary()) for c in ("data", "ids", "known", "labels"))]


def plain_rows(df: DataFrame, id_col: str, vector: str, label: str | None = None) -> DataFrame:
    """Columns id (long), vector (doubles) and label (long), whatever else ``df`` has."""
    need(df, [id_col, vector, *([label] if label else [])])
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"),
        (F.col(f"`{label}`").cast("long") if label else F.lit(0).cast("long")).alias("label"),
    )


def quantised(column: pa.ListArray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and for those floor(scale * x), shorter vectors followed by zeros.

    Null vectors and those with a null or non-finite component (also one that isn't finite once scaled) take no part.
    """
    offsets = column.offsets.to_numpy().astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(column.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    valid = column.is_valid().to_numpy(zero_copy_only=False) & (bad[offsets[1:]] == bad[offsets[:-1]])
    sizes = np.diff(offsets)[valid]
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), sizes.max(initial=0)))
    out[np.repeat(np.arange(len(sizes)), sizes), place] = flat[np.repeat(offsets[:-1][valid], sizes) + place]
    return valid, out


def stacked(parts: list[np.ndarray]) -> np.ndarray:
    """Matrices below each other, narrower ones followed by zeros."""
    width = max((x.shape[1] for x in parts), default=0)
    return np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in parts]) if parts else np.zeros((0, 0))


def pack(x: np.ndarray, ids: np.ndarray, known: np.ndarray, labels: np.ndarray) -> dict:
    """One row for a block: its matrix in the narrowest type that holds it."""
    most = max(abs(x.min(initial=0)), x.max(initial=0))
    kind = next((k for k in ("int8", "int16", "int32") if most <= np.iinfo(k).max), "float64")
    return {"n": len(x), "dim": x.shape[1], "kind": kind, "data": x.astype(kind).tobytes(), "ids": ids.astype(np.int64).tobytes(), "known": known.astype(np.uint8).tobytes(), "labels": labels.astype(np.int64).tobytes()}


class Block:
    """A packed row, unpacked: x (rows by components, doubles that hold integers), ids, known (id isn't null), labels."""

    def __init__(self, row: dict):
        self.x = np.frombuffer(row["data"], row["kind"]).reshape(row["n"], row["dim"]).astype(np.float64)
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.known = np.frombuffer(row["known"], np.uint8).astype(bool)


def _batches(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[tuple[np.ndarray, ...]]:
    for batch in batches:
        valid, x = quantised(batch.column("vector"), scale)
        ids = batch.column("id")
        known = ids.is_valid().to_numpy(zero_copy_only=False)[valid]
        yield x, ids.fill_null(0).to_numpy(zero_copy_only=False)[valid], known, batch.column("label").to_numpy(zero_copy_only=False)[valid]


def blocks(rows: DataFrame, scale: float, label: str, most: int = BLOCK, more: Callable[[np.ndarray], dict] | None = None, more_ddl: str = "") -> tuple[DataFrame, int]:
    """``rows`` (of ``plain_rows``, labels known) packed where they are read, written, and about how many blocks there are.

    Blocks have ``most`` rows, or fewer where all cores would not get one. ``more`` gives a block's further columns.
    """
    spark = rows.sparkSession
    total = rows.count()
    most = min(most, max(256, -(-total // (2 * spark.sparkContext.defaultParallelism))))
    fields = [("block", pa.string()), *_FIELDS, *((c.split()[0], pa.binary()) for c in more_ddl.split(", ") if c)]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, n = TaskContext.get().partitionId(), 0, [], 0

        def out(n_rows: int) -> pa.RecordBatch:
            nonlocal held, n, k
            x, *rest = stacked([h[0] for h in held]), *(np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            now, (ids, known, labels) = x[:n_rows], (r[:n_rows] for r in rest)
            held = [tuple(v[n_rows:] for v in (x, *rest))]
            n -= len(now)
            k += 1
            row = {"block": f"{part}-{k}"} | (more(now, ids, known, labels) if more else pack(now, ids, known, labels))
            return pa.RecordBatch.from_pylist([row], pa.schema(fields))

        for one in _batches(batches, scale):
            held.append(one)
            n += len(one[0])
            while n >= most:
                yield out(most)
        if n:
            yield out(n)

    ddl = f"block string, {PACKED}" + (f", {more_ddl}" if more_ddl else "")
    return written(rows.mapInArrow(packed, ddl), label), max(1, -(-total // most))


def lanes(queries: DataFrame, scale: float, label: str, most: int = LANE) -> tuple[DataFrame, int]:
    """Distinct ``queries`` (of ``plain_rows``) dealt to lanes by a hash, each packed as one row; written. And the number of lanes."""
    distinct = queries.dropDuplicates()
    n = max(1, -(-distinct.count() // most))

    def packed(table: pa.Table) -> pa.Table:
        parts = [*_batches(iter(table.to_batches()), scale)]
        row = pack(stacked([p[0] for p in parts]), *(np.concatenate([p[i] for p in parts]) for i in (1, 2, 3)))
        return pa.Table.from_pylist([{"lane": table.column("lane")[0].as_py()} | row], pa.schema([("lane", pa.int32()), *_FIELDS]))

    dealt = distinct.withColumn("lane", F.expr(f"cast(pmod(xxhash64(id, vector), {n}) AS int)"))
    return written(dealt.groupBy("lane").applyInArrow(packed, f"lane int, {PACKED}"), label), n


def tiles(few: DataFrame, n_lanes: int, many: DataFrame, parts: int, work: Callable[[dict, list[dict]], list[dict]], schema: pa.Schema, ddl: str) -> DataFrame:
    """``work`` over each lane of queries and each part of the blocks: a part holds about one block, so that a task's
    memory is bounded by one lane and a few blocks, whatever the number of rows."""

    def tile(blocks_: pa.Table, lane: pa.Table) -> pa.Table:
        found = work(lane.to_pylist()[0], blocks_.to_pylist()) if len(lane) and len(blocks_) else []
        return pa.Table.from_pylist(found, schema) if isinstance(found, list) else found

    parts *= 4  # few blocks share a part, and few tiles a task
    n = min(2 * parts * n_lanes, TASKS)
    dealt = many.withColumn("part", F.expr(f"cast(pmod(xxhash64(block), {parts}) AS int)"))
    met = few.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(dealt.select("part").distinct(), "part", "left_semi")
    dealt = dealt.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(n_lanes - 1))))
    left, right = (x.repartition(n, "lane", "part").groupBy("lane", "part") for x in (dealt, met))
    return left.cogroup(right).applyInArrow(tile, ddl)


def whole(x: np.ndarray) -> np.ndarray:
    """The same integers without a limit of size."""
    return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)


def comparable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices with as many columns, in a type in which inner products of their rows are exact."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width
    return (a, b) if most < EXACT else (whole(a), whole(b))


def best(score: np.ndarray, known: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, null ids last."""
    if score.dtype == object:
        return np.array(sorted(range(len(score)), key=lambda i: (-score[i], not known[i], ids[i]))[:k], dtype=np.int64)
    if len(score) > 8 * k:
        few = np.flatnonzero(score >= np.partition(score, len(score) - k)[-k])
        return few[np.lexsort((ids[few], ~known[few], -score[few]))[:k]]
    return np.lexsort((ids, ~known, -score))[:k]


def as_longs(score: np.ndarray) -> np.ndarray:
    """Scores within the range of longs: one beyond it is the nearest long."""
    return np.array([max(-(2**63), min(2**63 - 1, v)) for v in score], dtype=object) if score.dtype == object else score
