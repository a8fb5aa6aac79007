"""Medians and ranks over long windows of an asset's rows, in logarithmic time a row.

An asset's rows are streamed in order; the values of a window are counted in a Fenwick tree over the ranks of the
values in reach, so that a row enters, leaves, and is asked for its rank or for the middle in a few steps. Of what came
before a batch only the last window is carried on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from factorloom.functions.stats import ASSET, TIME


class Counts:
    """How many values of each rank a window holds."""

    def __init__(self, n: int):
        self.tree, self.single, self.total = [0] * (n + 1), [0] * n, 0
        self.top = 1 << max(0, n.bit_length() - 1)

    def add(self, rank: int, by: int) -> None:
        self.single[rank] += by
        self.total += by
        i, tree = rank + 1, self.tree
        while i < len(tree):
            tree[i] += by
            i += i & -i

    def below(self, rank: int) -> int:
        """Values of lower ranks."""
        out, i, tree = 0, rank, self.tree
        while i:
            out += tree[i]
            i -= i & -i
        return out

    def nth(self, k: int) -> int:
        """The rank of the k-th value (from 0)."""
        at, step, tree = 0, self.top, self.tree
        while step:
            if at + step < len(tree) and tree[at + step] <= k:
                at += step
                k -= tree[at]
            step >>= 1
        return at


def along(values: np.ndarray, carried: int, p: int, what: str) -> np.ndarray:
    """For each row from ``carried`` on, the median of the last ``p`` rows (``median``) or the mean-tie percentile rank of the row
    among them (``rank``); NaN is missing."""
    distinct, ranks = np.unique(values, return_inverse=True)
    there, ranks = (~np.isnan(values)).tolist(), ranks.ravel().tolist()
    counts, out = Counts(len(distinct)), np.full(len(values) - carried, np.nan)
    for i in range(len(values)):
        if there[i]:
            counts.add(ranks[i], 1)
        if i >= p and there[i - p]:
            counts.add(ranks[i - p], -1)
        if i < carried or not counts.total:
            continue
        if what == "median":
            out[i - carried] = (distinct[counts.nth((counts.total - 1) // 2)] + distinct[counts.nth(counts.total // 2)]) / 2
        elif there[i]:
            out[i - carried] = (counts.below(ranks[i]) + (counts.single[ranks[i]] + 1) / 2) / counts.total
    return out


def rolling_orders(df: DataFrame, asked: dict[str, tuple[str, str, int]]) -> DataFrame:
    """``df`` with a column for each of ``asked``: name to (``median`` or ``rank``, column, rows of the window).

    Rows of one asset go by time in one task, as in a window, but are streamed: the memory of a task is a batch and the
    longest window. Missing values are skipped; a window without any, or the rank of a missing value, is null.
    """
    fields = StructType([*df.schema.fields, *(StructField(n, DoubleType()) for n in asked)])
    names = [f.name for f in fields]
    key, columns = df.columns.index(ASSET), {n: df.columns.index(c) for n, (_, c, _) in asked.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        last: object = None
        begun = False
        for batch in batches:
            if not len(batch):
                continue
            assets = batch.column(key).to_pylist()
            cuts = [0, *(i for i in range(1, len(assets)) if assets[i] != assets[i - 1]), len(assets)]
            out = {n: np.empty(len(batch)) for n in asked}
            for n, (what, _, p) in asked.items():
                x = batch.column(columns[n]).to_numpy(zero_copy_only=False).astype(np.float64)
                for a, b in zip(cuts, cuts[1:], strict=False):
                    before = held.get(n, x[:0]) if a == 0 and begun and assets[0] == last else x[:0]
                    both = np.concatenate([before, x[a:b]])
                    out[n][a:b] = along(both, len(before), p, what)
                held[n] = both[max(0, len(both) - p) :]
            last, begun = assets[-1], True
            new = [pa.array(v, from_pandas=True) for v in out.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    return df.repartition(F.col(ASSET)).sortWithinPartitions(ASSET, TIME).mapInArrow(run, fields)
