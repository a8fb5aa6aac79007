"""Best-fit-decreasing packing of token sequences, with a segment tree over remaining capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary
from .common import ddl, fresh, need, written
from .token_counts import default_path

#: Documents whose pieces are packed together. It bounds a task's memory; more documents make more groups.
GROUP_DOCS = 20_000


class OpenBins:
    """Open bins by remaining capacity. A segment tree over the capacities holds how many bins each range has, so the
    tightest bin that fits is found by one walk down and one up: O(log capacity)."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, bin_id: int) -> None:
        self.bins[room].append(bin_id)
        i = room + self.size
        while i:
            self.tree[i] += 1
            i >>= 1

    def take(self, length: int) -> tuple[int, int]:
        """(room, bin) of the tightest open bin with room for ``length``, removed from the tree; (-1, -1) if none."""
        tree, size = self.tree, self.size
        i = length + size
        while not tree[i]:
            while i & 1:  # a right child: what lies to the right starts higher up
                i >>= 1
            if not i:
                return -1, -1
            i += 1
        while i < size:
            i = 2 * i if tree[2 * i] else 2 * i + 1
        room = i - size
        found = self.bins[room].pop()
        while i:
            tree[i] -= 1
            i >>= 1
        return room, found


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each length; ``lengths`` is in descending order and none exceeds ``capacity``."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins, made = OpenBins(capacity), 0
    for k, length in enumerate(lengths.tolist()):
        room, b = open_bins.take(length)
        if b < 0:
            room, b, made = capacity, made, made + 1
        bins[k], offsets[k] = b, capacity - room
        if room > length:
            open_bins.add(room - length, b)
    return bins, offsets


def token_pieces(df: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every text's ids and ``end_id``, cut only where longer than ``capacity``;
    all pieces but the first are then full. A null or empty text is ``end_id`` alone."""
    need(df, [text, doc_id])
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for i, _, counts, flat in vocab.encode(batch.column(1)):
                out: list[tuple[int, int, int, int, int]] = []
                at = 0
                for row, n in enumerate(counts.tolist(), i):
                    own = np.append(flat[at : at + n], end_id).astype("<u4")
                    at += n
                    n += 1
                    first = n % capacity or capacity
                    cuts = [0, *range(min(first, n), n + 1, capacity)]
                    out += [(row, k, a, b - a, zlib.crc32(own[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                rows, piece, start, length, crc = map(list, zip(*out, strict=True)) if out else ([], [], [], [], [])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=[doc_id, "piece", "start", "length", "ids_crc32"])

    return df.select(doc_id, F.col(text).alias("_text_")).mapInArrow(run, ddl(df, [doc_id], "piece int, start long, length long, ids_crc32 long"))


def pack(pieces: DataFrame, groups: int, capacity: int = 2048, doc_id: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (with columns of ``token_pieces``).

    Pieces are dealt to ``groups`` groups by a hash of what they hold, and each group is packed by best-fit decreasing
    on its own, so the work is spread and no task sees more than its share; only a group's last sequences can be
    emptier than they would be in one global packing. A row's place is part of the hash, so that rows alike don't make one
    group; the pieces are written first, so that places stay as they are when an executor is lost. Ties in length go by doc_id, piece and checksum.
    """

    group = fresh(pieces, "_group_")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", doc_id, "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        bins, offsets = best_fit_decreasing(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = bins + (int(key[0]) << 32)
        pdf["offset"] = offsets
        return pdf.drop(columns=group)

    dealt = written(pieces, "pieces").withColumn(group, F.pmod(F.xxhash64(doc_id, "piece", "length", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy(group).applyInPandas(run, ddl(pieces, pieces.columns, "sequence_id long, offset long"))


def pack_documents(df: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, capacity: int = 2048, end_id: int = 0, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Packs all texts of ``df`` into sequences of at most ``capacity`` tokens: one row for each piece of each row.

    Null and empty texts are one token (``end_id``); long ones are cut, never shortened; repeated rows are packed as
    often as they occur; null ids stay null; other columns are ignored; an empty table gives an empty result.
    """
    groups = max(1, -(-df.count() // group_docs))
    return pack(token_pieces(df, text, doc_id, path, capacity, end_id), groups, capacity, doc_id)
