"""Similarity digests from improbable features.

Every window of ``WINDOW`` bytes gets an entropy level, counted over ``CLASSES`` classes of bytes. How often each level
occurs is counted over the whole corpus (``measure_rarity``); the rarer a window's level, the higher it ranks. Of each ``SPAN`` neighbouring windows the
highest-ranked (of equals the first) wins; windows that win ``WINS`` times are the document's features. Features are
hashed into Bloom filters of 2048 bits, at most ``FILL`` in one; further ones chain another filter to the digest. Two
digests are compared filter by filter: bits in common beyond what chance gives, as a share of the most possible.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import ddl, need
from .textarrays import U64, chunks, hash_spans, mix

WINDOW, SPAN, WINS, CLASSES = 24, 16, 4, 16
SHORT = 6
BITS, HASHES, FILL = 2048, 5, 160
#: Share of the span between chance and identity that counts as nothing.
SLACK = 0.3
#: Buckets of a partition, where there are more partitions than the session's setting.
PART_BUCKETS = 32
#: Entropy levels (in steps of 1/16 bit).
LEVELS = 80
_CLASS = ((np.arange(256) * 7) ^ (np.arange(256) >> 4)).astype(np.uint8) & (CLASSES - 1)
_COUNTS = np.arange(WINDOW + 1)
_PARTS = np.round(np.where(_COUNTS > 0, _COUNTS * np.log2(np.maximum(_COUNTS, 1)), 0) * 64).astype(np.int32)
_STEP = (_PARTS[1:] - _PARTS[:-1]).astype(np.int16)
_LEVEL = np.rint((np.log2(WINDOW) - np.arange(_PARTS[-1] + 1) / (64 * WINDOW)) * 16).astype(np.uint8)


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """The entropy level of each window, by its first byte.

    From one window to the next, the sum over classes of count x log(count) changes by what the byte that comes and the byte
    that goes do, which depends on how many of their class are in the bytes between.
    """
    n = len(data) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint8)
    kinds = _CLASS[data]
    before, behind = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for lag in range(1, WINDOW):
        same = (kinds[lag:] == kinds[:-lag]).view(np.uint8)
        before[lag:] += same
        behind[:-lag] += same
    total = np.empty(n, np.int32)
    total[0] = _PARTS[np.bincount(kinds[:WINDOW], minlength=CLASSES)].sum()
    np.subtract(_STEP[before[WINDOW:]], _STEP[behind[: n - 1]], out=total[1:], dtype=np.int32)
    return _LEVEL[np.cumsum(total, out=total)]


def _inside(n: int, off: np.ndarray, reach: int = WINDOW - 1) -> np.ndarray:
    """Of ``n`` windows that go ``reach`` bytes beyond their first, those that don't cross into another text."""
    crossing = np.zeros(n + 1, np.int32)
    edge = off[1:-1]
    np.add.at(crossing, np.clip(edge - reach, 0, n), 1)
    np.add.at(crossing, np.clip(edge, 0, n), -1)
    return np.cumsum(crossing)[:-1] == 0


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of each level by how often it occurs (0: the rarest, of equals the lower level), from counts of all levels."""
    rank = np.empty(LEVELS, np.uint8)
    rank[np.argsort(counts, kind="stable")] = np.arange(LEVELS)
    return rank


def measure_rarity(df: DataFrame, text: str = "text") -> np.ndarray:
    """Rarity ranks of the entropy levels of all windows of all texts: one narrow pass, ``LEVELS`` sums to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(LEVELS, np.int64)
        for batch in batches:
            for _, _, data, off in chunks(batch.column(0)):
                level = entropy_levels(data)
                seen += np.bincount(level[_inside(len(level), off)], minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS), pa.int32()), pa.array(seen)], names=["level", "n"])

    found = df.select(F.col(text).alias("t")).mapInArrow(run, "level int, n long").groupBy("level").agg(F.sum("n").alias("n"))
    counts = np.zeros(LEVELS, np.int64)
    for r in found.collect():
        counts[r["level"]] = r["n"]
    return rarity(counts)


def feature_positions(data: np.ndarray, off: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the selected windows in flat texts, and the texts' bounds in that list.

    A text with fewer windows than a span has all its windows of ``SHORT`` bytes as features (a shorter one itself); one
    in which no window wins often enough has its highest-ranked one.
    """
    size = np.diff(off)
    picked = [np.zeros(0, np.int64)]
    if len(data) >= WINDOW + SPAN - 1:
        kind, shift = (np.int32, 24) if len(data) < 1 << 24 else (np.int64, 48)
        key = (rank[entropy_levels(data)].astype(kind) << shift) | np.arange(len(data) - WINDOW + 1, dtype=kind)
        step = 1
        while step < SPAN:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        ok = _inside(len(key), off, WINDOW + SPAN - 2)
        wins = np.bincount(key[ok] & ((1 << shift) - 1), minlength=1)
        picked.append(np.flatnonzero(wins >= WINS))
    width = [np.full(len(picked[-1]), WINDOW)]
    covered = np.diff(np.searchsorted(picked[-1], off))
    for i in np.flatnonzero((covered == 0) & (size > 0)):
        a, b = int(off[i]), int(off[i + 1])
        if b - a < WINDOW + SPAN - 1:
            own = np.arange(a, max(a + 1, b - SHORT + 1))
        else:
            own = np.array([a + int(np.argmin(rank[entropy_levels(data[a:b])]))])
        picked.append(own)
        width.append(np.full(len(own), WINDOW if b - a >= WINDOW + SPAN - 1 else min(SHORT, b - a)))
    every, width = np.concatenate(picked), np.concatenate(width)
    order = np.argsort(every, kind="stable")
    every, width = every[order], width[order]
    return every, every + width, np.searchsorted(every, off)


def digests(texts: list[bytes], rank: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, its chained filters (k x 32 of uint64) and how many features each holds."""
    off = np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))
    data = np.frombuffer(b"".join(texts), np.uint8)
    at, end, bounds = feature_positions(data, off, rank)
    h = hash_spans(data, at, end, seed=31)
    more = mix(h)
    bits = np.stack([(h >> U64(11 * k)) & U64(BITS - 1) for k in range(HASHES)], 1).astype(np.int64)
    bits ^= (more & U64(BITS - 1)).astype(np.int64)[:, None]
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            _, first = np.unique(h[a:b], return_index=True)
            first.sort()
        else:
            first = np.arange(b - a)
        n = -(-len(first) // FILL)
        flags = np.zeros(max(n, 1) * BITS, bool)
        flags[(bits[a + first] + (np.arange(len(first)) // FILL)[:, None] * BITS).ravel()] = True
        filters = np.packbits(flags[: n * BITS]).view(np.uint64).reshape(n, BITS // 64)
        out.append((filters, np.array([min(FILL, len(first) - FILL * k) for k in range(n)], np.int64)))
    return out


def to_text(digest: tuple[np.ndarray, np.ndarray]) -> str:
    """The digest as text: number of features of each filter, then the filters."""
    filters, counts = digest
    return ",".join(map(str, counts.tolist())) + ":" + base64.b64encode(filters.tobytes()).decode()


def from_text(text: str) -> tuple[np.ndarray, np.ndarray]:
    counts, _, filters = text.partition(":")
    own = np.array([int(c) for c in counts.split(",") if c], np.int64)
    return np.frombuffer(base64.b64decode(filters), np.uint64).reshape(len(own), BITS // 64), own


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1: each filter of the shorter digest against its best match in the other, weighted by features.

    Two digests without features (of empty texts) are alike; one without and one with are not.
    """
    (fa, na), (fb, nb) = (a, b) if (len(a[1]), int(a[1].sum())) <= (len(b[1]), int(b[1].sum())) else (b, a)
    if not len(na) or not len(nb):
        return float(len(na) == len(nb))
    ones_a, ones_b = np.bitwise_count(fa).sum(axis=1, dtype=np.int64), np.bitwise_count(fb).sum(axis=1, dtype=np.int64)
    best = np.empty(len(na))
    for k in range(len(na)):
        both = np.bitwise_count(fa[k] & fb).sum(axis=1, dtype=np.int64)
        most = np.minimum(ones_a[k], ones_b)
        floor = ones_a[k] * ones_b / BITS  # bits in common by chance
        low = floor + SLACK * (most - floor)
        best[k] = np.max(np.clip((both - low) / np.maximum(most - low, 1e-9), 0, 1))
    return float((best * na).sum() / na.sum())


def edit(text: str, other: str) -> str:
    """``text`` with its last third replaced by the first characters of ``other``."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


def _pieces(n_bytes: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    total = np.append(0, np.cumsum(n_bytes))
    i = 0
    while i < len(n_bytes):
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        yield i, j
        i = j


def _compared(pairs: list[tuple[tuple, tuple]], doc_id: str, rank: np.ndarray) -> pa.RecordBatch:
    """The result's rows for documents and their next ones, each (bucket, guest, id, text, digest)."""
    edited = [edit(x[3], y[3]).encode() for x, y in pairs]
    changed = digests(edited, rank)
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([x[2] for x, _ in pairs]),
            pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
            pa.array([to_text(x[4]) for x, _ in pairs]),
            pa.array([to_text(d) for d in changed]),
            pa.array([likeness(x[4], d) for (x, _), d in zip(pairs, changed, strict=True)]),
            pa.array([likeness(x[4], y[4]) for x, y in pairs]),
        ],
        names=[doc_id, *(c.split()[0] for c in _OUT.split(", "))],
    )


def _sortable(df: DataFrame, doc_id: str) -> Column:
    """The id in a form that Python orders as Spark does; nulls are told apart elsewhere."""
    kind, c = df.schema[doc_id].dataType.simpleString(), F.col(doc_id)
    if kind in ("tinyint", "smallint", "int", "bigint", "boolean"):
        return F.coalesce(c.cast("long"), F.lit(0))
    if kind in ("float", "double"):
        return F.coalesce(c.cast("double"), F.lit(0.0))
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.coalesce(F.unix_micros(c.cast("timestamp")), F.lit(0))
    return F.coalesce(F.encode(c.cast("string"), "UTF-8"), F.lit(b""))


def fingerprint_documents(df: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket_docs: int = 1000, most_buckets: int = 16384, rank: np.ndarray | None = None) -> DataFrame:
    """One row per row of ``df``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next smaller doc_id (rows that share an id go by their text's hash; null ids
    come last, by hash; after the last comes the first). Ids may be numbers, texts, dates or times; numbers of decimal type
    are ordered as their text is. ``rank`` is a table of rarities (see ``measure_rarity``); without one it is measured over
    ``df``, so digests are comparable within one corpus, or wherever the same table is given.

    Documents are dealt to buckets of neighbours of about ``bucket_docs`` each, whose first rows are found by a range
    partitioning of ids and hashes alone, so that rows of one id may lie in many buckets. These first rows, one for each
    bucket and at most ``most_buckets``, go to the driver. Beyond bucket_docs x most_buckets documents buckets grow; Spark
    sorts them (with spilling) and they are streamed, so that memory doesn't. A bucket's first document goes to the bucket
    before as well: every text moves once and the bucket's last document meets its next.

    Null texts count as empty; an empty text has the fingerprint ":". Texts are used whole. Repeated rows stay, each with
    a next of its own. A single row is its own next; an empty table gives an empty result; other columns are ignored.
    """
    need(df, [text, doc_id])
    if rank is None:
        rank = measure_rarity(df, text)
    buckets = int(min(most_buckets, max(1, df.count() // bucket_docs)))
    rows = df.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"), _sortable(df, doc_id).alias("i"), F.col(doc_id).isNull().alias("none")).withColumn("h", F.xxhash64("t"))
    order = [F.asc("none"), F.desc("i"), F.asc("h")]
    keys = rows.select("i", "none", "h").repartitionByRange(buckets, *order).sortWithinPartitions(*order)
    kind = dict(rows.dtypes)["i"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield batch.slice(0, 1)
                return

    heads = keys.mapInArrow(first, f"i {kind}, none boolean, h long").collect()  # one row for each bucket
    if not heads:
        return df.sparkSession.createDataFrame([], ddl(df, [doc_id], _OUT))
    # ascending: nulls first, then ids, then hashes from the greatest down; buckets are numbered from the end
    edges = sorted((not r["none"], bytes(r["i"]) if kind == "binary" else r["i"], -r["h"]) for r in heads)
    last = len(edges) - 1

    @F.pandas_udf(ArrayType(LongType()))
    def places(i: pd.Series, none: pd.Series, h: pd.Series) -> pd.Series:
        """The row's bucket; for a bucket's first row also the one before (of the first bucket, the last)."""
        out = []
        for key in zip((~none).tolist(), i.tolist(), (-h).tolist(), strict=True):
            at = bisect.bisect_left(edges, key)
            own = last - at
            out.append([own, own - 1 if own else last] if edges[at] == key else [own])
        return pd.Series(out)

    moved = rows.select("id", "t", "i", "none", "h", F.posexplode(places("i", "none", "h")).alias("guest", "bucket"))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // PART_BUCKETS)
    moved = moved.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", *order).select("id", "t", "bucket", "guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the row that waits for its next
        for batch in batches:
            sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(1)], np.int64)
            for i, j in _pieces(sizes):
                keys = batch.column(0).slice(i, j - i)
                texts = batch.column(1).slice(i, j - i).to_pylist()
                own = digests([t.encode() for t in texts], rank)
                now = list(zip(batch.column(2).slice(i, j - i).to_pylist(), batch.column(3).slice(i, j - i).to_pylist(), (keys.slice(k, 1) for k in range(len(keys))), texts, own, strict=True))
                seen = held + now
                held = seen[-1:]
                # of a bucket's guests only the first counts, and none is a row of the result
                pairs = [(x, y) for x, y in zip(seen, seen[1:], strict=False) if x[0] == y[0] and not x[1]]
                if pairs:
                    yield _compared(pairs, doc_id, rank)

    return moved.mapInArrow(run, ddl(df, [doc_id], _OUT))


_OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
