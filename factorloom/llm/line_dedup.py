"""Removal of passages that occurred before, by winnowing over line hashes.

Where a line breaks says nothing about what repeats: a passage may begin and end inside lines. So the lines that are
hashed are running lines: ``least`` words that begin at any word, whatever white space lies between them. Of each
``sure - least + 1`` neighbouring running lines the one with the least hash is selected. These window minima are the
fingerprints: any run of ``sure`` words that occurs twice holds a whole window, the same in both places, so it has that
window's fingerprint in both and can't be missed.

Fingerprints that occur once are dropped. The positions of the others are joined with the first position of the same
fingerprint, and each match is extended word by word in both directions by comparing the words around the two. No more
than a window's width needs comparing on a side, since beyond it the next fingerprint of the run takes over. The runs
found are deleted from the later document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ddl, hot_from, need, written
from .textarrays import U64, chunks, hash_spans, mix, words

_BASE = U64(0x9E3779B97F4A7C15 | 1)
_LAST = U64(2**64 - 1)
#: No shorter repetition is touched, and every longer one than this is found.
LEAST, SURE = 20, 40
#: Parts into which the positions of a hot fingerprint are dealt.
SALTS = 64
#: Matches that are compared, or contexts that are sent, at once; and bytes of text that are read at once for them.
BLOCK, TEXT = 16_384, 512 << 10


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    inverse = U64(pow(int(_BASE), -1, 2**64))
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE, U64), np.full(n, inverse, U64)
        up[:1] = down[:1] = 1
        return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and each row's first word."""
    starts, ends, first = words(data, off)
    return starts, ends, hash_spans(data, starts, ends, seed=5), first


def select(h: np.ndarray, first: np.ndarray, least: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Words (in all rows) at which the selected running lines begin, and their hashes.

    Of equal hashes in a window the first counts. Where running lines are alike one after the other (one word over and over),
    one in ``width`` stays. A row with fewer running lines than a window has its least one selected.
    """
    n = len(h)
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        prefix = np.append(U64(0), np.cumsum(h * up[:n], dtype=U64))
        lines = mix((prefix[least:] - prefix[: n + 1 - least]) * down[: n + 1 - least]) if n >= least else h[:0]
    count = np.diff(first)
    inside = np.repeat(first[1:], count)[: len(lines)] - np.arange(len(lines)) >= least
    value, at = np.where(inside, lines, _LAST), np.arange(len(lines))
    step, best, where = 1, value, at
    while 2 * step <= width:  # minima of ever wider windows; two that overlap make the last
        better = best[step:] < best[:-step]
        best, where = np.where(better, best[step:], best[:-step]), np.where(better, where[step:], where[:-step])
        step *= 2
    if rest := width - step:
        better = best[rest:] < best[:-rest]
        best, where = np.where(better, best[rest:], best[:-rest]), np.where(better, where[rest:], where[:-rest])
    whole = np.flatnonzero(inside[width - 1 :] & inside[: len(best)] & (np.repeat(first[:-1], count)[: len(best)] == np.repeat(first[:-1], count)[width - 1 : width - 1 + len(best)]))
    picked = [np.unique(where[whole])]
    for r in np.flatnonzero((count >= least) & (count < least + width - 1)):
        picked.append(first[r : r + 1] + np.argmin(lines[first[r] : first[r + 1] - least + 1]))
    every = np.unique(np.concatenate(picked)).astype(np.int64)
    same = np.zeros(len(lines), bool)
    same[1:] = inside[1:] & inside[:-1] & (lines[1:] == lines[:-1])
    begin = np.maximum.accumulate(np.where(same, 0, at)) if len(at) else at
    every = every[(every - begin[every]) % width == 0]
    return every, lines[every]


def _fingerprints(df: DataFrame, doc_id: str, text: str, least: int, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, off in chunks(batch.column(2), 2 << 20):
                _, _, h, first = word_hashes(data, off)
                at, lines = select(h, first, least, width)
                row = np.searchsorted(first, at, "right") - 1
                take = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array((at - first[row]).astype(np.int32)), pa.array(lines.view(np.int64))], names=["id", "hash", "pos", "fingerprint"])

    kind = df.schema[doc_id].dataType.simpleString()
    source = df.select(F.col(doc_id), F.xxhash64(text).alias("hash"), F.col(text).alias("_text_"))
    return source.mapInArrow(run, f"id {kind}, hash long, pos int, fingerprint long")


def _document(doc_id: Column) -> Column:
    """With the text's hash what tells documents apart, never null."""
    return F.xxhash64(doc_id.isNull(), doc_id)


def _place() -> Column:
    """Document order: known ids ascending, then the text's hash, then the word."""
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "hash", "pos")


def around(short: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, step: int, width: int, missing: int) -> np.ndarray:
    """For each position the ``width`` words from it on (``step`` 1) or back (-1); ``missing`` outside its document, which
    goes from ``low`` to ``high``."""
    where = at.astype(np.int32)[:, None] + np.int32(step) * np.arange(width, dtype=np.int32)
    outside = (where < low.astype(np.int32)[:, None]) | (where >= high.astype(np.int32)[:, None])
    where[outside] = 0
    out = short[where] if len(short) else np.zeros(where.shape, np.uint32)
    out[outside] = missing
    return out


def _short(h: np.ndarray) -> np.ndarray:
    """Word hashes in 32 bits, none of which stands for a missing word."""
    return (h >> U64(32)).astype(np.uint32) | np.uint32(2)


def second_hash(h: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """A hash of the running lines at ``at`` that has nothing to do with their fingerprints: only where both agree is a match believed."""
    with np.errstate(over="ignore"):
        each = mix(h[at[:, None] + np.arange(least)] ^ U64(0xC2B2AE3D27D4EB4F)) * mix(np.arange(1, least + 1, dtype=U64))
        return each.sum(axis=1, dtype=U64).view(np.int64)


def _lists(column: pa.Array, i: int, j: int) -> tuple[np.ndarray, pa.Array]:
    """For rows i to j - 1 of a column of lists: the number of the row of each item, from 0 on, and the items."""
    part = column.slice(i, j - i)
    return np.repeat(np.arange(j - i), part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), part.flatten()


def _numbers(items: pa.Array, name: str) -> np.ndarray:
    return items.field(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(rows.itemsize * rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _contexts(placed: DataFrame, text: str, doc_id: str, least: int, width: int) -> DataFrame:
    """The words next to each first position (fingerprint, salt, first_id, first_hash, first_pos, second, before, after), from a
    table with texts and, as ``wanted``, positions; one row for each part of a hot fingerprint. ``second`` is another hash of the
    words of the fingerprint."""
    t, k, x, w = (placed.columns.index(c) for c in (text, doc_id, "_hash", "wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in chunks(batch.column(t), TEXT):
                _, _, h, first = word_hashes(data, off)
                row, items = _lists(batch.column(w), i, j)
                short, every, hot_ones = _short(h), first[row] + _numbers(items, "pos"), _numbers(items, "salts") > 0
                for a in range(0, len(row), BLOCK // SALTS):
                    some = slice(a, a + BLOCK // SALTS)
                    at, low, high, hot, part = every[some], first[row[some]], first[row[some] + 1], hot_ones[some], items.slice(a, BLOCK // SALTS)
                    before, after = around(short, low, high, at - 1, -1, width, 0), around(short, low, high, at + least, 1, width, 0)
                    times = np.where(hot, SALTS, 1)
                    own = np.repeat(np.arange(len(at)), times)
                    salt = np.where(hot[own], np.arange(len(own)) - (np.cumsum(times) - times)[own] + 1, 0)
                    take = pa.array(row[some][own] + i)
                    yield pa.RecordBatch.from_arrays(
                        [part.field("fingerprint").take(pa.array(own)), pa.array(salt.astype(np.int32)), batch.column(k).take(take), batch.column(x).take(take), part.field("pos").take(pa.array(own)), pa.array(second_hash(h, at, least)[own]), _binary(before[own]), _binary(after[own])],
                        names=["fingerprint", "salt", "first_id", "first_hash", "first_pos", "second", "before", "after"],
                    )

    kind = placed.schema[doc_id].dataType.simpleString()
    return placed.mapInArrow(run, f"fingerprint long, salt int, first_id {kind}, first_hash long, first_pos int, second long, before binary, after binary")


def runs_of(h: np.ndarray, first: np.ndarray, row: np.ndarray, matches: pa.Array, least: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First words, and words behind the last, of the maximal runs around the matches of several documents with first positions.

    A match within its document (``own``: its first position, else -1) leaves the first ``least`` words of the run alone.
    """
    found = [_runs_of(h, first, row[:0], matches.slice(0, 0), least, width)]
    for a in range(0, len(row), BLOCK):  # so that memory follows the block and not the number of matches
        found.append(_runs_of(h, first, row[a : a + BLOCK], matches.slice(a, BLOCK), least, width))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _runs_of(h: np.ndarray, first: np.ndarray, row: np.ndarray, matches: pa.Array, least: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    at = first[row] + _numbers(matches, "pos")
    sure = np.flatnonzero(second_hash(h, at, least) == _numbers(matches, "second"))
    row, at, matches, short = row[sure], at[sure], matches.take(pa.array(sure)), _short(h)
    low, high, own = first[row], first[row + 1], _numbers(matches, "own")
    stored = lambda c: np.frombuffer(b"".join(matches.field(c).to_pylist()), np.uint32).reshape(-1, width)
    alike = lambda a, b: np.cumprod(a == b, axis=1, dtype=np.int8).sum(axis=1)
    begin = at - alike(around(short, low, high, at - 1, -1, width, 1), stored("before"))
    end = at + least + alike(around(short, low, high, at + least, 1, width, 1), stored("after"))
    begin = np.where(own >= 0, np.maximum(begin, begin - at + low + own + least), begin)
    good = end - begin >= least
    return begin[good], end[good]


def cut(text: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    """``text`` without the marked words. Lines of which nothing is left go; what is left on both sides of a deleted run is
    held apart by a space, or by a line break if the run went over one."""
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    out, at, n = [], 0, len(starts)
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        left, right = int(ends[a - 1]) if a else 0, int(starts[b]) if b < n else len(text)
        lead, tail = text.rfind(b"\n", left, int(starts[a])), text.find(b"\n", int(ends[b - 1]), right)
        heads, closes = a == 0 or lead >= 0, b == n or tail >= 0
        if heads and closes:
            stop = tail + 1 if tail >= 0 else len(text)
            out.append(text[at : lead if tail < 0 and lead >= 0 else lead + 1])
        elif heads:
            out.append(text[at : int(starts[a])])
            stop = right
        elif closes:
            out.append(text[at:left])
            stop = int(ends[b - 1])
        else:
            out += [text[at:left], b"\n" if b"\n" in text[left:right] else b" "]
            stop = right
        at = stop
    return b"".join([*out, text[at:]])


def _covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in one of the runs."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge)[:-1] > 0


def _edited(placed: DataFrame, text: str, least: int, width: int) -> DataFrame:
    """The table with the runs around its ``matches`` deleted from ``text``; n_deleted in the place of the matches."""
    columns = placed.columns
    t, m = columns.index(text), columns.index("matches")
    kept = [c for c in columns if c != "matches"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_deleted = np.zeros(len(batch), np.int64)
            some = np.flatnonzero(batch.column(m).value_lengths().fill_null(0).to_numpy(zero_copy_only=False) > 0)
            texts, matches = batch.column(t).take(pa.array(some)), batch.column(m).take(pa.array(some))
            changed, new = np.zeros(len(batch), bool), []
            for i, j, data, off in chunks(texts, TEXT):
                starts, ends, h, first = word_hashes(data, off)
                row, items = _lists(matches, i, j)
                begin, end = runs_of(h, first, row, items, least, width)
                gone = _covered(len(h), begin, end)
                n = np.diff(np.append(0, np.cumsum(gone))[first])
                n_deleted[some[i:j]] = n
                for r in np.flatnonzero(n):
                    a, b = first[r], first[r + 1]
                    new.append(cut(data[off[r] : off[r + 1]].tobytes(), starts[a:b] - off[r], ends[a:b] - off[r], gone[a:b]).decode())
                    changed[some[i + r]] = True
            column = batch.column(t)
            if new:
                column = pc.replace_with_mask(column, pa.array(changed), pa.array(new, column.type))
            yield pa.RecordBatch.from_arrays([*(column if c == text else batch.column(columns.index(c)) for c in kept), pa.array(n_deleted)], names=[*kept, "n_deleted"])

    return placed.mapInArrow(run, ddl(placed, kept, "n_deleted long"))


def dedup_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, sure: int = SURE) -> DataFrame:
    """``df`` with later repeated runs of words deleted from ``text``, and the column n_deleted (words) added.

    Documents are in the order of their ids (null ids come last, rows that share an id go by their text's hash). Of a
    run of ``sure`` words or more that occurs earlier (in a document before, or further up in the same one), all words go;
    a repetition of fewer than ``least`` words is never touched, and those between may go or stay. White space doesn't
    count in comparing, case does. First occurrences always stay: of a text that repeats itself without end (one word
    over and over) ``least`` words or a little more. A run is extended against the first place of its fingerprint; if the
    text around that place differs from the place that the run was copied from, up to sure - least words may stay
    at each end.

    Null texts stay null, empty ones empty. A text whose words all go is empty. Rows alike in id and text are one document
    and are treated alike. A column n_deleted of ``df`` is replaced. An empty table gives an empty result.

    Texts are shuffled once, as both joins with them take the same columns and Spark uses one exchange for both; so select
    the columns to keep before, not after.
    """
    need(df, [text, doc_id])
    if not 0 < least <= sure:
        raise ValueError("needs 0 < least <= sure")
    width = sure - least + 1
    found = written(_fingerprints(df, doc_id, text, least, width), "fingerprints")
    counts = written(found.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
    most = hot_from(found.count())
    hot = F.broadcast(counts.filter(F.col("n") > most).select("fingerprint"))  # fewer than common.HOT_SHARE
    rest = counts.filter(F.col("n") <= most).select("fingerprint")
    place = ["fingerprint", "id", "hash", "pos"]  # rows alike count once
    cold = found.join(hot, "fingerprint", "left_anti").join(rest, "fingerprint").select(*place, F.lit(0).alias("salt"))
    salted = found.join(hot, "fingerprint").select(*place, (F.pmod(F.xxhash64("id", "hash", "pos"), F.lit(SALTS)) + 1).cast("int"))
    found = cold.distinct().union(salted.distinct())
    found = written(found, "shared")
    origin = found.groupBy("fingerprint").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last"), F.max("salt").alias("salts")).filter("first != last").drop("last")
    origin = written(origin, "origins")

    inner = {c: f"_{i}" for i, c in enumerate(df.columns)}  # so that no column of ``df`` clashes
    base = df.select(*(F.col(f"`{c}`").alias(n) for c, n in inner.items()), _document(F.col(doc_id)).alias("_document"), F.xxhash64(text).alias("_hash"))
    body = inner[text]

    def by_document(d: DataFrame, item: Column, name: str) -> DataFrame:
        return d.groupBy(_document(F.col("id")).alias("_document"), F.col("hash").alias("_hash")).agg(F.collect_list(item).alias(name))

    # a first position with the words around it, once for each part of a hot fingerprint; rows alike give it several times
    firsts = by_document(origin.select("fingerprint", "salts", "first.id", "first.hash", "first.pos"), F.struct("pos", "fingerprint", "salts"), "wanted")
    known = _contexts(base.join(firsts, ["_document", "_hash"]), body, inner[doc_id], least, width).dropDuplicates(["fingerprint", "salt"])
    same = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash"))
    later = found.join(known, ["fingerprint", "salt"]).filter(~same | (F.col("pos") != F.col("first_pos")))
    own = F.when(same, F.col("first_pos")).otherwise(-1)
    later = by_document(later, F.struct("pos", own.alias("own"), "second", "before", "after"), "matches")
    both = _edited(base.join(later, ["_document", "_hash"], "left").select(*inner.values(), "matches"), body, least, width)
    order = [*df.columns, *(["n_deleted"] if "n_deleted" not in df.columns else [])]
    return both.select(*(F.col(c if c == "n_deleted" else inner[c]).alias(c) for c in order))
