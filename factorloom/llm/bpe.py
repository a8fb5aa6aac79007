"""Byte-level BPE on ragged numpy arrays.

Texts are cut into pre-tokens by classes of characters (the public pattern of byte-level BPE), all pre-tokens of a
chunk at once. Every distinct pre-token is then merged once: the pre-tokens lie one after the other in a flat symbol
array, and each round applies, in every pre-token at once, all non-overlapping occurrences of that pre-token's
lowest-ranked pair. Rounds end when no pair is left in any of them; the surviving symbols are the tokens.

Special strings are cut out of a text first and count as one token each. Classes of characters that changed between
Unicode versions are asked of the tokenizer library, once for each character, so that they are those of its version.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from .textarrays import chunks, hash_spans, ragged

_NONE = np.int32(2**31 - 1)
_OTHER, _LETTER, _NUMBER, _SPACE, _BLANK = range(5)
#: Pre-tokens whose merged form a worker keeps; beyond that it starts anew (results don't depend on it).
KEPT = 400_000


def bytes_to_chars() -> list[str]:
    """The public byte alphabet of byte-level BPE: printable bytes stand for themselves, others follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = itertools.count(256)
    return [chr(b if b in own else next(rest)) for b in range(256)]


class _Classes:
    """Class of each code point, filled page by page when a text needs it.

    A class that no Unicode version since 3.2 has changed is Python's. Any other one is found with the library's own
    splitting into pre-tokens: a character belongs to the class whose example it stays together with.
    """

    def __init__(self) -> None:
        self.table = np.zeros(0x110000, np.uint8)
        self.ready = np.zeros(0x1100, bool)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        pages = np.flatnonzero(np.bincount(points >> 8, minlength=1))
        for page in pages[~self.ready[pages]]:
            for c in range(page << 8, (page + 1) << 8):
                self.table[c] = self._of(c)
            self.ready[page] = True
        return self.table[points]

    @functools.cached_property
    def _split(self):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers.pre_tokenizers import ByteLevel

        return ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str

    def _of(self, c: int) -> int:
        if 0xD800 <= c < 0xE000:  # never in valid text
            return _OTHER
        now, old = unicodedata.category(chr(c)), unicodedata.ucd_3_2_0.category(chr(c))
        if now[0] != old[0] or now == "Cn":
            return next((k for k, example in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")) if len(self._split(example + chr(c))) == 1), _SPACE)
        if c == 32:
            return _BLANK
        if now[0] == "Z" or 9 <= c <= 13 or c == 0x85:
            return _SPACE
        return {"L": _LETTER, "N": _NUMBER}.get(now[0], _OTHER)


_classes = _Classes()


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position and code point of every character of valid UTF-8."""
    lead = (data & 0xC0) != 0x80
    if lead.all() and (not len(data) or data.max() < 128):
        return np.arange(len(data), dtype=np.int64), data.astype(np.int32)
    at = np.flatnonzero(lead)
    b = data[at].astype(np.int32)
    follow = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32) & 0x3F
    out = b.copy()
    for low, high, bits, n in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        i = np.flatnonzero((b >= low) & (b < high))
        value = b[i] & bits
        for k in range(1, n + 1):
            value = (value << 6) | follow[at[i] + k]
        out[i] = value
    return at, out


def pre_tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of all pre-tokens (they tile the bytes)."""
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e
    at, points = code_points(data)
    kind = _classes(points)
    count = len(at)
    row_start = np.zeros(count, bool)
    row_first = np.searchsorted(at, off[:-1][off[:-1] < off[1:]])
    row_start[row_first] = True
    blank = kind == _BLANK
    kind[blank] = _SPACE
    change = row_start.copy()
    change[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(change)
    end = np.append(run[1:], count)
    of = kind[run]
    inner = ~row_start[run]  # the run before is in the same row
    mark = np.zeros(count, bool)
    dark = of != _SPACE
    takes = dark & inner & (run > 0)
    takes[takes] = blank[run[takes] - 1]
    mark[run[dark] - takes[dark]] = True
    followed = np.zeros(len(run), bool)
    followed[:-1] = inner[1:]
    white = ~dark
    last_blank = blank[end - 1]
    alone = white & ~followed
    mark[run[alone]] = True
    led = white & followed
    mark[run[led & (end - run > 1)]] = True
    mark[end[led & ~last_blank] - 1] = True
    quote = np.flatnonzero((points[run] == 0x27) & (end - run == 1) & (of == _OTHER) & ~takes & followed)
    quote = quote[of[quote + 1] == _LETTER]
    if len(quote):
        s = run[quote] + 1
        a = points[s]
        b = np.where(s + 1 < end[quote + 1], points[np.minimum(s + 1, count - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for hit, size in ((one, 1), (two & ~one, 2)):
            mark[s[hit]] = False
            rest = s[hit] + size
            mark[rest[rest < end[quote + 1][hit]]] = True
    starts = at[mark]
    return starts, np.append(starts[1:], n)


class Vocabulary:
    """Merge ranks of one tokenizer file; with the merged forms of pre-tokens seen of late."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        if not plain or spec["normalizer"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        vocab, chars = model["vocab"], bytes_to_chars()
        self.path = path
        added = spec["added_tokens"]
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added):
            raise ValueError(f"{path} has special strings that depend on what is around them")
        self.special = {t["content"].encode(): t["id"] for t in added if t["content"]}
        self.marks = re.compile(b"|".join(re.escape(m) for m in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.of_byte = np.array([vocab[c] for c in chars], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        key, first = np.unique(key, return_index=True)
        self.keys, self.ranks, self.made = np.append(key, np.int64(2**62)), first.astype(np.int32), made[first]
        self.forget()

    def forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left.astype(np.int64) << 20) | right
        i = np.searchsorted(self.keys, key)
        known = self.keys[i] == key
        i[~known] = 0
        return np.where(known, self.ranks[i], _NONE), self.made[i]

    def merge(self, sym: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols and their sequence numbers. ``seq`` is ascending; all arrays run over symbols."""
        done_sym, done_seq = [], []
        rank, made = np.full(len(sym), _NONE), np.zeros(len(sym), np.int32)
        inner = np.flatnonzero(seq[1:] == seq[:-1])
        rank[inner], made[inner] = self._rank(sym[inner], sym[inner + 1])
        while len(sym):
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            low = np.minimum.reduceat(rank, first)
            lens = np.diff(np.append(first, len(sym)))
            low = np.repeat(low, lens)
            over = low == _NONE
            if over.any():
                done_sym.append(sym[over])
                done_seq.append(seq[over])
                go = ~over
                sym, seq, rank, made, low = sym[go], seq[go], rank[go], made[go], low[go]
                if not len(sym):
                    break
            hit = rank == low
            both = hit[1:] & hit[:-1]
            if both.any():  # a pair of equal symbols: in a run of hits every second one counts, from the left
                i = np.arange(len(hit))
                begin = hit & ~np.append(False, hit[:-1])
                hit &= (i - np.maximum.accumulate(np.where(begin, i, 0))) % 2 == 0
            at = np.flatnonzero(hit)
            sym[at] = made[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            moved = np.cumsum(stay) - 1
            rank[at] = rank[at + 1]
            sym, seq, rank, made = sym[stay], seq[stay], rank[stay], made[stay]
            at = moved[at]
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            touched[at[at > 0] - 1] = True
            rank[touched] = _NONE
            touched[:-1] &= seq[1:] == seq[:-1]
            touched[-1] = False
            again = np.flatnonzero(touched)
            rank[again], made[again] = self._rank(sym[again], sym[again + 1])
        sym, seq = np.concatenate([*done_sym, np.zeros(0, np.int32)]), np.concatenate([*done_seq, np.zeros(0, np.int32)])
        order = np.argsort(seq, kind="stable")
        return sym[order], seq[order]

    def _slots(self, data, starts, ends) -> np.ndarray:
        """For each pre-token the place of its merged form in ``counts``; unseen ones are merged first."""
        codes, distinct = pd.factorize(hash_spans(data, starts, ends, seed=3))
        if len(self.slot) + len(distinct) > KEPT:
            self.forget()
        known = np.fromiter(map(self.slot.get, distinct.tolist(), itertools.repeat(-1)), np.int64, len(distinct))
        if (new := np.flatnonzero(known < 0)).size:
            example = np.empty(len(distinct), np.int64)
            example[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            s = starts[example[new]]
            lens = ends[example[new]] - s
            sym, seq = self.merge(self.of_byte[data[ragged(s, lens)]], np.repeat(np.arange(len(new), dtype=np.int32), lens))
            known[new] = len(self.counts) + np.arange(len(new))
            self.slot.update(zip(distinct[new].tolist(), known[new].tolist(), strict=True))
            self.counts = np.append(self.counts, np.bincount(seq, minlength=len(new)))
            self.ids = np.append(self.ids, sym)
        return known[codes]

    def _marked(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and ids of the special strings of all rows, in order."""
        found: list[tuple[int, int, int]] = []
        if self.marks and len(data):
            raw = data.tobytes()
            if self.marks.search(raw):
                for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    found += [(m.start(), m.end(), self.special[m[0]]) for m in self.marks.finditer(raw, a, b)]
        return tuple(np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def encode(self, column: pa.Array, ids: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
        """(first row, row after the last, tokens of each row, all their ids or None) for chunks of a column."""
        for i, j, data, off in chunks(column):
            begin, end, marks = self._marked(data, off)
            # what lies between special strings is a text of its own
            starts, ends = pre_tokens(data, np.sort(np.concatenate([off, begin, end])) if len(marks) else off)
            inside = np.zeros(len(starts), bool)
            if len(marks):
                at = np.searchsorted(begin, starts, "right") - 1
                inside = (at >= 0) & (starts < end[at])
            plain = ~inside
            slot = self._slots(data, starts[plain], ends[plain]) if plain.any() else np.zeros(0, np.int64)
            counts_of, ids_of, starts_of = self.counts, self.ids, starts
            if len(marks):  # one place more for each special string, at the end of the tables
                where = np.concatenate([starts[plain], begin])
                slot = np.concatenate([slot, len(counts_of) + np.arange(len(marks))])
                order = np.argsort(where, kind="stable")
                slot, starts_of = slot[order], where[order]
                counts_of, ids_of = np.append(counts_of, np.ones(len(marks), np.int64)), np.append(ids_of, marks.astype(np.int32))
            size = counts_of[slot]
            first = np.searchsorted(starts_of, off)
            total = np.append(0, np.cumsum(size))
            counts = total[first[1:]] - total[first[:-1]]
            flat = None
            if ids:
                place = np.append(0, np.cumsum(counts_of))[:-1]
                flat = ids_of[ragged(place[slot], size)]
            yield i, j, counts, flat


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each worker process."""
    return Vocabulary(path)
