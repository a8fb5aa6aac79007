"""Document quality by regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics (lengths, shares of kinds of characters, repetition). Each class
has a mean and a covariance that is shrunk towards the pooled covariance and that towards its diagonal; the Cholesky
factors are computed once and sent with the model. A score is the difference of the classes' Gaussian log-densities
(Mahalanobis distance and log-determinant), calibrated to a probability on the training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, fresh, need
from .textarrays import U64, chunks, hash_spans, mix, spans_between, words

FEATURES = ("words", "word_length", "letters", "capitals", "digits", "marks", "stops", "symbols", "wide", "lines", "line_words", "distinct_words", "distinct_pairs", "repeats", "repeated_lines", "marked_words", "capital_words", "first_tenth")
_KINDS = np.zeros((256, 6), np.int32)
_KINDS[list(range(65, 91)) + list(range(97, 123)), 0] = 1
_KINDS[65:91, 1] = 1
_KINDS[48:58, 2] = 1
_KINDS[[ord(c) for c in ".,;:'\"-()?"], 3] = 1
_KINDS[[ord(c) for c in "!#$%&*|@<>{}[]=+~^_\\/`"], 4] = 1
_KINDS[128:, 5] = 1


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags))
    return total[off[1:]] - total[off[:-1]]


def _distinct(keys: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each row."""
    with np.errstate(over="ignore"):
        codes, values = pd.factorize(mix(keys ^ mix(row.astype(U64))))
    first = np.empty(len(values), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return np.bincount(row[first], minlength=n)


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The transformed statistics (rows x features) of UTF-8 texts; an empty text has zeros only."""
    n = len(off) - 1
    size = np.diff(off)
    ws, we, at = words(data, off)
    count = np.diff(at)
    row = np.repeat(np.arange(n), count)
    kinds = [_per_row(_KINDS[data, k], off) for k in range(6)]
    h = hash_spans(data, ws, we, seed=21)
    inner = row[1:] == row[:-1]
    same = np.append(False, inner & (h[1:] == h[:-1]))
    with np.errstate(over="ignore"):
        pairs = mix(h[1:] * U64(3) + h[:-1])[inner]
    ls, le, lat = spans_between(data == 10, off)
    lines = np.diff(lat)
    line_row = np.repeat(np.arange(n), lines)
    last = data[we - 1] if len(we) else data[:0]
    lead = data[ws] if len(ws) else data[:0]
    shout = (lead >= 65) & (lead <= 90) & (we - ws > 1)
    shout[shout] = np.isin(data[ws[shout] + 1] >> 5, [2])
    per = lambda x, of: x / np.maximum(of, 1)
    tenth = np.minimum(at[:-1] + np.maximum(count // 10, 1), at[1:])
    head = tenth - at[:-1]
    known = _distinct(h, row, n)
    in_head = np.arange(len(h)) < tenth[row] if len(h) else np.zeros(0, bool)
    columns = [
        np.log1p(count),
        np.log1p(per((we - ws).sum() if n == 1 else _sum(we - ws, at), count)),
        np.sqrt(per(kinds[0], size)),
        np.sqrt(per(kinds[1], size)),
        np.sqrt(per(kinds[2], size)),
        np.sqrt(per(kinds[3], size)),
        np.sqrt(per(_sum(last == 46, at), count)),
        np.sqrt(per(kinds[4], size)),
        np.sqrt(per(kinds[5], size)),
        np.log1p(lines),
        np.log1p(per(count, lines)),
        per(known, count) * np.log1p(count),
        np.sqrt(per(count - (count > 0) - _distinct(pairs, row[1:][inner], n), count)),
        np.sqrt(per(_sum(same, at), count)),
        np.sqrt(per(lines - _distinct(hash_spans(data, ls, le, seed=22), line_row, n), lines)),
        np.sqrt(per(_sum(_KINDS[last, 4], at), count)),
        np.sqrt(per(_sum(shout, at), count)),
        per(_distinct(h[in_head], row[in_head], n), head),
    ]
    out = np.stack(columns, 1)
    out[count == 0] = 0
    return out


def _sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values))
    return total[at[1:]] - total[at[:-1]]


@dataclass(frozen=True)
class Discriminant:
    means: np.ndarray
    inverse_factors: np.ndarray
    log_terms: np.ndarray
    slope: float
    shift: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, with the classes' shares."""
        part = []
        for mean, inverse, term in zip(self.means, self.inverse_factors, self.log_terms, strict=True):
            z = (x - mean) @ inverse.T
            part.append(term - 0.5 * np.einsum("ij,ij->i", z, z))
        return part[1] - part[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        d = np.clip(self.slope * np.arcsinh(self.log_odds(x)) + self.shift, -500, 500)
        return 1 / (1 + np.exp(-d))


def fit(x: np.ndarray, y: np.ndarray, shares: np.ndarray, to_pooled: float = 0.3, to_diagonal: float = 0.1) -> Discriminant:
    """``shares``: the classes' shares among all training labels, where ``x`` may hold a bounded sample of each.

    Each class needs two documents at least; with fewer there is nothing to tell them apart by, and every score is 0.5.
    """
    groups = [x[y == k] for k in (0, 1)]
    if min(map(len, groups)) < 2:
        return Discriminant(np.zeros((2, x.shape[1])), np.zeros((2, x.shape[1], x.shape[1])), np.zeros(2), 1.0, 0.0)
    means = np.array([g.mean(axis=0) for g in groups])
    own = [np.cov(g, rowvar=False) for g in groups]
    pooled = sum(c * s for c, s in zip(own, shares, strict=True))
    floor = np.diag(np.maximum(np.diag(pooled), 1e-6) * 1e-3 + 1e-9)
    inverse, terms = [], []
    for c, s in zip(own, shares, strict=True):
        c = (1 - to_pooled) * c + to_pooled * pooled
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + floor
        factor = np.linalg.cholesky(c)
        inverse.append(np.linalg.inv(factor))
        terms.append(np.log(s) - np.log(np.diag(factor)).sum())
    rough = Discriminant(means, np.array(inverse), np.array(terms), 1.0, 0.0)
    d = np.arcsinh(rough.log_odds(x))
    weight = np.where(y == 1, shares[1] / len(groups[1]), shares[0] / len(groups[0])) * len(y)
    # a logistic regression on the one value, by Newton steps; the penalty holds it where classes are separable
    fitted, penalty, design = np.array([1.0, 0.0]), 0.1, np.stack([d, np.ones(len(d))], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ fitted, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - penalty * (fitted - [1.0, 0.0])
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + penalty * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        fitted = fitted + step * min(1.0, 0.5 / np.abs(step).max(initial=1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return Discriminant(means, np.array(inverse), np.array(terms), float(max(fitted[0], 1e-3)), float(fitted[1]))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _features(df: DataFrame, keep: list[str], text: str, model: Discriminant | None, threshold: float, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The kept columns with the statistics (x), or with score and prediction of ``model`` under two names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            for i, j, data, off in chunks(column, 2 << 20):
                x = statistics(data, off)
                same = [c.slice(i, j - i) for c in batch.columns[: len(keep)]]
                if model is None:
                    new = [pa.array(list(x), pa.list_(pa.float64()))]
                else:
                    score = model.score(x)
                    new = [pa.array(score), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*same, *new], names=[*keep, *(["x"] if model is None else names)])

    return df.select(*keep, F.col(text).alias(fresh(df, "_text_"))).mapInArrow(run, ddl(df, keep, "x array<double>" if model is None else f"{names[0]} double, {names[1]} int"))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", most: int = 6000) -> Discriminant:
    """Fits on the labelled documents outside the held-out fifth.

    ``most``: bound on the labelled ids of each class. Where a class has more, those whose id has a hash below the share
    that leaves nine tenths of ``most`` are taken, which needs no ordering of the rows; so at most about 2 x ``most`` vectors of
    18 numbers reach the driver, at any size of corpus, and at small sizes all labels count. Rows alike in id count once:
    the one whose statistics come first. Vectors are put in the order of their numbers, so that a fit doesn't depend on the
    order of arrival. Labels that are null, that contradict each other for an id, or whose id is null or held out, aren't
    used. With fewer than two documents in a class, all scores are 0.5.
    """
    clean = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    clean = clean.groupBy(doc_id).agg(F.min(label).alias("y"), F.max(label).alias("_y")).filter("y = _y").select(doc_id, "y")
    count = {r["y"]: r["n"] for r in clean.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.pmod(F.xxhash64(doc_id), F.lit(1 << 30)) / (1 << 30)
    kept = [F.lit(1.0) if count.get(k, 0) <= most else F.lit(0.9 * most / count[k]) for k in (0, 1)]
    taken = clean.filter(share < F.when(F.col("y") == 1, kept[1]).otherwise(kept[0]))
    used = docs.select(doc_id, text).join(F.broadcast(taken), doc_id)  # at most 2 x most rows of two numbers
    rows = _features(used, [doc_id, "y"], text, None, 0).groupBy(doc_id, "y").agg(F.min("x").alias("x")).select("y", "x").toArrow()
    y = rows["y"].to_numpy()
    x = np.array(rows["x"].to_pylist(), float).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T[::-1], y))
    return fit(x[order], y[order], np.array([count.get(0, 0), count.get(1, 0)]) / max(1, sum(count.values())))


def score(docs: DataFrame, model: Discriminant, text: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """``docs`` (or its ``keep`` columns) with score (0 to 1, higher: class 1 is likelier) and predicted (0 or 1).

    The score follows from the whole text alone. Null and empty texts are scored as a text without words; repeated rows
    get equal scores; columns score and predicted of ``docs`` give way to the new ones; an empty table gives an empty
    result.
    """
    need(docs, [text])
    keep = [c for c in keep or docs.columns if c not in ("score", "predicted")]
    return _features(docs, keep, text, model, threshold)


def drop_low_quality(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with the columns of ``docs``."""
    need(docs, [text, doc_id])
    names = fresh(docs, "_score"), fresh(docs, "_predicted")
    found = _features(docs, docs.columns, text, train(docs, labels, text, doc_id), threshold, names)
    return found.filter(F.col(names[1]) == 1).select(*docs.columns)
