"""Near-duplicate groups by SetSketch registers.

A register holds the least of exponentially distributed values, one from every element of the set, on a logarithmic
scale (larger register: smaller minimum), truncated to 16 bits. Sketches of two sets merge by the larger of each
register, and equal registers are the likelier the larger the sets' Jaccard similarity is.

Each element emits the points of a Poisson process, dealt to the registers at random: the points that a register gets
are again a Poisson process, so its first one is exponential, independent of the other registers. Points far beyond
what any register of a set of that size needs are never drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import ddl, fresh, hot_from, join_spread, need, new_path, written
from .components import connected_components
from .textarrays import LOWER, U64, chunks, hash_spans, mix, words

#: Registers of a sketch; how often two sets just at the threshold may miss each other in all bands.
REGISTERS, MISS = 238, 5e-6
#: Base of the registers' scale, and the rate that keeps registers of one-element sets positive.
BASE, RATE = 1.05, 20.0
#: A candidate stays unless similarity at the threshold is e**PRUNE times less likely than at the best estimate.
PRUNE = 14.0


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct ``n``-word shingles, ascending within a row, and the rows' offsets."""
    data = LOWER[data]
    starts, ends, first = words(data, off)
    h = hash_spans(data, starts, ends, seed=1)
    count = np.diff(first)
    with np.errstate(over="ignore"):
        total = h.copy()
        for k in range(1, n):
            total[:-k] += h[k:] * mix(np.array([k], U64))[0] if len(h) > k else U64(0)
        long = mix(total ^ U64(n))
        out, offsets = [], [0]
        for a, b, c in zip(first[:-1].tolist(), first[1:].tolist(), count.tolist(), strict=True):
            if c >= n:
                own = np.sort(long[a : b - n + 1])
                own = own[np.append(True, own[1:] != own[:-1])]
            elif c:
                x = U64(c)
                for w in h[a:b]:
                    x = mix(np.array([x ^ w], U64))[0]
                own = np.array([x], U64)
            else:
                own = h[:0]
            out.append(own)
            offsets.append(offsets[-1] + len(own))
    return np.concatenate([*out, np.zeros(0, U64)]), np.array(offsets, np.int64)


def sketches(elements: np.ndarray, off: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Registers (rows x ``m``, uint16) of sets given as flat distinct 64-bit elements; empty sets have all zeros."""
    size = np.diff(off)
    least = np.full(len(size) * m, np.inf)
    row = np.repeat(np.arange(len(size)), size)
    left, bound = size > 0, np.where(size > 0, (np.log(m) + 6) / np.maximum(size, 1), 0.0)
    while left.any():
        take = left[row]
        e, r, x, step = elements[take], row[take], np.zeros(int(take.sum())), 0
        while len(e):
            step += 1
            with np.errstate(over="ignore"):
                draw = mix(e + U64(step) * U64(0xD1342543DE82EF95))
            x = x - np.log(((draw >> U64(16)).astype(np.float64) + 0.5) * 2.0**-48) / m
            go = x <= bound[r]
            e, r, x, draw = e[go], r[go], x[go], draw[go]
            register = (((draw & U64(0xFFFF)) * U64(m)) >> U64(16)).astype(np.int64)
            np.minimum.at(least, r * m + register, x)
        left &= np.isinf(least.reshape(-1, m)).any(axis=1)
        bound = bound * 4
    least = least.reshape(-1, m)
    with np.errstate(divide="ignore"):
        value = np.floor(1 - np.log(least / RATE) / np.log(BASE))
    return np.where(np.isinf(least), 0, np.clip(value, 0, 65535)).astype(np.uint16)


def merge_sketches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def log_likelihood(plus, minus, equal, n_a, n_b, jaccard) -> np.ndarray:
    """Log-likelihood of ``jaccard``, given in how many registers a is larger, smaller or equal, and both set sizes."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u - v * jaccard), p(v - u * jaccard)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda k, q: np.where(k > 0, k * np.log(np.maximum(q, 1e-300)), 0.0)
        return part(plus, more) + part(minus, less) + part(equal, 1 - more - less)


def may_reach(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sketches can have a similarity of ``threshold``, by the joint likelihood of their registers."""
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    counts = [(x.sum(axis=1)) for x in (a > b, a < b, a == b)]
    grid = [log_likelihood(*counts, n_a, n_b, np.minimum(j, most)) for j in np.linspace(0, 1, 51)]
    at = np.maximum.reduce([log_likelihood(*counts, n_a, n_b, np.minimum(j, most)) for j in np.linspace(threshold, 1, 16)])
    return (most >= threshold - 1e-9) & (at >= np.maximum.reduce(grid) - PRUNE)


def _set_key(own: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return np.array([len(own) + int(np.add.reduce(mix(own))) & (2**64 - 1), np.add.reduce(mix(own ^ U64(0xABCDEF)))], U64).tobytes()


def _signatures(df: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """doc_id, text_hash, set_key, n_shingles, sketch for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in chunks(batch.column(2), 1 << 20):
                sets, at = shingle_sets(data, off, shingle)
                own = (sets[a:b] for a, b in zip(at[:-1], at[1:], strict=True))
                keys = pa.array([_set_key(x) if len(x) else None for x in own], pa.binary())
                sketch = pa.array([x.tobytes() for x in sketches(sets, at)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:2]), keys, pa.array(np.diff(at)), sketch], names=[doc_id, "text_hash", "set_key", "n_shingles", "sketch"])

    source = df.select(doc_id, F.xxhash64(text).alias("text_hash"), F.col(text).alias("_text_"))
    return source.mapInArrow(run, ddl(df, [doc_id], "text_hash long, set_key binary, n_shingles long, sketch binary"))


def _full_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(k, items) of rows (k, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in chunks(batch.column(1), 1 << 20):
                sets, at = shingle_sets(data, off, shingle)
                items = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), items], names=["k", "items"])

    return texts.mapInArrow(run, "k long, items array<long>")


@F.pandas_udf(BooleanType())
def _may_link(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series, threshold: pd.Series) -> pd.Series:
    left, right = (np.frombuffer(b"".join(x), np.uint16).reshape(len(x), -1) for x in (a, b))
    return pd.Series(may_reach(left, right, n_a.to_numpy(float), n_b.to_numpy(float), float(threshold.iloc[0])))


def band_width(similarity: float) -> int:
    """The most registers of a band with which sets of that similarity still meet, but for ``MISS``.

    Seven for 0.85 and six for 0.8; wider bands bring fewer dissimilar sets together.
    """
    equal = np.log1p(similarity * (BASE - 1)) / np.log(BASE)  # chance that a register of both is equal
    return next((r for r in range(16, 1, -1) if (1 - equal**r) ** (REGISTERS // r) <= MISS), 1)


def _bands(classes: DataFrame, similarity: float) -> DataFrame:
    """(bucket, k): one row for each class and band; the bucket is a hash of the band's number and registers."""
    each = band_width(similarity)
    width = 2 * each
    band = lambda i: F.xxhash64(i, F.substring("sketch", i * width + 1, F.lit(width)))
    return classes.select("k", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // each - 1)), band)).alias("bucket"))


def _linked(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set keys that the registers allow and the full sets confirm."""
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("k").alias(side), F.col("sketch").alias(f"s{side}"), F.col("n").alias(f"n{side}")), side)
    pairs = pairs.filter(_may_link("sa", "sb", "na", "nb", F.lit(percent / 100))).select("a", "b", "na", "nb")
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("k").alias(side), F.col("items").alias(f"i{side}")), side)
    both = F.size(F.array_intersect("ia", "ib"))
    return pairs.withColumn("both", both).filter(F.col("both") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, percent: int = 85) -> DataFrame:
    """One row per row of ``df``: doc_id, text_hash, group_key, n_shingles, component_id, kept.

    Two documents are linked if 100 x |intersection| >= ``percent`` x |union| of their sets of distinct word shingles;
    ``component_id`` is the smallest doc_id that links reach. Equal sets are one class, so copies are never paired.
    Classes that share a band meet in a bucket, where each is compared with the one that meets most others. Where a bucket
    still holds several components, its members are compared by their rarest shingles (see ``_prefix_pairs``), across
    all such buckets. So each link between classes that share a bucket is found or implied, and the pairs of a large
    group are never formed.

    Empty or null texts have no shingles and are linked with nothing. Rows that share a doc_id are documents of their
    own; null ids take part, but can't be a component_id unless nothing else is there (then it is null, and kept is
    false). Other columns are ignored. An empty table gives an empty result.
    """
    need(df, [text, doc_id])
    docs = written(_signatures(df, doc_id, text, shingle), "signatures")
    classes = docs.filter("n_shingles > 0").groupBy("set_key").agg(F.min("sketch").alias("sketch"), F.max("n_shingles").alias("n"), F.min(_row(doc_id)).alias("row"))
    # written, so that a class keeps its number
    classes = classes.select(F.monotonically_increasing_id().alias("k"), "set_key", "sketch", "n", F.col("row.id").alias("rep"), F.col("row.hash").alias("rep_hash"))
    classes = written(classes, "classes")
    rows = _bands(classes, percent / 100)
    shared = written(rows.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1"), "shared")
    most = hot_from(rows.count())
    live = written(join_spread(rows, shared, "bucket", "members", most).select("bucket", "k", "n", "members"), "buckets")
    # a class that meets many others is likely the one that they were copied from: it leads its buckets
    met = live.groupBy("k").agg(F.sum("members").alias("met"))
    live = written(live.join(met, "k"), "buckets")
    sets = _bucketed_sets(df, text, doc_id, shingle, met.join(classes, "k").select("k", "rep", "rep_hash"))
    # first each class with the leader of each of its buckets
    leaders = live.groupBy("bucket").agg(F.max_by(F.struct("k", "n"), F.struct("met", -F.col("k"))).alias("lead"), F.max("members").alias("size"))
    pairs = join_spread(live, leaders.select("bucket", F.col("lead.k").alias("a"), F.col("lead.n").alias("n_a"), "size"), "bucket", "size", most)
    pairs = pairs.filter((F.col("k") != F.col("a")) & _sizes_allow("n", "n_a", percent)).select(F.least("a", "k").alias("a"), F.greatest("a", "k").alias("b")).distinct()
    links = written(_linked(pairs, classes, sets, percent), "links")
    roots = _roots(links)
    # then, where a bucket still holds several components, their other members
    now = _with_roots(live, roots)
    undone = now.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("members").alias("size")).filter((F.col("lo") != F.col("hi")) & (F.col("size") > 2))
    rest = written(join_spread(now, undone.select("bucket", "size"), "bucket", "size", most).select("k", "n", "root").distinct(), "rest")
    if not rest.isEmpty():
        roots = _roots(links.union(_linked(_prefix_pairs(rest, sets, percent), classes, sets, percent)))
    of = _with_roots(classes.select("k", "set_key", "rep"), roots)
    least = of.groupBy("root").agg(F.min("rep").alias("component"), F.count("*").alias("size"))
    groups = join_spread(of, least, "root", "size", most).select("set_key", F.col("root").alias("group_key"), "component")
    out = docs.join(groups, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col(doc_id)).otherwise(F.col("component"))
    out = out.withColumn("component_id", component)
    kept = F.coalesce(F.col(doc_id) == F.col("component_id"), F.lit(False))
    return out.select(doc_id, "text_hash", "group_key", "n_shingles", "component_id", kept.alias("kept"))


def _roots(links: DataFrame) -> DataFrame:
    return connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))


def _sizes_allow(a: str, b: str, percent: int) -> Column:
    """False where the sets' sizes alone rule a link out."""
    return F.least(a, b) * 100 >= percent * F.greatest(a, b)


def _prefix_pairs(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of classes of ``rest`` (k, n, root) that can be linked and aren't in one component yet.

    Two sets that are similar enough share an element among the rarest of each: those that are left when ``percent`` of
    the elements, less one, are taken away as the most frequent. Rarity is counted over ``rest``. So passages that many
    documents share join nobody; only elements that few of them share do.
    """
    items = rest.join(sets, "k").select("k", "n", "root", F.explode("items").alias("item"))
    often = items.groupBy("item").agg(F.count("*").alias("f")).filter("f > 1")
    items = items.join(often, "item")
    of = Window.partitionBy("k")
    first = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1  # of all elements, by rarity
    items = items.withColumn("place", F.row_number().over(of.orderBy("f", "item")) + F.col("n") - F.count("*").over(of))
    items = written(items.filter(F.col("place") <= first).select("item", "k", "n", "root", "place"), "prefixes")
    other = items.select("item", *(F.col(x).alias(f"{x}_b") for x in ("k", "n", "root", "place")))
    # what follows a pair's first common element bounds how many more they can have in common
    common = F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b")) + 1
    enough = common * (100 + percent) >= percent * (F.col("n") + F.col("n_b"))
    pairs = items.join(other, "item").filter((F.col("k") < F.col("k_b")) & (F.col("root") != F.col("root_b")) & _sizes_allow("n", "n_b", percent) & enough)
    return pairs.select(F.col("k").alias("a"), F.col("k_b").alias("b")).distinct()


def _with_roots(df: DataFrame, roots: DataFrame) -> DataFrame:
    return df.join(roots.select(F.col("node").alias("k"), "root"), "k", "left").withColumn("root", F.coalesce("root", "k"))


def _bucketed_sets(df: DataFrame, text: str, doc_id: str, shingle: int, wanted: DataFrame) -> DataFrame:
    """The full sets of the classes in ``wanted``, in a table bucketed by class: joins with pairs don't move it again.
    ``common.clean_up`` drops it."""
    spark = df.sparkSession
    texts = df.select(doc_id, F.col(text).alias("_text_")).join(wanted, F.col(doc_id).eqNullSafe(F.col("rep")) & (F.xxhash64("_text_") == F.col("rep_hash"))).select("k", "_text_")
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), new_path(spark, "sets")
    name = f"sets_{spark.sparkContext.applicationId.replace('-', '_')}_{path.rpartition('-')[2]}".lower()
    sets = _full_sets(texts, shingle).groupBy("k").agg(F.first("items").alias("items"))
    sets.repartition(n, "k").write.bucketBy(n, "k").sortBy("k").option("path", path).saveAsTable(name)
    return spark.table(name)


def _row(doc_id: str) -> Column:
    """What orders rows: known ids first, ascending, then the text's hash."""
    return F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.col("text_hash").alias("hash"))


def drop_near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, percent: int = 80, whole: DataFrame | None = None) -> DataFrame:
    """``df`` with one row of each group of near-duplicates: its least doc_id (rows that share it: the least text hash).

    With ``whole`` (doc_id and text: the documents as they were before passages were cut) documents are linked by what they
    were, too: a copy of which only the edited places are left still goes with what it was copied from. Only ids that
    stand once in either table, with different texts, have a text of both kinds.

    Documents without words are linked with nothing and all stay. If all ids of a group are null, its least text hash
    stays; rows alike in id and text count as one; an empty table stays empty.
    """
    texts, cut = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), None
    if whole is not None:
        whole = whole.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        once = lambda d, name: d.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias(f"n_{name}"), F.min(F.xxhash64("text")).alias(name)).filter(f"n_{name} = 1")
        cut = written(once(whole, "was").join(once(texts, "now"), "doc_id").filter("was != now").select("doc_id", "was"), "cut")
        texts = texts.unionByName(whole.join(cut.select("doc_id"), "doc_id", "left_semi"))
    found = near_duplicates(texts, "text", "doc_id", shingle, percent)
    if cut is not None:
        found = written(found.join(cut, "doc_id", "left").withColumn("now", F.col("was").isNull() | (F.col("text_hash") != F.col("was"))).drop("was"), "groups")
        # a document's two texts join their groups
        joins = found.join(cut, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("group_key").alias("u"), F.max("group_key").alias("v")).filter("u != v")
        roots = connected_components(joins.select("u", "v")).select(F.col("node").alias("group_key"), "root")
        best = found.filter("n_shingles > 0 AND now").groupBy("group_key").agg(F.min(_row("doc_id")).alias("best"))
        best = best.join(roots, "group_key", "left").groupBy(F.coalesce("root", "group_key").alias("group_key")).agg(F.min("best").alias("best"))
        found = found.filter("now")
    else:
        best = found.filter("n_shingles > 0").groupBy("group_key").agg(F.min(_row("doc_id")).alias("best"))
    keep = best.select("best.id", "best.hash").union(found.filter("n_shingles = 0").select("doc_id", "text_hash"))
    keep = keep.distinct().toDF("_id_", "_hash_")
    hash_name = fresh(df, "_text_hash")
    out = df.withColumn(hash_name, F.xxhash64(text))
    out = out.join(keep, out[doc_id].eqNullSafe(keep["_id_"]) & (out[hash_name] == keep["_hash_"]), "left_semi")
    return out.dropDuplicates([doc_id, hash_name]).drop(hash_name)
