"""Mixing of sources to target weights by capped water-filling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, hot_from, n_words, need, written

#: Hex digits of a document's key that make its bin: 4096 bins of each source.
BIN_DIGITS = 3


def _source(source: str) -> Column:
    """A key that is never null and sorts like the source's code points, null last."""
    return F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))


def _key(doc_id: str, size: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(size).cast("string")))


def _repeated(light: DataFrame) -> DataFrame:
    """(base, rows, alike) for each key that several rows have; ``alike``: the most of them with one text."""
    return light.groupBy("base", "hash").agg(F.count("*").alias("n")).groupBy("base").agg(F.sum("n").alias("rows"), F.max("n").alias("alike")).filter("rows > 1")


def _with_keys(df: DataFrame, repeated: DataFrame, most: int, base: str, text_hash: str, key: str) -> DataFrame:
    """Adds ``key``: the base where no other row has it, else one that also follows from the text and, among rows alike in that too,
    from the row's place. So rows with the same id (or none) and size are taken one by one and not together.

    Bases of more than ``most`` rows are joined by broadcast (see ``common.join_spread``).
    """
    if repeated.isEmpty():
        return df.withColumn(key, F.col(base))
    place, of = fresh(df, "_place"), repeated.select(F.col("base").alias("_base_"), "rows", "alike")
    df = df.withColumn(place, F.monotonically_increasing_id())
    own = F.when(F.col("alike") > 1, F.md5(F.concat_ws(":", base, text_hash, place))).otherwise(F.md5(F.concat_ws(":", base, text_hash)))
    hot, cold = of.filter(F.col("rows") > most), of.filter(F.col("rows") <= most)
    on = lambda side: df[base] == side["_base_"]
    many = df.join(F.broadcast(hot), on(hot))
    few = df.join(F.broadcast(hot), on(hot), "left_anti")
    few = few.join(cold, few[base] == cold["_base_"], "left")
    both = (x.withColumn(key, F.when(F.col("alike").isNull(), F.col(base)).otherwise(own)).drop("_base_", "rows", "alike", place) for x in (few, many))
    return next(both).unionByName(next(both))


def water_fill(sources: DataFrame, weights: list[int], share: float = 1.5, epochs: int = 2) -> DataFrame:
    """Adds target and weight to ``sources`` (s: its key, total: its size), which has one row for each source.

    The weights repeat in the order of s. ``share`` times the sum of all totals is dealt by weight; a source whose part
    would exceed ``epochs`` times its total is clamped there and the rest dealt among the others, until none exceeds it.
    The sources clamped are those least in total by weight, so one pass over them in that order finds the level at
    which all others stand. The windows hold one row for each source.
    """
    every = Window.orderBy("s")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    out = sources.withColumn("weight", weight).withColumn("cap", F.col("total") * epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "s")
    upto, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    out = out.withColumns({
        "place": F.row_number().over(order),
        "level_words": F.sum("total").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(upto), F.lit(0)),
        "level_weight": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0)),
    })
    # the first source that its part at this level doesn't exceed, with all before it clamped
    fits = F.col("level_words") * F.col("weight") <= F.col("cap") * F.col("level_weight")
    best = F.min(F.when(fits, F.struct("place", "level_words", "level_weight"))).over(whole)
    out = out.withColumn("best", best)
    level = F.col("best.level_words") * F.col("weight") / F.col("best.level_weight")
    return out.withColumn("target", F.when(F.col("best").isNull() | (F.col("place") < F.col("best.place")), F.col("cap").cast("double")).otherwise(level)).select("s", "total", "weight", "target")


def _plan(light: DataFrame, weights: list[int], share: float, epochs: int) -> DataFrame:
    """For each source (s): source_size, target, whole repetitions, and the last key of which one more is taken."""
    bin_of = F.substring("key", 1, BIN_DIGITS)
    bins = written(light.groupBy("s", bin_of.alias("bin")).agg(F.sum("size").alias("n")), "bins")
    filled = water_fill(bins.groupBy("s").agg(F.sum("n").alias("total")), weights, share, epochs)
    whole = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(F.lit(0)).cast("long")
    filled = written(filled.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("total")), "targets")
    within = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = bins.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0)))
    edge = before.join(filled.select("s", "rest"), "s").filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest")))
    edge = written(edge.select("s", "bin", "before", "rest"), "edges")
    keys = light.withColumn("bin", bin_of).join(edge, ["s", "bin"]).groupBy("s", "bin", "key", "before", "rest").agg(F.sum("size").alias("n"))
    inside = Window.partitionBy("s", "bin").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    taken = keys.withColumn("start", start).filter(F.col("start") + F.col("n") / 2 <= F.col("rest")).groupBy("s").agg(F.max("key").alias("last"))
    cuts = edge.join(taken, "s", "left").select("s", F.coalesce("last", "bin").alias("cut"))
    return written(filled.join(cuts, "s", "left").select("s", F.col("total").alias("source_size"), "target", "whole", F.coalesce("cut", F.lit("")).alias("cut")), "plan")


def _light(df: DataFrame, text: str, doc_id: str, source: str, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """Each row's doc_id, source, size and key, written; the keys that several rows had; and from how many rows on one is hot."""
    sized = df.select(F.col(doc_id).alias("doc_id"), _source(source).alias("s"), n_words(F.col(text)).alias("size"), F.xxhash64(text).alias("hash"))
    light = written(sized.withColumn("base", _key("doc_id", "size", seed)), "sizes")
    repeated, most = written(_repeated(light), "repeated"), hot_from(light.count())
    if not repeated.isEmpty():
        return written(_with_keys(light, repeated, most, "base", "hash", "key"), "keys"), repeated, most
    return light.withColumn("key", F.col("base")), repeated, most


def mix_plan(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = 1) -> DataFrame:
    """One row per row of ``df``: doc_id, size, source_size, target, taken.

    ``size`` is a text's number of words; all sources together get ``share`` times the words there are, by weight, none
    more than ``epochs`` times its own (see ``water_fill``). Of each document the mix takes the whole repetitions of
    its source; of the fraction left it takes documents in the order of a seeded hash, until the words taken come
    as near to the target as a document allows. The order is found in bins of that hash, so that no window holds
    more than a few thousandths of a source.

    Null texts have size 0; null sources are one source, the last; rows that share an id (or have none) and a size are
    taken one by one, in an order that follows from their texts and, where these are equal too, their places; other
    columns are ignored; an empty table gives an empty result.
    """
    need(df, [text, doc_id, source])
    light, _, _ = _light(df, text, doc_id, source, seed)
    out = light.join(_plan(light, list(weights), share, epochs), "s")
    taken = F.col("size") * (F.col("whole") + (F.col("key") <= F.col("cut")).cast("long"))
    return out.select(F.col("doc_id").alias(doc_id), "size", "source_size", "target", taken.alias("taken"))


def mix_documents(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = 1) -> DataFrame:
    """The mix itself: each row of ``df`` as often as ``mix_plan`` takes it, with the columns of ``df``.

    A document without words (null and empty texts too) counts nothing towards a target; it is repeated as its key says. Null sources
    are one source; repeated rows are taken one by one; an empty table gives an empty result.
    """
    need(df, [text, doc_id, source])
    light, repeated, most = _light(df, text, doc_id, source, seed)
    plan = _plan(light, list(weights), share, epochs)
    s, size, base, text_hash, key, times = (fresh(df, c) for c in ("_s", "_size", "_base", "_hash", "_key", "_times"))
    out = df.withColumn(s, _source(source)).withColumn(size, n_words(F.col(text))).withColumn(text_hash, F.xxhash64(text))
    out = _with_keys(out.withColumn(base, _key(doc_id, size, seed)), repeated, most, base, text_hash, key)
    inner = {c: f"_{i}_" for i, c in enumerate(df.columns)}  # so that no column of ``df`` clashes
    out = out.select(*(F.col(f"`{c}`").alias(n) for c, n in inner.items()), F.col(s).alias("s"), F.col(key).alias("_k_"))
    n = (F.col("whole") + (F.col("_k_") <= F.col("cut")).cast("long")).cast("int")
    both = out.join(plan, "s").select(*inner.values(), F.explode(F.array_repeat(F.lit(0), n)).alias(times))
    return both.select(*(F.col(n).alias(c) for c, n in inner.items()))
