"""Panels: one row for each date and asset, with double feature columns and ``returns_*`` label columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.functions.stats import ASSET, TIME, clean, over_time

LABEL = "returns_"
_SYNONYMS = {"instrument": ASSET, "date": TIME}


def read_panel(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return normalise(spark.read.parquet(path), strict)


def normalise(df: DataFrame, strict: bool = False) -> DataFrame:
    """Key columns by their usual names, numbers as clean doubles. ``strict``: both keys must already be there."""
    if not strict:
        for old, new in _SYNONYMS.items():
            if old in df.columns and new not in df.columns:
                df = df.withColumnRenamed(old, new)
    missing = [k for k in (TIME, ASSET) if k not in df.columns]
    if missing:
        raise ValueError(f"a panel needs {TIME} and {ASSET}; missing: {missing}")
    number = ("double", "float", "int", "bigint", "smallint", "tinyint")
    keep = [clean(c).alias(c) if t in number or t.startswith("decimal") else F.col(f"`{c}`") for c, t in df.dtypes if c not in (TIME, ASSET)]
    return df.select(F.col(TIME).cast("timestamp").alias(TIME), F.col(ASSET).cast("string").alias(ASSET), *keep)


def warnings(df: DataFrame) -> list[str]:
    """What is wrong with a panel: missing keys, no rows."""
    out = [f"missing_index_level:{k}" for k in (TIME, ASSET) if k not in df.columns]
    return out + (["empty_panel"] if df.isEmpty() else [])


def split_columns(df: DataFrame, allowed: Iterable[str] | None = None, text_features: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """(features, labels): labels begin with ``returns_``; ``allowed`` restricts the other columns, text features follow."""
    labels = [c for c in df.columns if c.startswith(LABEL)]
    rest = [c for c in df.columns if c not in labels and c not in (TIME, ASSET)]
    allowed = rest if allowed is None else list(allowed)
    first = [c for c in rest if c in allowed and c not in set(text_features)]
    return first + [c for c in text_features if c in rest], labels


def dates(df: DataFrame) -> DataFrame:
    """The calendar: each date once, with its number from 0 on. One row a date, so one window over all is small."""
    return df.select(TIME).distinct().withColumn("date_no", F.row_number().over(Window.orderBy(TIME)) - 1)


def instruments(df: DataFrame) -> DataFrame:
    """First and last date of each asset."""
    return df.groupBy(ASSET).agg(F.min(TIME).alias("first_date"), F.max(TIME).alias("last_date"))


def universe(df: DataFrame) -> DataFrame:
    return df.select(F.upper(ASSET).alias(ASSET)).distinct()


def split_by_fraction(df: DataFrame, fraction: float, name: str = "segment") -> DataFrame:
    """Adds train or valid: the first max(1, int(dates x fraction)) dates are train; without others, all are both.

    The calendar of one row a date is what the panel is joined with.
    """
    calendar = dates(df)
    n = calendar.agg(F.count("*").alias("n_dates"))
    cut = F.greatest(F.lit(1), F.floor(F.col("n_dates") * fraction))
    part = F.when(F.col("date_no") < cut, F.when(cut >= F.col("n_dates"), "both").otherwise("train")).otherwise("valid")
    return df.join(calendar.crossJoin(n).select(TIME, part.alias(name)), TIME)


def in_window(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.filter(F.col(TIME).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def segments(df: DataFrame, ranges: dict[str, tuple[str, str]], name: str = "segment") -> DataFrame:
    """Adds the name of the inclusive date range that a row lies in (the first that fits; else null)."""
    out = F.lit(None).cast("string")
    for key, (start, end) in reversed(ranges.items()):
        out = F.when(F.col(TIME).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")), key).otherwise(out)
    return df.withColumn(name, out)


def complement(calendar: DataFrame, part: DataFrame) -> DataFrame:
    """The dates of a calendar that a part of it lacks."""
    return calendar.join(part.select(TIME).distinct(), TIME, "left_anti")


def debug_slice(df: DataFrame, n_dates: int = 180, n_assets: int = 20) -> DataFrame:
    """The last dates of the first assets."""
    days = df.select(TIME).distinct().orderBy(F.desc(TIME)).limit(n_dates)
    assets = df.select(ASSET).distinct().orderBy(ASSET).limit(n_assets)
    return df.join(F.broadcast(days), TIME, "left_semi").join(F.broadcast(assets), ASSET, "left_semi")


def forward_return(price: str = "close", ahead: int = 1) -> Column:
    return F.try_divide(F.lead(price, ahead).over(over_time()), F.col(price)) - 1


def with_label(df: DataFrame, label: str = "returns_1d", price: str = "close") -> DataFrame:
    """``df`` with a label column; derived from the next row's price where there is none."""
    return df if label in df.columns else df.withColumn(label, forward_return(price))


def baseline_features(df: DataFrame) -> DataFrame:
    """Four plain features, and as label the return from the next row to the one after it."""
    w = over_time()
    before = F.lag("close", 1).over(w)
    return df.withColumns({
        "body": F.try_divide(F.col("close") - F.col("open"), F.col("open")),
        "volume_ratio": F.try_divide(F.col("volume"), F.avg("volume").over(w.rowsBetween(-19, 0))),
        "range_ratio": F.try_divide(F.col("high") - F.col("low"), before),
        "momentum": F.try_divide(F.col("close"), before) - 1,
        "label": F.try_divide(F.lead("close", 2).over(w), F.lead("close", 1).over(w)) - 1,
    })


def daily_bars(df: DataFrame, time: str = TIME, order: tuple[str, ...] = (), volume: str = "last") -> DataFrame:
    """Bars of a day: first open, highest high, lowest low, last of all others; days without any value don't appear.

    First and last skip missing values; ``order`` breaks ties in time. ``volume``: ``last`` as other columns, or ``sum``.
    """
    values = [c for c, t in df.dtypes if c not in (time, ASSET, *order) and t in ("double", "float", "bigint", "int")]
    place = F.struct(time, *order)
    aggs = []
    for c in values:
        at = F.when(F.col(c).isNotNull(), place)
        if c == "high":
            one = F.max(c)
        elif c == "low":
            one = F.min(c)
        elif c == "volume" and volume == "sum":
            one = F.sum(c)
        else:
            one = (F.min_by if c == "open" else F.max_by)(c, at)
        aggs.append(one.alias(c))
    day = F.date_trunc("day", time).alias(TIME)
    some = F.coalesce(*(F.col(c).cast("double") for c in values)).isNotNull()
    return df.filter(some).groupBy(day, ASSET).agg(*aggs)


def bars_from_ticks(ticks: DataFrame, time: str, asset: str, value: str, tie: str, unit: str = "day") -> DataFrame:
    """Open, high, low, close, volume (number) and vwap (mean) of a value column in each unit of time."""
    order = F.struct(time, tie)
    return ticks.groupBy(F.date_trunc(unit, time).alias(TIME), F.col(asset).cast("string").alias(ASSET)).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count(value).cast("double").alias("volume"), F.avg(value).alias("vwap")
    )


def summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, assets, dates, first and last date, share of missing cells, labels, bytes of names."""
    features, labels = split_columns(df)
    cells = features + labels
    gone = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in cells), F.lit(0))
    return df.agg(
        F.count("*").alias("n_rows"), F.lit(len(cells)).alias("n_columns"), F.count_distinct(ASSET).alias("n_symbols"), F.count_distinct(TIME).alias("n_dates"), F.min(TIME).alias("first_date"), F.max(TIME).alias("last_date"),
        F.coalesce(F.try_divide(gone.cast("double"), F.count("*") * F.lit(float(max(1, len(cells))))), F.lit(0.0)).alias("nan_ratio"), F.lit(",".join(features)).alias("features"), F.lit(",".join(labels)).alias("labels"),
    )


def time_step(df: DataFrame, how: str = "mode") -> DataFrame:
    """One row: the step between dates as seconds and as text; the most frequent (least of equals) or the ``first``."""
    gap = dates(df).withColumn("step", F.unix_timestamp(TIME) - F.lag(F.unix_timestamp(TIME)).over(Window.orderBy(TIME))).filter("step is not null")
    if how == "first":
        one = gap.agg(F.min_by("step", TIME).alias("seconds"))
    else:
        one = gap.groupBy("step").agg(F.count("*").alias("n")).agg(F.max_by("step", F.struct("n", -F.col("step"))).alias("seconds"))
    s = F.col("seconds")
    label = F.when(s % 86400 == 0, F.concat((s / 86400).cast("bigint"), F.lit("d"))).when(s % 3600 == 0, F.concat((s / 3600).cast("bigint"), F.lit("h"))).otherwise(F.concat((s / 60).cast("bigint"), F.lit("min")))
    return one.withColumn("step", label)


def missing_ratio(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of missing cells of each column, long: (factor, missing_ratio, coverage)."""
    wide = df.agg(*(F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in columns))
    return wide.unpivot([], list(columns), "factor", "missing_ratio").withColumn("coverage", 1 - F.col("missing_ratio"))


def drop_empty(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns that have a value at all: one pass of counts."""
    counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in columns)).first()
    return [c for c in columns if counts[c]]


def to_long(df: DataFrame, factors: list[str], keep: Iterable[str] = ()) -> DataFrame:
    """(datetime, symbol, keep, factor, value), one row for each factor."""
    return df.select(TIME, ASSET, *keep, *factors).unpivot([TIME, ASSET, *keep], factors, "factor", "value")


def wide_matrix(df: DataFrame, features: list[str], assets: list[str]) -> DataFrame:
    """One row a date, one column for each of the named assets and features (``asset|feature``)."""
    names = [f"{a}|{f}" for a in assets for f in features]
    long = to_long(df.filter(F.col(ASSET).isin(*assets)), features).withColumn("cell", F.concat_ws("|", ASSET, "factor"))
    return long.groupBy(TIME).pivot("cell", names).agg(F.first("value"))
