"""Column helpers. Missing is null only; NaN and infinity become null, and division by zero gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

TIME, ASSET = "datetime", "symbol"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Column | str) -> Column:
    """As double, or null where that can't be read or isn't finite."""
    d = F.expr(f"try_cast(`{x}` AS DOUBLE)") if isinstance(x, str) else x.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


#: All white space that Python's strip takes off.
BLANK = r"[\s\x1c-\x1f]"


def strip(x: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(x, rf"(?U)^{BLANK}+|{BLANK}+$", "")


def over_assets() -> WindowSpec:
    """All assets of a date."""
    return Window.partitionBy(TIME)


def over_time() -> WindowSpec:
    """One asset through time."""
    return Window.partitionBy(ASSET).orderBy(TIME)


def last_rows(p: int) -> WindowSpec:
    return over_time().rowsBetween(-(int(p) - 1), 0)


def rank_pct(x: Column, *by: str) -> Column:
    """Percentile rank in the group of ``by`` (a date, if not given): ties get their mean rank, null stays null.

    The rank and the number of its peers come from one ordered window, so a group is sorted once.
    """
    group = Window.partitionBy(*(by or (TIME,)))
    order = group.orderBy(x.asc_nulls_last())
    peers = F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), F.try_divide(F.rank().over(order) + (peers - 1) / 2, F.count(x).over(group)))


#: Tasks over which groups that are sorted are dealt: by their size in bytes alone so few would be made that each sorts a hundred groups.
SORTING = 512


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` with the rows of each group of ``by`` together, a few groups in each task."""
    return df.repartition(SORTING, *by)


def places(x: Column, *by: str, counted: Column | None = None) -> dict[str, Column]:
    """Places of the rows with an x (of those that are ``counted``) in their group, from one order by x and asset, as columns to be added one after
    the other: ``rising`` and ``falling`` (ties by asset in both), ``upto`` (rows with no larger x), ``peers`` and ``size`` of the group.

    The order by asset comes first and serves the order by x alone as well, so that a group is sorted once.
    """
    group = Window.partitionBy(*by)
    one = (x.isNotNull() if counted is None else counted).cast("int")
    order = group.orderBy(x.asc_nulls_last())
    return {
        "rising": F.sum(one).over(group.orderBy(x.asc_nulls_last(), ASSET).rowsBetween(Window.unboundedPreceding, 0)), "upto": F.sum(one).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        "peers": F.sum(one).over(order.rangeBetween(Window.currentRow, Window.currentRow)), "size": F.sum(one).over(group), "falling": F.col("size") - F.col("upto") * 2 + F.col("peers") + F.col("rising"),
    }


def pair_corr(x: Column, y: Column) -> Column:
    """Pearson correlation of the complete pairs of a group, as an aggregate; null if either side doesn't vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def row_mean(*columns: Column) -> Column:
    """Mean of several columns of a row; missing ones are skipped."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    return F.try_divide(total, sum((c.isNotNull().cast("int") for c in columns), F.lit(0)).cast("double"))


def bounded(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Clamped to a range; what is null or not finite counts as the lower end."""
    x = x.cast("double")
    missing = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))  # greatest and least skip nulls, so they can't tell
    return F.when(missing, F.lit(low)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def abs_score(x: Column, scale: float) -> Column:
    """|x| in units of ``scale``, at most 1; null counts as 0."""
    return bounded(F.abs(x) / scale) if scale > 0 else F.lit(0.0)


def compound(r: Column, window: WindowSpec) -> Column:
    """Product of 1 + r over a window; null counts as no change.

    Logarithms of magnitudes are summed; signs are counted apart and a loss of all gives 0 from there on.
    """
    g = 1 + F.coalesce(r, F.lit(0.0))
    size = F.exp(F.sum(F.when(g != 0, F.log(F.abs(g))).otherwise(0.0)).over(window))
    odd = F.sum((g < 0).cast("int")).over(window) % 2 == 1
    return F.when(F.max((g == 0).cast("int")).over(window) == 1, 0.0).otherwise(F.when(odd, -size).otherwise(size))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded (minus zero as zero), to compare results of different engines."""
    return df.select(*(F.round(F.col(f"`{c}`") + 0.0, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))
