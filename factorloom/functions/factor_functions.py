"""The functions of factor expressions, by name.

An ``asset`` function runs along one asset's rows, a ``date`` function across one date's assets, and a ``row`` function
within a row. Each takes Columns or numbers and returns a Column. Windows of p rows count rows, not time; missing values
are skipped, and a window without any value gives null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .stats import last_rows, over_assets, over_time, rank_pct

MOST_ROWS = 10_000


@dataclass(frozen=True)
class FactorFunction:
    kind: str
    build: Callable[..., Column]
    least: int
    most: int
    reach: Callable[..., tuple[int | None, int | None]] | None = None


REGISTRY: dict[str, FactorFunction] = {}


def register(name: str, kind: str, least: int, most: int | None = None, reach: Callable[..., tuple[int | None, int | None]] | None = None) -> Callable:
    """Makes a function known to expressions; users may add their own.

    ``reach``: of a function along assets, the rows before and after a row that its value depends on, by its numeric arguments
    (None: any number). Without it both are unknown.
    """
    if kind not in ("asset", "date", "row"):
        raise ValueError(f"kind {kind!r}")

    def keep(build: Callable[..., Column]) -> Callable[..., Column]:
        REGISTRY[name] = FactorFunction(kind, build, least, most or least, reach)
        return build

    return keep


def _shifted(p: int = 1) -> tuple[int, int]:
    return int(p), 0


def _framed(p: int = 5) -> tuple[int, int]:
    return int(p) - 1, 0


def _rows(p: Column | float) -> int:
    if isinstance(p, Column) or int(p) != p:
        raise ValueError("a number of rows must be a whole number")
    if not 0 <= p <= MOST_ROWS:
        raise ValueError(f"a number of rows must lie between 0 and {MOST_ROWS}; negative ones would look ahead")
    return int(p)


def _some(p: Column | float) -> int:
    if (n := _rows(p)) < 1:
        raise ValueError("a window needs at least one row")
    return n


def _both(x: Column, y: Column | float, pick: Callable[..., Column]) -> Column:
    y = y if isinstance(y, Column) else F.lit(float(y))
    return F.when(x.isNotNull() & y.isNotNull(), pick(x, y))


@register("ABS", "row", 1)
def absolute(x):
    return F.abs(x)


@register("LOG", "row", 1)
def log(x):
    return F.when(x.isNotNull(), F.log(F.greatest(x, F.lit(1e-12))))


@register("SIGN", "row", 1)
def sign(x):
    return F.signum(x)


@register("_MAX2", "row", 2)
def max2(x, y):
    return _both(x, y, F.greatest)


@register("_MIN2", "row", 2)
def min2(x, y):
    return _both(x, y, F.least)


@register("Ref", "asset", 1, 2, _shifted)
@register("DELAY", "asset", 1, 2, _shifted)
def delay(x, p=1):
    return F.lag(x, _rows(p)).over(over_time())


@register("DELTA", "asset", 1, 2, _shifted)
def delta(x, p=1):
    return x - F.lag(x, _rows(p)).over(over_time())


@register("RANK", "date", 1)
def rank(x):
    return rank_pct(x)


@register("MEAN", "date", 1)
def mean(x):
    return F.avg(x).over(over_assets())


@register("STD", "date", 1)
def std(x):
    return F.stddev_samp(x).over(over_assets())


@register("MEDIAN", "date", 1)
def median(x):
    return F.median(x).over(over_assets())


@register("MAX", "date", 1)
def maximum(x):
    return F.max(x).over(over_assets())


@register("MIN", "date", 1)
def minimum(x):
    return F.min(x).over(over_assets())


@register("ZSCORE", "date", 1)
def zscore(x):
    return F.try_divide(x - mean(x), std(x))


@register("SCALE", "date", 1, 2)
def scale(x, a=1.0):
    return F.try_divide(x * float(a), F.sum(F.abs(x)).over(over_assets()))


@register("TS_MEAN", "asset", 1, 2, _framed)
def ts_mean(x, p=5):
    return F.avg(x).over(last_rows(_some(p)))


@register("TS_SUM", "asset", 1, 2, _framed)
def ts_sum(x, p=5):
    return F.sum(x).over(last_rows(_some(p)))


@register("TS_MIN", "asset", 1, 2, _framed)
def ts_min(x, p=5):
    return F.min(x).over(last_rows(_some(p)))


@register("TS_MAX", "asset", 1, 2, _framed)
def ts_max(x, p=5):
    return F.max(x).over(last_rows(_some(p)))


@register("TS_STD", "asset", 1, 2, _framed)
def ts_std(x, p=5):
    return F.stddev_samp(x).over(last_rows(_some(p)))


@register("TS_MEDIAN", "asset", 1, 2, _framed)
def ts_median(x, p=5):
    return F.percentile(x, 0.5).over(last_rows(_some(p)))


@register("TS_RANK", "asset", 1, 2, _framed)
def ts_rank(x, p=5):
    window = F.collect_list(x).over(last_rows(_some(p)))
    less, equal = F.size(F.filter(window, lambda v: v < x)), F.size(F.filter(window, lambda v: v == x))
    return F.when(x.isNotNull(), F.try_divide(less + (equal + 1) / 2, F.size(window)))


@register("TS_ZSCORE", "asset", 1, 2, _framed)
def ts_zscore(x, p=5):
    return F.try_divide(x - ts_mean(x, p), ts_std(x, p))


@register("_FILL", "asset", 1, reach=lambda: (None, 0))
def fill_forward(x):
    return F.last(x, ignorenulls=True).over(over_time().rowsBetween(Window.unboundedPreceding, 0))


@register("WMA", "asset", 1, 2, _framed)
def wma(x, p=5):
    """Weights 1 to p over their sum, the newest row heaviest; rows before the first count 0, a missing value gives null."""
    p = _some(p)
    rows, total = last_rows(p), p * (p + 1) / 2
    values = F.collect_list(x).over(rows)  # one frame, whatever p is
    weighted = F.transform(values, lambda v, i: v * ((i + (p + 1) - F.size(values)) / total))
    whole = F.count(x).over(rows) == F.count(F.lit(1)).over(rows)
    return F.when(whole, F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v))


@register("TS_CORR", "asset", 2, 3, _framed)
def ts_corr(x, y, p=5):
    """Pearson correlation of the complete pairs of the last p rows, from two pairs on."""
    both, window = x.isNotNull() & y.isNotNull(), last_rows(_some(p))
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_samp(a).over(window) * F.stddev_samp(b).over(window)
    return F.when(F.count(a).over(window) >= 2, F.try_divide(F.covar_samp(a, b).over(window), spread))


#: The functions as they are here, whatever users register later.
BUILT_IN = dict(REGISTRY)
