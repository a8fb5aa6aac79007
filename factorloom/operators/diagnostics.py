"""Diagnostics of scores and portfolios: monthly tables, drawdowns, autocorrelation, look-ahead and overfitting checks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.stats import ASSET, TIME, compound, dealt, pair_corr, places, rank_pct
from factorloom.operators.evaluate import complete, daily_ic, long_frame
from factorloom.operators.panel import dates, to_long
from factorloom.operators.quantiles import exact_quantiles
from factorloom.sources.files import written

#: Factors by factors of a tile of sums.
TILE = 128


def drawdown(daily: DataFrame, value: str, by: tuple[str, ...] = (), additive: bool = False) -> DataFrame:
    """Adds cumulative return, peak and drawdown of a daily series (small: one row a date of each group)."""
    w = Window.partitionBy(*by).orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(w) if additive else compound(F.col(value), w)
    out = daily.withColumn("cumulative", total)
    out = out.withColumn("peak", F.max("cumulative").over(w))
    fall = F.col("cumulative") - F.col("peak") if additive else F.try_divide(F.col("cumulative"), F.col("peak")) - 1
    return out.withColumn("drawdown", fall)


def monthly_ic(daily: DataFrame) -> DataFrame:
    """Mean IC of each month: one row a factor and year, from the first to the last year, one column a month."""
    monthly = daily.groupBy("factor", F.year(TIME).alias("year"), F.month(TIME).alias("month")).agg(F.avg("ic").alias("ic"))
    span = monthly.groupBy("factor").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    spine = span.select("factor", F.explode(F.sequence("a", "b")).alias("year")).select("factor", "year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    wide = spine.join(monthly, ["factor", "year", "month"], "left").groupBy("factor", "year").pivot("month", list(range(1, 13))).agg(F.first("ic"))
    return wide.select("factor", "year", *(F.col(f"`{m}`").alias(f"m{m:02d}") for m in range(1, 13)))


def monthly_risk(daily: DataFrame, value: str, periods: int = 252, min_rows: int = 3) -> DataFrame:
    """For each month with enough rows: annual excess return, largest additive drawdown within it, mean over
    deviation (0 where it hardly varies) and deviation."""
    tagged = daily.withColumns({"year": F.year(TIME), "month": F.month(TIME)})
    run = drawdown(tagged, value, ("year", "month"), additive=True)
    v = F.col(value)
    out = run.groupBy("year", "month").agg((F.avg(v) * periods).alias("annual_return"), F.min("drawdown").alias("max_drawdown"), F.when(F.stddev_samp(v) > 1e-12, F.avg(v) / F.stddev_samp(v)).otherwise(0.0).alias("information_ratio"), F.stddev_samp(v).alias("std"), F.count("*").alias("n"))
    return out.filter(F.col("n") >= min_rows)


def score_autocorrelation(long: DataFrame, lag: int = 1) -> DataFrame:
    """(factor, datetime, autocorrelation): of the rank of the score and the rank of the score ``lag`` rows ago.

    Each is ranked among all of the date that have it; the pairs that have both are correlated. Dates without a value go.
    """
    w = Window.partitionBy("factor", ASSET).orderBy(TIME)
    both = dealt(long.withColumn("old", F.lag("value", lag).over(w)), "factor", TIME)
    both = both.withColumns({"a": rank_pct(F.col("value"), "factor", TIME), "b": rank_pct(F.col("old"), "factor", TIME)})
    return both.groupBy("factor", TIME).agg(pair_corr(F.col("a"), F.col("b")).alias("autocorrelation")).filter("autocorrelation is not null")


def set_turnover(long: DataFrame, lag: int = 1, share: int = 5) -> DataFrame:
    """Share of the top and of the bottom n // ``share`` of a date's n assets that weren't there by the score ``lag`` rows ago.

    All assets of the date count, also those without an earlier score, which come last in both orders; ties by asset.
    """
    w = Window.partitionBy("factor", ASSET).orderBy(TIME)
    both = dealt(long.withColumn("old", F.lag("value", lag).over(w)).select("factor", TIME, ASSET, "value", "old"), "factor", TIME)
    for b, c in (("now", "value"), ("old", "old")):  # one sort gives both orders
        x, place = F.col(c), places(F.col(c), "factor", TIME)
        for k, v in place.items():
            both = both.withColumn(k, v)
        last = F.col("size") + F.count_if(x.isNull()).over(Window.partitionBy("factor", TIME).orderBy(x.asc_nulls_last(), ASSET).rowsBetween(Window.unboundedPreceding, 0))
        both = both.withColumn("last", last).withColumns({f"low{b}": F.when(x.isNull(), F.col("last")).otherwise(F.col("rising")), f"top{b}": F.when(x.isNull(), F.col("last")).otherwise(F.col("falling"))}).drop(*place, "last")
    both = both.withColumn("n", F.floor(F.count("*").over(Window.partitionBy("factor", TIME)) / share))
    kept = lambda a: F.count_if((F.col(f"{a}now") <= F.col("n")) & (F.col(f"{a}old") <= F.col("n")))
    part = lambda a: (1 - F.try_divide(kept(a).cast("double"), F.max("n").cast("double"))).alias(f"{a}_turnover")
    return both.groupBy("factor", TIME).agg(part("top"), part("low")).filter("top_turnover is not null")


def top_scores(long: DataFrame, k: int = 50) -> DataFrame:
    """The k best assets of each date (ties by asset)."""
    rank = F.row_number().over(Window.partitionBy("factor", TIME).orderBy(F.desc("value"), ASSET))
    return long.filter("value is not null").withColumn("place", rank).filter(F.col("place") <= k).select("factor", TIME, ASSET, "value", "place")


def inspect_groups(long: DataFrame, k: int = 5, best: int = 5) -> DataFrame:
    """On the last date: the best assets of each of k groups by falling score; the last group keeps the remainder."""
    last = long.agg(F.max(TIME).alias("last"))
    g = Window.partitionBy("factor")
    day = long.filter("value is not null").join(last, F.col(TIME) == F.col("last"))
    day = day.withColumns({"rn": F.row_number().over(g.orderBy(F.desc("value"), ASSET)), "n": F.count("*").over(g)})
    size = F.floor(F.col("n") / k)
    group = F.when(size > 0, F.least(F.floor((F.col("rn") - 1) / size), F.lit(k - 1))).otherwise(k - 1)
    day = day.withColumn("group_no", (group + 1).cast("int"))
    place = F.row_number().over(Window.partitionBy("factor", "group_no").orderBy("rn"))
    return day.withColumn("place", place).filter(F.col("place") <= best).select("factor", TIME, "group_no", "place", ASSET, "value")


def portfolio_report(daily: DataFrame, ret: str = "ret", bench: str = "bench", cost: str = "cost", periods: int = 252) -> DataFrame:
    """Adds excess returns with and without cost, their sums so far and drawdowns (additive) to a daily table."""
    w = Window.orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)  # one row a date
    out = daily.withColumns({"excess": F.col(ret) - F.col(bench), "excess_net": F.col(ret) - F.col(bench) - F.col(cost)})
    out = out.withColumns({f"cum_{c}": F.sum(c).over(w) for c in (ret, bench, "excess", "excess_net")})
    return out.withColumns({f"drawdown_{c}": F.col(f"cum_{c}") - F.max(f"cum_{c}").over(w) for c in ("excess", "excess_net")})


def portfolio_summary(report: DataFrame, periods: int = 252) -> DataFrame:
    """One row: annual excess return, information ratio, largest drawdown and when it began and ended."""
    e = F.col("excess_net")
    out = report.agg((F.avg(e) * periods).alias("annual_excess"), (F.try_divide(F.avg(e), F.stddev_samp(e)) * F.sqrt(F.lit(float(periods)))).alias("information_ratio"), F.min("drawdown_excess_net").alias("max_drawdown"), F.min_by(TIME, F.struct("drawdown_excess_net", TIME)).alias("drawdown_end"))
    peak = report.crossJoin(out.select(F.col("drawdown_end").alias("_end"))).filter(F.col(TIME) <= F.col("_end")).agg(F.max_by(TIME, F.struct("cum_excess_net", TIME)).alias("drawdown_start"))
    return out.crossJoin(peak)


def factor_quality(df: DataFrame, factors: list[str], size: str | None = None) -> DataFrame:
    """Coverage, mean cross-section deviation, tail ratio and correlation with size of each factor, with warnings.

    The tail ratio is the mean distance from the median over the span of 1 to 99 % / 1.4826. Percentiles are exact,
    and no task holds a factor's values: the middle and the span, one row a factor, go to all tasks. The factors are written once, as they are
    read several times.
    """
    long = to_long(written(df.select(TIME, ASSET, *dict.fromkeys([*factors, *([size] if size else [])])), "factors"), factors, [size] if size else [])
    daily = long.groupBy("factor", TIME).agg(F.stddev_samp("value").alias("s")).groupBy("factor").agg(F.avg("s").alias("mean_std"))
    other = pair_corr(F.col("value"), F.col(size)) if size else F.lit(None).cast("double")
    out = long.groupBy("factor").agg(F.try_divide(F.count("value").cast("double"), F.count("*").cast("double")).alias("coverage"), other.alias("size_corr")).join(daily, "factor", "left")
    out = out.join(exact_quantiles(long, ["factor"], "value", [0.01, 0.5, 0.99]), "factor", "left")
    span = out.select("factor", F.col("q")[1].alias("mid"), (F.col("q")[2] - F.col("q")[0]).alias("span"))  # one row a factor
    off = long.join(F.broadcast(span), "factor").groupBy("factor").agg(F.avg(F.abs(F.col("value") - F.col("mid"))).alias("off"), F.first("span").alias("span"))
    tail = F.when(F.col("span") > 0, F.col("off") / (F.col("span") / 1.4826 + 1e-12))
    out = out.join(off.select("factor", tail.alias("tail_ratio")), "factor", "left")
    notes = F.array_compact(F.array(F.when(F.col("coverage") < 0.3, "low_coverage"), F.when(F.coalesce("mean_std", F.lit(0.0)) < 0.01, "low_dispersion"), F.when(F.col("tail_ratio") > 10, "heavy_tail"), F.when(F.abs("size_corr") > 0.8, "size_exposure")))
    return out.select("factor", "coverage", "mean_std", "tail_ratio", "size_corr", F.array_join(notes, ",").alias("warnings"))


def correlation_pairs(df: DataFrame, factors: list[str], most: int = 100) -> DataFrame:
    """(f1, f2, corr) of all pairs of factors over their complete pairs of cells: one pass, no join.

    Up to ``most`` pairs are aggregates of one row; more of them come from blocked matrices, a few for each task, so that
    neither the plan nor the rows grow with their number.
    """
    pairs = [(i, j) for i in range(len(factors)) for j in range(i + 1, len(factors))]
    if not pairs:
        return df.sparkSession.createDataFrame([], "f1 string, f2 string, corr double")
    if len(pairs) <= most:
        wide = df.agg(F.array(*(F.struct(F.lit(factors[i]).alias("f1"), F.lit(factors[j]).alias("f2"), pair_corr(F.col(factors[i]), F.col(factors[j])).alias("corr")) for i, j in pairs)).alias("p"))
        return wide.select(F.explode("p").alias("p")).select("p.f1", "p.f2", "p.corr")
    return _gram_correlations(df, factors)


def _gram_correlations(df: DataFrame, factors: list[str]) -> DataFrame:
    """The correlations from blocked matrices: each task adds up, over its rows, the products, sums and squares of all pairs with
    both values there (missing ones are 0 beside a matrix of presence), and tiles of them are reduced and turned into rows.

    Columns are centred and scaled by their own mean and deviation first, so that sums of squares stay exact.
    """
    stats = df.agg(*(F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(f"_{i}") for i, c in enumerate(factors))).first()
    mean = np.array([r["m"] or 0.0 for r in stats])
    spread = np.array([r["s"] or 1.0 for r in stats])
    cuts = [(a, min(a + TILE, len(factors))) for a in range(0, len(factors), TILE)]
    tiles = [(i, j) for i in range(len(cuts)) for j in range(i, len(cuts))]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: np.zeros((6, cuts[t[0]][1] - cuts[t[0]][0], cuts[t[1]][1] - cuts[t[1]][0])) for t in tiles}
        for batch in batches:
            x = (np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]) - mean) / spread
            there = ~np.isnan(x)
            x, there = np.where(there, x, 0.0), there.astype(np.float64)
            squares = x * x
            for (i, j), s in sums.items():
                (a, b), (c, d) = cuts[i], cuts[j]
                for k, (left, right) in enumerate(((x, x), (there, there), (x, there), (there, x), (squares, there), (there, squares))):
                    s[k] += left[:, a:b].T @ right[:, c:d]
        for (i, j), s in sums.items():
            yield pa.RecordBatch.from_pylist([{"i": i, "j": j, "sums": s.tobytes()}])

    def rows(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        (a, b), (c, d) = cuts[i], cuts[j]
        products, n, x, y, xx, yy = sum(np.frombuffer(s, np.float64) for s in table["sums"].to_pylist()).reshape(6, b - a, d - c)
        with np.errstate(divide="ignore", invalid="ignore"):
            vx, vy = xx - x * x / n, yy - y * y / n
            flat = (vx <= 1e-14 * xx) | (vy <= 1e-14 * yy) | (n < 2)
            corr = np.where(flat, np.nan, (products - x * y / n) / np.sqrt(vx * vy))
        p, q = np.nonzero(np.arange(a, b)[:, None] < np.arange(c, d)[None, :])
        return pa.table({"f1": pa.array([factors[a + k] for k in p], pa.string()), "f2": pa.array([factors[c + k] for k in q], pa.string()), "corr": pa.array(corr[p, q], from_pandas=True)})

    plain = df.select(*(F.col(f"`{c}`").cast("double").alias(f"_{i}") for i, c in enumerate(factors)))
    return plain.mapInArrow(summed, "i long, j long, sums binary").groupBy("i", "j").applyInArrow(rows, "f1 string, f2 string, corr double")


def correlation_penalty(df: DataFrame, factors: list[str]) -> DataFrame:
    """One row: the mean absolute correlation of different factors (0 with fewer than two)."""
    return correlation_pairs(df, factors).agg(F.coalesce(F.avg(F.abs("corr")), F.lit(0.0)).alias("correlation"))


def look_ahead(
    panel: DataFrame, expressions: dict[str, str], cuts: int = 5, tolerance: float = 1e-8, prepare: Callable[[DataFrame], DataFrame] | None = None, prepared: tuple[int | None, int | None] = (None, None), least: int = 5, relative: float = 1e-5
) -> DataFrame:
    """(factor, max_diff, passed): each factor is recomputed on the panel cut off after each of the last dates before the
    end; values that later rows change give it away.

    The reach of each expression, read off its tree, says which dates a cut can change and which rows these need. Only the
    last of them are read, at least ``least`` dates being compared, and all cuts are evaluated in one job beside each other. Factors whose reach is
    unknown or without end (filled forward, users' functions that don't declare it) are recomputed as a whole, in one more.

    ``prepare`` makes the panel's derived columns, anew for each cut-off, of the rows before and after that ``prepared`` names. A
    difference passes up to ``tolerance`` and a ``relative`` part of the value; a value missing on one side never does. Expressions that
    can't be evaluated don't pass. With fewer than ``cuts`` + 2 dates nothing is compared: all pass, and max_diff is null.
    """
    from factorloom.operators.factors import reach, with_factors

    made = prepared if prepare else (0, 0)
    if not prepare:
        used = {c for e in expressions.values() for c in re.findall(r"\$(\w+)", e)}
        panel = panel.select(TIME, ASSET, *(f"`{c}`" for c in panel.columns if c in used - {TIME, ASSET}))
    prepare = prepare or (lambda d: d)
    columns = prepare(panel.limit(0)).columns
    _, failed = with_factors(prepare(panel.limit(0)), expressions, [TIME, ASSET])
    spans = {n: reach(e, columns, made) for n, e in expressions.items() if n not in failed}
    bounded = [n for n, span in spans.items() if all(None not in s for s in span)]
    spark, verdict = panel.sparkSession, "factor string, max_diff double, passed boolean"
    out = spark.createDataFrame([(n, None, False) for n in expressions if n in failed], verdict)
    floors, tail = _floors(panel, {x for n in bounded for s in spans[n] for x in s}, cuts + least)
    if len(tail) < cuts + 2:
        return out.union(spark.createDataFrame([(n, None, True) for n in spans], verdict))
    places = range(len(tail) - 1 - cuts, len(tail) - 1)
    for names in (bounded, [n for n in spans if n not in bounded]):
        if not names:
            continue
        zones = starts = [None] * cuts
        if names is bounded:
            widest = [tuple(max(spans[n][i][side] if i < len(spans[n]) else 0 for n in names) for side in (0, 1)) for i in range(max(len(spans[n]) for n in names))]
            changed = _back(floors, [tail[i + 1] for i in places], [after for _, after in reversed(widest)])
            zones = [min(z, tail[max(0, i + 1 - least)]) for z, i in zip(changed, places, strict=True)]
            starts = _back(floors, zones, [before for before, _ in widest])
        since = None if None in starts else min(starts)
        rows = written(panel if since is None else panel.filter(F.col(TIME) >= F.lit(since)), "tail")
        slices = [rows] + [rows.filter((F.col(TIME) <= F.lit(tail[i])) & (F.lit(True) if s is None else F.col(TIME) >= F.lit(s))) for i, s in zip(places, starts, strict=True)]
        beside = reduce(DataFrame.unionByName, (prepare(d).withColumn("_cut", F.lit(k)) for k, d in enumerate(slices)))
        beside = beside.withColumns({c: F.struct("_cut", c) for c in (TIME, ASSET)})  # so the cuts share no date and no asset
        values, _ = with_factors(beside, {n: expressions[n] for n in names}, [TIME, ASSET])
        cut, when = F.col(f"{ASSET}._cut"), F.col(f"{TIME}.{TIME}")
        judged = F.lit(True) if None in zones else reduce(lambda a, k: a.when(cut == k + 1, when >= F.lit(zones[k])), range(cuts), F.when(cut == 0, when >= F.lit(min(zones))))  # noqa: B023
        aggs = [F.count_if(F.col("_k") > 0).alias("_n")]
        for j, n in enumerate(names):
            again = F.when(F.col("_k") > 0, F.col(f"`{n}`"))
            aggs += [F.max(F.when(F.col("_k") == 0, F.col(f"`{n}`"))).alias(f"_v{j}"), F.min(again).alias(f"_a{j}"), F.max(again).alias(f"_b{j}"), F.count(again).alias(f"_c{j}")]
        cells = values.filter(judged).select(cut.alias("_k"), when.alias("_t"), F.col(f"{ASSET}.{ASSET}").alias("_s"), *(F.col(f"`{n}`") for n in names)).groupBy("_t", "_s").agg(*aggs).filter("_n > 0")
        found = []
        for j, n in enumerate(names):
            v, there = F.col(f"_v{j}"), F.col(f"_c{j}")
            gaps = [F.abs(F.col(f"_{side}{j}") - v) for side in "ab"]
            lost = F.when(v.isNull(), there > 0).otherwise(there < F.col("_n"))
            wrong = lost | reduce(lambda a, b: a | b, (F.coalesce(g > tolerance + relative * F.abs(F.col(f"_{side}{j}")), F.lit(False)) for g, side in zip(gaps, "ab", strict=True)))
            gap = F.when(lost, float("inf")).otherwise(F.coalesce(F.greatest(*gaps), F.lit(0.0)))
            found.append(F.struct(F.lit(n).alias("factor"), F.coalesce(F.max(gap), F.lit(0.0)).alias("max_diff"), F.coalesce(~F.bool_or(wrong), F.lit(True)).alias("passed")))
        out = out.union(cells.agg(F.array(*found).alias("found")).select(F.inline("found")))
    return out


def _floors(panel: DataFrame, rows: set[int], last: int) -> tuple[DataFrame, list]:
    """One row a date, with the first date that any asset's row of the date reaches by going back so many of its rows (``_f3``: three;
    assets with fewer: to their first); and the last dates in order."""
    w = Window.partitionBy(ASSET).orderBy(TIME)
    keys = panel.select(TIME, ASSET).filter(F.col(TIME).isNotNull())
    far = {f"_f{n}": F.coalesce(F.lag(TIME, n).over(w), F.first(TIME).over(w)) for n in sorted(rows) if n}
    floors = written((keys.withColumns(far) if far else keys).groupBy(TIME).agg(F.count("*").alias("_n"), *(F.min(f).alias(f) for f in far)), "floors")
    return floors, sorted(r[TIME] for r in floors.orderBy(F.desc(TIME)).limit(last + 1).select(TIME).collect())


def _back(floors: DataFrame, since: list, rows: list[int]) -> list:
    """Each of the dates ``since`` moved back by so many rows of the assets that have rows from there on, step by step: one small job a step."""
    for n in rows:
        if n:
            row = floors.agg(*(F.min(F.when(F.col(TIME) >= F.lit(s), F.col(f"_f{n}"))).alias(f"_{k}") for k, s in enumerate(since))).first()
            since = [min(s, r) for s, r in zip(since, row, strict=True)]
    return since


def overfit_check(df: DataFrame, factors: list[str], target: str = "returns_1d", fraction: float = 0.7, decay: float = 0.7, least: float = 0.002, judged: float = 0.01) -> DataFrame:
    """Mean rank IC in and out of sample. Overfit where the IC in sample exceeds ``judged`` and too much of it is lost, or else
    its sign turns; underfit where it is below ``least``; robust where neither. A date with one pair counts as an IC of 0."""
    calendar = dates(df)
    n = calendar.agg(F.greatest(F.lit(1), F.floor(F.count("*") * fraction)).alias("n_train"))
    part = calendar.crossJoin(n).select(TIME, (F.col("date_no") < F.col("n_train")).alias("inside"))
    pairs = dealt(complete(long_frame(df, factors, target)), "factor", TIME)
    pairs = pairs.withColumns({c: rank_pct(F.col(c), "factor", TIME) for c in ("value", "target")})
    ics = pairs.groupBy("factor", TIME).agg(F.when(F.count("*") < 2, 0.0).otherwise(pair_corr(F.col("value"), F.col("target"))).alias("ic")).join(part, TIME)
    out = ics.groupBy("factor").agg(F.avg(F.when(F.col("inside"), F.col("ic"))).alias("ic_in"), F.avg(F.when(~F.col("inside"), F.col("ic"))).alias("ic_out"))
    a, b = F.coalesce("ic_in", F.lit(0.0)), F.coalesce("ic_out", F.lit(0.0))
    lost = F.when(F.abs(a) > 1e-12, (F.abs(a) - F.abs(b)) / F.abs(a)).otherwise(0.0)
    reason = F.when((F.abs(a) > judged) & (lost > decay), "decay").when((F.abs(a) > judged) & (a * b < 0), "sign_flip").when(F.abs(a) < least, "underfit").otherwise("ok")
    out = out.withColumns({"decay": lost, "reason": reason})
    return out.withColumns({"overfit": F.col("reason").isin("decay", "sign_flip"), "underfit": F.abs(a) < least, "robust": F.col("reason") == "ok"})


def diagnostic_tables(df: DataFrame, score: str, label: str, k: int = 5) -> dict[str, DataFrame]:
    """The tables behind a score's charts: group returns, monthly IC, autocorrelation, turnover of the extremes, best assets
    of each date, groups of the last date, and a summary row."""
    from factorloom.operators.evaluate import annualised, group_returns, ic_summary

    long = long_frame(df, [score], label)
    daily, groups = daily_ic(long), group_returns(long, k)
    auto, sets = score_autocorrelation(long), set_turnover(long)
    row = ic_summary(daily).join(annualised(groups, "long_short"), "factor", "left")
    row = row.join(auto.groupBy("factor").agg(F.avg("autocorrelation").alias("autocorrelation")), "factor", "left").join(sets.groupBy("factor").agg(F.avg("top_turnover").alias("top_turnover"), F.avg("low_turnover").alias("low_turnover")), "factor", "left")
    return {"groups": groups, "ic": daily, "monthly_ic": monthly_ic(daily), "autocorrelation": auto, "set_turnover": sets, "top": top_scores(long), "last_date": inspect_groups(long, k), "summary": row}
