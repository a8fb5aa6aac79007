"""Judging factors: information coefficients, layers, turnover, screens and scores; all factors in one job (long form).

A long frame has datetime, symbol, factor, value and target (see ``long_frame``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.stats import ASSET, TIME, abs_score, bounded, compound, dealt, pair_corr, rank_pct, row_mean
from factorloom.operators.panel import dates, to_long

ICIR_FLOOR = 1e-12


def long_frame(df: DataFrame, factors: list[str], target: str) -> DataFrame:
    return to_long(df, factors, [target]).withColumnRenamed(target, "target")


def complete(long: DataFrame) -> DataFrame:
    """Rows with both a value and a target."""
    return long.filter(F.col("value").isNotNull() & F.col("target").isNotNull())


def daily_ic(long: DataFrame, method: str = "pearson", min_obs: int = 2) -> DataFrame:
    """(factor, datetime, ic): correlation of values and targets; dates with too few pairs or without variation go.

    ``spearman`` correlates mean-tie ranks of the complete pairs.
    """
    pairs = complete(long)
    if method == "spearman":
        pairs = dealt(pairs, "factor", TIME).withColumns({"value": rank_pct(F.col("value"), "factor", TIME), "target": rank_pct(F.col("target"), "factor", TIME)})
    out = pairs.groupBy("factor", TIME).agg(pair_corr(F.col("value"), F.col("target")).alias("ic"), F.count("*").alias("n"))
    return out.filter((F.col("n") >= min_obs) & F.col("ic").isNotNull()).select("factor", TIME, "ic")


def both_ics(long: DataFrame, min_obs: int = 2) -> DataFrame:
    """(factor, datetime, ic, rank_ic) in one pass over the pairs."""
    pairs = dealt(complete(long), "factor", TIME).withColumns({"rv": rank_pct(F.col("value"), "factor", TIME), "rt": rank_pct(F.col("target"), "factor", TIME)})
    out = pairs.groupBy("factor", TIME).agg(pair_corr(F.col("value"), F.col("target")).alias("ic"), pair_corr(F.col("rv"), F.col("rt")).alias("rank_ic"), F.count("*").alias("n"))
    return out.filter(F.col("n") >= min_obs).select("factor", TIME, "ic", "rank_ic")


def _ratio(mean: Column, std: Column, rule: str) -> Column:
    """Mean over deviation: ``floor`` with a least deviation, ``zero`` or ``null`` where it hardly varies."""
    if rule == "floor":
        return F.try_divide(mean, F.greatest(F.abs(F.coalesce(std, F.lit(0.0))), F.lit(ICIR_FLOOR)))
    none = F.lit(0.0) if rule == "zero" else F.lit(None).cast("double")
    return F.when(F.abs(std) > ICIR_FLOOR, mean / std).otherwise(none)


def ic_summary(daily: DataFrame, rule: str = "floor", prefix: str = "ic", by: tuple[str, ...] = ("factor",)) -> DataFrame:
    """Mean, sample deviation, information ratio, positive share and number of dates of a daily series.

    A correlation within rounding error of 0 isn't positive.
    """
    ic = F.col("ic")
    out = daily.groupBy(*by).agg(F.avg(ic).alias("m"), F.stddev_samp(ic).alias("s"), F.avg((ic > ICIR_FLOOR).cast("double")).alias("p"), F.count(ic).alias("n"))
    return out.select(*by, F.col("m").alias(f"{prefix}_mean"), F.col("s").alias(f"{prefix}_std"), _ratio(F.col("m"), F.col("s"), rule).alias(f"{prefix}_ir"), F.col("p").alias(f"{prefix}_positive"), F.col("n").alias(f"{prefix}_dates"))


def coverage(long: DataFrame) -> DataFrame:
    """Share of rows with both value and target."""
    both = F.col("value").isNotNull() & F.col("target").isNotNull()
    return long.groupBy("factor").agg(F.try_divide(F.count_if(both).cast("double"), F.count("*").cast("double")).alias("coverage"))


def turnover(long: DataFrame, calendar: DataFrame) -> DataFrame:
    """Mean over dates of the mean absolute change of percentile rank between adjacent dates of the calendar.

    An asset that is missing on the date before has no change. The calendar has one row a date and is joined as such.
    """
    ranked = dealt(long, "factor", TIME).withColumn("r", rank_pct(F.col("value"), "factor", TIME)).join(F.broadcast(calendar), TIME)
    w = Window.partitionBy("factor", ASSET).orderBy("date_no")
    change = F.when(F.lag("date_no").over(w) == F.col("date_no") - 1, F.abs(F.col("r") - F.lag("r").over(w)))
    daily = ranked.withColumn("d", change).groupBy("factor", TIME).agg(F.avg("d").alias("d"))
    return daily.groupBy("factor").agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("turnover"))


def layers(long: DataFrame, n: int = 5, min_obs: int = 2) -> DataFrame:
    """Adds ``bucket`` (1 to n, by value; ties in the order of assets); dates with fewer pairs go."""
    group = Window.partitionBy("factor", TIME)
    out = complete(long).withColumns({"rn": F.row_number().over(group.orderBy("value", ASSET)), "cnt": F.count("*").over(group)})
    bucket = F.least(F.lit(n), F.greatest(F.lit(1), F.ceil(F.col("rn") / F.col("cnt") * n))).cast("int")
    return out.filter(F.col("cnt") >= min_obs).withColumn("bucket", bucket).drop("rn", "cnt")


def layer_returns(long: DataFrame, n: int = 5, min_obs: int = 2) -> DataFrame:
    """Mean target of each bucket, all dates pooled."""
    return layers(long, n, min_obs).groupBy("factor", "bucket").agg(F.avg("target").alias("mean_return"), F.count("*").alias("n"))


def layer_table(long: DataFrame, n: int = 5, min_obs: int = 2) -> DataFrame:
    """One row for each factor and date: mean target of each bucket, and top less bottom."""
    wide = layers(long, n, min_obs).groupBy("factor", TIME).pivot("bucket", list(range(1, n + 1))).agg(F.avg("target"))
    wide = wide.select("factor", TIME, *(F.col(f"`{k}`").alias(f"layer_{k}") for k in range(1, n + 1)))
    return wide.withColumn("long_short", F.col(f"layer_{n}") - F.col("layer_1"))


def layer_stats(long: DataFrame, n: int = 5, min_obs: int = 2) -> DataFrame:
    """Long-short mean, information ratio and positive share, and the layers' monotonicity (mean daily correlation of
    bucket number and return), for each factor."""
    table = layer_table(long, n, min_obs)
    pairs = table.unpivot(["factor", TIME], [f"layer_{k}" for k in range(1, n + 1)], "layer", "ret").filter("ret is not null")
    mono = pairs.groupBy("factor", TIME).agg(pair_corr(F.substring("layer", 7, 9).cast("double"), F.col("ret")).alias("c")).groupBy("factor").agg(F.avg("c").alias("layer_monotonicity"))
    ls = F.col("long_short")
    stats = table.groupBy("factor").agg(F.avg(ls).alias("long_short_mean"), F.stddev_samp(ls).alias("s"), F.avg((ls > 0).cast("double")).alias("long_short_positive"))
    stats = stats.withColumn("long_short_ir", _ratio(F.col("long_short_mean"), F.col("s"), "zero")).drop("s")
    return stats.join(mono, "factor", "left")


def group_returns(long: DataFrame, k: int = 5) -> DataFrame:
    """Mean target of blocks of n // k assets by falling value (the remainder is dropped), and two differences.

    ``long_short``: first less last group; ``long_average``: first group less all assets of the date.
    """
    group = Window.partitionBy("factor", TIME)
    scored = long.filter("value is not null").withColumns({"rn": F.row_number().over(group.orderBy(F.desc("value"), ASSET)), "cnt": F.count("*").over(group)})
    size = F.floor(F.col("cnt") / k)
    scored = scored.withColumn("g", F.when(size > 0, F.floor((F.col("rn") - 1) / size)))
    aggs = [F.avg(F.when(F.col("g") == i, F.col("target"))).alias(f"group_{i + 1}") for i in range(k)]
    all_mean = long.groupBy("factor", TIME).agg(F.avg("target").alias("all_mean"))
    out = scored.groupBy("factor", TIME).agg(*aggs).join(all_mean, ["factor", TIME])
    out = out.withColumns({"long_short": F.col("group_1") - F.col(f"group_{k}"), "long_average": F.col("group_1") - F.col("all_mean")})
    return out.filter(F.coalesce(*(F.col(f"group_{i + 1}") for i in range(k))).isNotNull()).drop("all_mean")


def quantile_long_short(long: DataFrame, q: float = 0.2, by_rank: bool = True, half: bool = False) -> DataFrame:
    """Daily long-short return: mean target above rank 1 - q less that below q (``by_rank``), or of the top and bottom
    max(1, int(n q)) rows; ``half`` halves the difference."""
    group, pairs = Window.partitionBy("factor", TIME), complete(long)
    if by_rank:
        pairs = pairs.withColumn("r", rank_pct(F.col("value"), "factor", TIME))
        top, low = F.col("r") >= 1 - q, F.col("r") <= q
    else:
        pairs = pairs.withColumns({"hi": F.row_number().over(group.orderBy(F.desc("value"), ASSET)), "lo": F.row_number().over(group.orderBy("value", ASSET)), "n": F.greatest(F.lit(1), F.floor(F.count("*").over(group) * q))})
        top, low = F.col("hi") <= F.col("n"), F.col("lo") <= F.col("n")
    long_mean, short_mean = F.avg(F.when(top, F.col("target"))), F.avg(F.when(low, F.col("target")))
    out = pairs.groupBy("factor", TIME).agg(long_mean.alias("long_return"), short_mean.alias("short_return"), F.avg("target").alias("average_return"))
    gap = F.col("long_return") - F.col("short_return")
    return out.withColumns({"long_short": gap / 2 if half else gap, "long_average": F.col("long_return") - F.col("average_return")})


def annualised(daily: DataFrame, value: str, by: tuple[str, ...] = ("factor",), periods: int = 252) -> DataFrame:
    """Mean x periods, and mean over deviation x sqrt(periods) (null where the deviation is 0)."""
    return daily.groupBy(*by).agg(*_annual(F.col(value), "annual_return", "annual_sharpe", periods))


def _annual(v: Column, mean: str, ratio: str, periods: int = 252) -> list[Column]:
    return [(F.avg(v) * periods).alias(mean), (F.try_divide(F.avg(v), F.stddev_samp(v)) * F.sqrt(F.lit(float(periods)))).alias(ratio)]


def daily_metrics(long: DataFrame, calendar: DataFrame | None = None, n_layers: int = 0, min_obs: int = 2, q: float | None = None, by_rank: bool = True) -> DataFrame:
    """One row for each factor and date: rows, pairs, ic, rank_ic; with a calendar date_no and turnover; the mean target and the
    rows of each layer; and with ``q`` the mean target of the top, the bottom (see ``quantile_long_short``) and all.

    All ranks share one partitioning by factor and date, and the change of rank takes one by factor and asset: whatever is
    asked of a factor afterwards comes from this table of days, and the panel is read once. The calendar, one row a date, goes to
    all tasks, so that rows are dealt once, by factor and date.
    """
    both = F.col("value").isNotNull() & F.col("target").isNotNull()
    out = dealt(long if calendar is None else long.join(F.broadcast(calendar), TIME), "factor", TIME)
    out = out.withColumns({"v": F.when(both, F.col("value")), "t": F.when(both, F.col("target"))})
    order = Window.partitionBy("factor", TIME).orderBy(F.col("value").asc_nulls_last())  # of all rows, for the ranks of pairs too: one sort
    upto = lambda c, w=order.rangeBetween(Window.unboundedPreceding, Window.currentRow): F.count(c).over(w)
    peers = lambda c: F.count(c).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    size = lambda c: F.count(c).over(Window.partitionBy("factor", TIME))
    if n_layers or (q and not by_rank):
        out = out.withColumn("rising", upto("v", order.orderBy(F.col("value").asc_nulls_last(), ASSET).rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumns({"uv": upto("v"), "pv": peers("v"), **({"r": F.when(F.col("value").isNotNull(), F.try_divide(upto("value") - (peers("value") - 1) / 2, size("value")))} if calendar is not None else {}), "size": size("v")})
    new = {"rv": F.when(F.col("v").isNotNull(), F.try_divide(F.col("uv") - (F.col("pv") - 1) / 2, F.col("size")))}
    if n_layers:
        new["bucket"] = F.when(F.col("v").isNotNull(), F.least(F.lit(n_layers), F.greatest(F.lit(1), F.ceil(F.col("rising") / F.col("size") * n_layers))))
    if q and not by_rank:
        most = F.greatest(F.lit(1), F.floor(F.col("size") * q))
        falling = F.col("size") - F.col("uv") * 2 + F.col("pv") + F.col("rising")  # ties by asset, as in rising
        new |= {"top": F.col("v").isNotNull() & (falling <= most), "low": F.col("v").isNotNull() & (F.col("rising") <= most)}
    out = out.withColumns(new).drop("value", "target", "rising", "uv", "pv", "size")
    if q and by_rank:
        out = out.withColumns({"top": F.col("rv") >= 1 - q, "low": F.col("rv") <= q})
    out = out.withColumn("rt", rank_pct(F.col("t"), "factor", TIME))
    keys = ["factor", TIME]
    if calendar is not None:
        w = Window.partitionBy("factor", ASSET).orderBy("date_no")
        out = out.withColumn("d", F.when(F.lag("date_no").over(w) == F.col("date_no") - 1, F.abs(F.col("r") - F.lag("r").over(w))))
        keys.append("date_no")
    return _by_day(out, keys, n_layers, min_obs, bool(q))


def _by_day(ranked: DataFrame, keys: list[str], n_layers: int, min_obs: int, tails: bool = False) -> DataFrame:
    """The table of days of rows with v, t and their ranks rv and rt; bucket, d (change of rank), top and low where they are asked for."""
    enough = F.count("v") >= min_obs
    aggs = [F.count("*").alias("rows"), F.count("v").alias("pairs")]
    if "date_no" in keys:
        aggs.append(F.avg("d").alias("turnover"))
    aggs += [F.when(enough, pair_corr(F.col(a), F.col(b))).alias(name) for a, b, name in (("v", "t", "ic"), ("rv", "rt", "rank_ic"))]
    aggs += [F.when(enough, F.avg(F.when(F.col("bucket") == k, F.col("t")))).alias(f"layer_{k}") for k in range(1, n_layers + 1)]
    aggs += [F.when(enough, F.count_if(F.col("bucket") == k)).otherwise(0).alias(f"layer_{k}_rows") for k in range(1, n_layers + 1)]
    if tails:
        aggs += [F.avg(F.when(F.col("top"), F.col("t"))).alias("long_return"), F.avg(F.when(F.col("low"), F.col("t"))).alias("short_return"), F.avg("t").alias("average_return")]
    return ranked.groupBy(*keys).agg(*aggs)


def daily_metrics_of(df: DataFrame, values: dict[str, Column], target: str, calendar: DataFrame, n_layers: int = 5, min_obs: int = 2) -> DataFrame:
    """``daily_metrics`` of values that each row of a panel has at once (``values``: column by name), without a row for each of them.

    ``df`` has the calendar's ``date_no`` and its dates' rows together (see ``dealt``). Each value is sorted once by date, the target once for
    all of them, and rows go to their assets once; they get long only where they are summed up. What is found of the values stays in one
    array, so that rows have few columns, however many values there are: code for very many columns is so long that the JVM interprets it.
    """
    group = Window.partitionBy(TIME)
    upto = lambda c, order: F.count(c).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    peers = lambda c, order: F.count(c).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    size = lambda c, order: F.count(c).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    x, t, width = F.col("_x"), F.col("_t"), 5
    out = df.select(*(c for c in df.columns if c != target), F.col(target).alias("_t"), F.array().cast("array<double>").alias("_found"))
    for value in values.values():
        pair = F.when(t.isNotNull(), x)
        order = group.orderBy(x.asc_nulls_last())
        out = out.withColumn("_x", value).withColumn("_rising", F.count(pair).over(group.orderBy(x.asc_nulls_last(), ASSET).rowsBetween(Window.unboundedPreceding, 0)))
        out = out.withColumns({"_uv": upto(pair, order), "_pv": peers(pair, order), "_u": upto(x, order), "_rank": F.rank().over(order), "_n": size(pair, order), "_all": size(x, order)})
        bucket = F.least(F.lit(n_layers), F.greatest(F.lit(1), F.ceil(F.col("_rising") / F.col("_n") * n_layers)))
        of_pair = [F.when(pair.isNotNull(), c).cast("double") for c in (x, F.try_divide(F.col("_uv") - (F.col("_pv") - 1) / 2, F.col("_n")), bucket)]
        found = F.array(*of_pair, F.when(x.isNotNull(), F.try_divide((F.col("_u") + F.col("_rank")) / 2, F.col("_all"))), F.col("_n").cast("double"))
        out = out.withColumn("_found", F.concat("_found", found)).drop("_x", "_rising", "_uv", "_pv", "_u", "_rank", "_n", "_all")
    at = lambda i, j, c="_found": F.get(c, (i if isinstance(i, Column) else F.lit(i)) * width + j)
    order, every = group.orderBy(t.asc_nulls_last()), range(len(values))
    paired = [F.when(at(i, 0).isNotNull(), t) for i in every]
    out = out.select(TIME, ASSET, "date_no", "_t", "_found").withColumns({f"_{k}{i}": f(paired[i], order) for i in every for k, f in (("u", upto), ("p", peers))})
    out = out.select(TIME, ASSET, "date_no", "_t", "_found", F.array(*(F.when(paired[i].isNotNull(), F.try_divide(F.col(f"_u{i}") - (F.col(f"_p{i}") - 1) / 2, at(i, 4))) for i in every)).alias("_rt"))
    w = Window.partitionBy(ASSET).orderBy("date_no")
    out = dealt(out, ASSET).withColumns({"_before": F.lag("_found").over(w), "_last": F.lag("date_no").over(w)})
    out = out.select("*", F.explode(F.array(*(F.lit(i) for i in every))).alias("_i"))
    i = F.col("_i")
    change = F.when(F.col("_last") == F.col("date_no") - 1, F.abs(at(i, 3) - at(i, 3, "_before")))
    long = out.select(F.get(F.array(*(F.lit(k) for k in values)), i).alias("factor"), TIME, "date_no", at(i, 0).alias("v"), F.when(at(i, 0).isNotNull(), t).alias("t"), at(i, 1).alias("rv"), F.get("_rt", i).alias("rt"), at(i, 2).alias("bucket"), change.alias("d"))
    return _by_day(long, ["factor", TIME, "date_no"], n_layers, min_obs)


def with_monotonicity(days: DataFrame, n_layers: int) -> DataFrame:
    """Adds ``mono``, a day's correlation of its layers' numbers with their returns (null with fewer than two layers)."""
    some = F.filter(F.array(*(F.struct(F.lit(float(k)).alias("x"), F.col(f"layer_{k}").alias("y")) for k in range(1, n_layers + 1))), lambda p: p["y"].isNotNull())
    mean = lambda f: F.aggregate(some, F.lit(0.0), lambda a, p: a + p[f]) / F.size(some)
    days = days.withColumns({"mx": F.when(F.size(some) > 1, mean("x")), "my": F.when(F.size(some) > 1, mean("y"))})
    moment = lambda a, b: F.aggregate(some, F.lit(0.0), lambda t, p: t + (p[a[0]] - F.col(a[1])) * (p[b[0]] - F.col(b[1])))
    x, y = ("x", "mx"), ("y", "my")
    return days.withColumn("mono", F.try_divide(moment(x, y), F.sqrt(moment(x, x) * moment(y, y)))).drop("mx", "my")


def daily_stats(c: Column, name: str) -> list[Column]:
    """Mean, ratio to its deviation, positive share and number of a daily value, as aggregates."""
    ratio = F.try_divide(F.avg(c), F.greatest(F.coalesce(F.stddev_samp(c), F.lit(0.0)), F.lit(ICIR_FLOOR)))
    return [F.avg(c).alias(f"{name}_mean"), F.stddev_samp(c).alias(f"{name}_std"), ratio.alias(f"{name}_ir"), F.avg((c > ICIR_FLOOR).cast("double")).alias(f"{name}_positive"), F.count(c).alias(f"{name}_dates")]


def screen(df: DataFrame, factors: list[str], target: str = "returns_1d", fraction: float = 0.7, window: tuple[str, str] | None = None, min_ic: float = 0.01, min_icir: float = 0.1, min_coverage: float = 0.3, min_dates: int = 2, method: str = "spearman", min_obs: int = 2) -> DataFrame:
    """One row a factor: IC, rank IC, their ratios, coverage and turnover on the train dates, passed and reason.

    With ``spearman`` both kinds of IC are rank ICs. Dates with fewer pairs than ``min_obs`` have none. Turnover counts all dates.
    """
    calendar = dates(df)
    days = daily_metrics(long_frame(df, factors, target), calendar, min_obs=min_obs)
    if window:
        days = days.withColumn("train", F.col(TIME).between(F.lit(window[0]).cast("timestamp"), F.lit(window[1]).cast("timestamp")))
    else:
        n = calendar.agg(F.greatest(F.lit(1), F.floor(F.count("*") * fraction)).alias("n_train"))
        days = days.crossJoin(n).withColumn("train", F.col("date_no") < F.col("n_train"))
    on = lambda c: F.when(F.col("train"), F.col(c))
    share = F.try_divide(F.sum(on("pairs")).cast("double"), F.sum(on("rows")).cast("double"))
    out = days.groupBy("factor").agg(*daily_stats(on("rank_ic" if method == "spearman" else "ic"), "ic"), *daily_stats(on("rank_ic"), "rank_ic"), share.alias("coverage"), F.coalesce(F.avg("turnover"), F.lit(0.0)).alias("turnover"))
    few = F.col("ic_dates") < min_dates
    good = (F.abs("ic_mean") >= min_ic) & (F.abs("ic_ir") >= min_icir) & (F.col("coverage") >= min_coverage)
    passed = F.when(few, False).otherwise(F.coalesce(good, F.lit(False)))
    reason = F.when(few, "too_few_valid_dates").when(passed, "passed").otherwise("below_threshold")
    return out.select("factor", "ic_mean", "rank_ic_mean", "ic_ir", "rank_ic_ir", "coverage", "turnover", "ic_positive", F.col("ic_dates").alias("n_valid_dates"), passed.alias("passed"), reason.alias("reason"))


def threshold_gate(metrics: DataFrame, min_ic: float = 0.003, min_icir: float = 0.02, max_turnover: float = 1.0, min_coverage: float = 0.3) -> DataFrame:
    """Adds passed, gate (the first that fails) and reason."""
    gates = [("metrics", F.col("ic_mean").isNull()), ("ic", F.abs("ic_mean") < min_ic), ("icir", F.abs("ic_ir") < min_icir), ("turnover", F.col("turnover") > max_turnover), ("coverage", F.col("coverage") < min_coverage)]
    gate = F.lit(None).cast("string")
    for name, bad in reversed(gates):
        gate = F.when(bad, name).otherwise(gate)
    return metrics.withColumn("gate", gate).withColumns({"passed": F.col("gate").isNull(), "reason": F.coalesce(F.concat(F.lit("failed_"), F.col("gate")), F.lit("passed"))})


def candidate_gate(candidates: DataFrame, min_fitness: float = 0.0, min_coverage: float = 0.5, min_rank_ic: float = 0.0) -> DataFrame:
    """Adds passed: fitness, coverage and the size of the rank IC reach their thresholds; a missing metric counts as 0."""
    there = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in candidates.columns else F.lit(0.0)
    return candidates.withColumn("passed", (there("fitness") >= min_fitness) & (there("coverage") >= min_coverage) & (F.abs(there("rank_ic_mean")) >= min_rank_ic))


def batch_screen(daily: DataFrame, min_ic: float = 0.02, min_icir: float = 0.5, min_dates: int = 5) -> DataFrame:
    """(factor, ic_mean, ic_ir, n, passed) of a daily IC series: enough dates, and mean and ratio reach their thresholds in size."""
    ic = F.col("ic")
    out = daily.filter(ic.isNotNull()).groupBy("factor").agg(F.avg(ic).alias("ic_mean"), _ratio(F.avg(ic), F.stddev_samp(ic), "floor").alias("ic_ir"), F.count(ic).alias("n"))
    return out.withColumn("passed", (F.col("n") >= min_dates) & (F.abs("ic_mean") >= min_ic) & (F.abs("ic_ir") >= min_icir))


def factor_score(df: DataFrame, passed: list[str], every: list[str], name: str = "score") -> DataFrame:
    """Mean of the passed factors of a row (of all, where none passed)."""
    return df.withColumn(name, row_mean(*(F.col(c) for c in passed or every)))


def signal_analysis(df: DataFrame, score: str, label: str, q: float = 0.2) -> DataFrame:
    """One row: IC and rank IC with their statistics, long-short and long-average return and Sharpe, coverage; all from one
    table of days. The positive share is that of all days with pairs, also of those without an IC."""
    days = daily_metrics(long_frame(df, [score], label), None, 0, 3, q, by_rank=False)
    days = days.withColumns({"ls": (F.col("long_return") - F.col("short_return")) / 2, "la": F.col("long_return") - F.col("average_return")})
    aggs = [F.try_divide(F.sum("pairs").cast("double"), F.sum("rows").cast("double")).alias("coverage")]
    for c in ("ic", "rank_ic"):
        v = F.col(c)
        aggs += [F.avg(v).alias(f"{c}_mean"), F.stddev_samp(v).alias(f"{c}_std"), _ratio(F.avg(v), F.stddev_samp(v), "null").alias(f"{c}_ir"), F.try_divide(F.count_if(v > ICIR_FLOOR).cast("double"), F.count_if(F.col("pairs") > 0).cast("double")).alias(f"{c}_positive"), F.count(v).alias(f"{c}_dates")]
    for c, name in (("ls", "long_short"), ("la", "long_average")):
        aggs += _annual(F.col(c), f"{name}_annual_return", f"{name}_sharpe")
    return days.groupBy("factor").agg(*aggs)


def train_eval_metrics(df: DataFrame, factors: list[str], target: str = "returns_1d", fraction: float = 0.7, n_layers: int = 5) -> DataFrame:
    """``held_out_metrics`` of columns."""
    return held_out_metrics(long_frame(df, factors, target), dates(df), fraction, n_layers)


def held_out_metrics(long: DataFrame, calendar: DataFrame, fraction: float = 0.7, n_layers: int = 5) -> DataFrame:
    """Each factor's metrics on the dates after the train part, and its overfit penalty; all from one table of days."""
    return held_out(daily_metrics(long, calendar, n_layers), calendar, fraction, n_layers)


def held_out(days: DataFrame, calendar: DataFrame, fraction: float = 0.7, n_layers: int = 5) -> DataFrame:
    """The metrics of ``held_out_metrics`` from the table of days.

    Where no date is left after the train part, or no pair on those, all dates count. Means, ratios and shares of which there are no
    days are 0. The penalty is the share of the train rank IC that is lost, at least 1 where the sign turns. A factor without any pair has
    coverage 0, overfit 1 and turnover 1.
    """
    n = calendar.agg(F.greatest(F.lit(1), F.floor(F.count("*") * fraction)).alias("n_train"), F.count("*").alias("n_all"))
    days = with_monotonicity(days.crossJoin(n), n_layers)
    late = (F.col("date_no") >= F.col("n_train")) | (F.col("n_train") >= F.col("n_all"))
    left = F.sum(F.when(late, F.col("pairs"))).over(Window.partitionBy("factor"))  # one row a date
    days = days.withColumn("held", late | (F.coalesce(left, F.lit(0)) == 0))
    on = lambda c: F.when(F.col("held"), c)
    ls = on(F.col(f"layer_{n_layers}") - F.col("layer_1"))
    out = days.groupBy("factor").agg(
        F.try_divide(F.sum("pairs").cast("double"), F.sum("rows").cast("double")).alias("coverage"), *daily_stats(on(F.col("ic")), "ic"), *daily_stats(on(F.col("rank_ic")), "rank_ic"), F.avg(F.when(F.col("date_no") < F.col("n_train"), F.col("rank_ic"))).alias("train_rank_ic"),
        F.avg(ls).alias("long_short_mean"), F.avg((ls > 0).cast("double")).alias("long_short_positive"), _ratio(F.avg(ls), F.stddev_samp(ls), "zero").alias("long_short_ir"), F.avg(on(F.col("mono"))).alias("layer_monotonicity"), F.coalesce(F.avg("turnover"), F.lit(0.0)).alias("turnover"), F.sum("pairs").alias("_pairs"),
    )
    zero = ["ic_mean", "ic_ir", "ic_positive", "rank_ic_mean", "rank_ic_ir", "rank_ic_positive", "train_rank_ic", "long_short_mean", "long_short_positive", "long_short_ir"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in zero})
    a, b = F.col("train_rank_ic"), F.col("rank_ic_mean")
    lost = F.greatest(F.lit(0.0), (F.abs(a) - F.abs(b)) / F.abs(a))
    penalty = F.when(F.abs(a) > 1e-12, F.when(a * b < 0, F.greatest(lost, F.lit(1.0))).otherwise(lost)).otherwise(0.0)
    empty = F.coalesce(F.col("_pairs"), F.lit(0)) == 0
    return out.withColumns({"overfit": F.when(empty, 1.0).otherwise(penalty), "turnover": F.when(empty, 1.0).otherwise(F.col("turnover"))}).drop("_pairs")


#: Weights of the fitness score's parts.
FITNESS_WEIGHTS = {"rank_ic": 0.35, "icir": 0.25, "long_short_ir": 0.15, "coverage": 0.10, "positive": 0.05, "turnover": -0.10, "complexity": -0.05, "correlation": -0.05, "overfit": -0.10}


def fitness(metrics: DataFrame) -> DataFrame:
    """Adds ``fitness``: scores of rank IC (at 0.05), its ratio (1.5), long-short ratio (1), coverage and positive share, less
    penalties for turnover, complexity, correlation and overfitting, each from 0 to 1; columns that are absent count 0
    (turnover 1)."""
    has = lambda c, other=0.0: F.col(c) if c in metrics.columns else F.lit(other)
    parts = {
        "rank_ic": abs_score(has("rank_ic_mean"), 0.05), "icir": abs_score(has("rank_ic_ir"), 1.5), "long_short_ir": abs_score(has("long_short_ir"), 1.0), "coverage": bounded(has("coverage")), "positive": bounded(has("rank_ic_positive")),
        "turnover": bounded(has("turnover", 1.0)), "complexity": bounded(has("complexity")), "correlation": bounded(has("correlation")), "overfit": bounded(has("overfit")),
    }
    return metrics.withColumn("fitness", sum((v * FITNESS_WEIGHTS[k] for k, v in parts.items()), F.lit(0.0)))


def derived_metrics(metrics: DataFrame, digits: int = 6) -> DataFrame:
    """Adds size and sign of IC and rank IC, the sizes of the IC's ratio and of the Sharpe ratio, and the return over the
    drawdown; all rounded. Only of columns that are there."""
    new = {}
    for c in ("ic_mean", "rank_ic_mean"):
        if c in metrics.columns:
            new |= {f"{c}_abs": F.abs(c), f"{c}_sign": F.signum(c)}
    new |= {f"{c}_abs": F.abs(c) for c in ("ic_ir", "sharpe") if c in metrics.columns}
    if {"annual_return", "max_drawdown"} <= set(metrics.columns):
        new["calmar"] = F.try_divide(F.col("annual_return"), F.abs("max_drawdown"))
    out = metrics.withColumns(new)
    return out.select(*(F.round(c, digits).alias(c) if t == "double" else c for c, t in out.dtypes))


#: Metrics where there is no factor, and the weights of the formula where none was evaluated.
NO_FACTOR = {"sharpe": 0.0, "turnover": 1.0, "drawdown": 1.0, "coverage": 0.0}
DEFAULT_WEIGHTS = {"sharpe_coverage": 0.9, "sharpe_failure": 0.2, "turnover_base": 0.18, "turnover_coverage": 0.27, "drawdown_base": 0.1, "drawdown_failure": 0.25}


def default_metrics(counts: DataFrame, none: dict[str, float] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds sharpe, turnover, drawdown and coverage where nothing could be evaluated, from columns total, generated and failed.

    Without factors (total null, 0 or less) they are those of ``none``; else they follow from the shares of generated and
    failed factors, rounded to 3 digits.
    """
    none, w = NO_FACTOR | (none or {}), DEFAULT_WEIGHTS | (weights or {})
    share = lambda c: bounded(F.try_divide(F.coalesce(F.col(c), F.lit(0)).cast("double"), F.col("total").cast("double")))
    coverage, failure = share("generated"), share("failed")
    clamp = lambda x, low, high: F.greatest(F.lit(low), F.least(F.lit(high), F.round(x, 3)))
    found = {
        "sharpe": clamp(coverage * w["sharpe_coverage"] - failure * w["sharpe_failure"], -1.0, float("inf")), "turnover": clamp(w["turnover_base"] + w["turnover_coverage"] * (1 - coverage), 0.0, 1.5),
        "drawdown": clamp(w["drawdown_base"] + w["drawdown_failure"] * failure, 0.0, 1.5), "coverage": F.round(coverage, 3),
    }
    some = F.coalesce(F.col("total"), F.lit(0)) > 0
    return counts.withColumns({k: F.when(some, v).otherwise(F.lit(float(none[k]))) for k, v in found.items()})


def evaluation_report(df: DataFrame, score: str, target: str = "returns_1d", n_layers: int = 5, q: float = 0.2, selected: int = 1, failed: int = 0) -> DataFrame:
    """One row for a score: coverage, turnover, IC statistics, mean return of each layer and of the top less the bottom, annual
    return and drawdown of the daily long-short series; all from one table of days.

    A day with pairs but without a top or a bottom group returns 0. The drawdown is a size; sharpe and information_ratio
    are the ratio of the IC. Without any pair ICs are 0 and the drawdown is 1. The status is failed without a selected factor, partial where
    factors failed or there is no pair, else finished.
    """
    days = daily_metrics(long_frame(df, [score], target), dates(df), n_layers, 2, q)
    w = Window.partitionBy("factor").orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)  # one row a date
    spread = F.when(F.col("pairs") > 0, F.when(F.col("pairs") > 1, F.coalesce(F.col("long_return") - F.col("short_return"), F.lit(0.0))).otherwise(0.0))
    days = with_monotonicity(days, n_layers).withColumns({"spread": spread, "ls": F.col(f"layer_{n_layers}") - F.col("layer_1")})
    days = days.withColumn("cumulative", F.when(F.col("pairs") > 0, compound(F.col("spread"), w)))
    days = days.withColumn("drawdown", F.try_divide(F.col("cumulative"), F.max("cumulative").over(w)) - 1)
    ls = F.col("ls")
    pooled = [F.try_divide(F.sum(F.col(f"layer_{k}") * F.col(f"layer_{k}_rows")), F.sum(F.when(F.col(f"layer_{k}").isNotNull(), F.col(f"layer_{k}_rows"))).cast("double")).alias(f"layer_{k}_mean_return") for k in range(1, n_layers + 1)]
    out = days.groupBy("factor").agg(
        F.try_divide(F.sum("pairs").cast("double"), F.sum("rows").cast("double")).alias("coverage"), *daily_stats(F.col("ic"), "ic"), *daily_stats(F.col("rank_ic"), "rank_ic"), *pooled,
        F.avg(ls).alias("long_short_mean"), F.avg((ls > 0).cast("double")).alias("long_short_positive"), F.when(F.count(ls) > 0, _ratio(F.avg(ls), F.stddev_samp(ls), "zero")).alias("long_short_ir"), F.avg("mono").alias("layer_monotonicity"),
        F.coalesce(F.avg("turnover"), F.lit(0.0)).alias("turnover"), (F.avg("spread") * 252).alias("annual_return"), F.abs(F.min("drawdown")).alias("max_drawdown"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("_pairs"),
    )
    out = out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("ic_mean", "ic_ir", "rank_ic_mean", "rank_ic_ir")})
    out = out.withColumns({"information_ratio": F.when(F.col("_pairs") > 0, F.col("ic_ir")), "sharpe": F.col("ic_ir"), "max_drawdown": F.coalesce("max_drawdown", F.lit(1.0))})
    status = F.lit("failed") if not selected else F.when(F.lit(failed > 0) | (F.col("_pairs") == 0), "partial").otherwise("finished")
    return derived_metrics(out.withColumn("status", status).drop("_pairs"))


def research(panel: DataFrame, expressions: dict[str, str], target: str = "returns_1d") -> dict[str, object]:
    """Calculate, preprocess, screen, score and evaluate: the result tables of each step."""
    from factorloom.operators.factors import with_factors
    from factorloom.operators.preprocess import preprocess

    values, failed = with_factors(panel, expressions)
    names = [k for k in expressions if k not in failed]
    cleaned, report, notes = preprocess(values, names)
    screened = screen(cleaned, names, target)
    passed = [r["factor"] for r in screened.filter("passed").select("factor").collect()]  # names of the given factors
    scored = factor_score(cleaned, passed, names)
    return {"values": values, "failed": failed, "preprocess": report, "warnings": notes, "screen": screened, "passed": passed, "scored": scored, "evaluation": evaluation_report(scored, "score", target, selected=len(passed or names), failed=len(failed))}


def compare_rounds(rounds: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, current, best, change, larger): the last round (of column ``round``) against the last accepted before it.

    ``larger`` names the side with the larger value, the baseline where they are equal; where one side has no value (or there is
    no accepted round), the other. Metrics of which neither side has a value are left out.
    """
    last = rounds.agg(F.max_by(F.struct(*metrics), "round").alias("c"), F.max("round").alias("r"))
    base = rounds.crossJoin(last.select("r")).filter("accepted and round < r").agg(F.max_by(F.struct(*metrics), "round").alias("b"))
    one = last.crossJoin(base).select(*(F.struct(F.col(f"c.{m}").alias("current"), F.col(f"b.{m}").alias("best")).alias(m) for m in metrics))
    out = one.unpivot([], metrics, "metric", "v").select("metric", "v.current", "v.best").filter("current is not null or best is not null")
    ahead = F.col("best").isNull() | (F.col("current") > F.col("best"))
    return out.withColumns({"change": F.col("current") - F.col("best"), "larger": F.when(ahead, "current").otherwise("best")})
