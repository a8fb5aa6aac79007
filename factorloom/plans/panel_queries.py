"""Queries on panels and factors."""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions.stats import dealt, over_assets, rounded
from factorloom.operators import diagnostics, evaluate, model, panel, preprocess
from factorloom.operators.factors import with_factors

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query; its doubles are rounded, as those of its SQL."""

    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel of days and users: bars of the events' values, with the next day's return."""
    bars = panel.bars_from_ticks(table(spark, sf_dir, "events"), "ts", "user_id", "value", "event_id")
    return panel.with_label(bars)


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel of weeks and suppliers: mean price, volume, amount and discount, with the next week's return.

    Means are taken in whole cents and hundredths and rounded by integer division, so that equal rows have equal values.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        F.date_trunc("week", "l_shipdate").alias("datetime"), F.col("l_suppkey").cast("string").alias("symbol"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("c"), F.col("l_quantity").cast("bigint").alias("q"), F.round(F.col("l_discount") * 100).cast("bigint").alias("d"), "l_discount"
    )
    # hardly two lines of a part of the table share week and supplier: they are dealt by supplier at once, for the sums and for what follows along assets
    sums = dealt(lines, "symbol").groupBy("datetime", "symbol").agg(F.sum("c").alias("cents"), F.sum("q").alias("q"), F.sum("d").alias("d"), F.count("l_discount").alias("n"))
    out = sums.select("datetime", "symbol", F.expr("(cents * 200 + q) div (2 * q) / 10000.0D AS close"), F.col("q").cast("double").alias("volume"), F.expr("cents / 100.0D AS amount"), F.expr("(d * 20000 + n) div (2 * n) / 1000000.0D AS discount"))
    return panel.with_label(out)


P1 = """p AS (
  SELECT date_trunc('day', ts)::TIMESTAMP AS datetime, user_id::VARCHAR AS symbol, first(value ORDER BY ts, event_id) AS open,
    max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(value)::DOUBLE AS volume, avg(value) AS vwap
  FROM events GROUP BY 1, 2),
panel AS (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY datetime) / nullif(close, 0) - 1 AS returns_1d FROM p)"""
P2 = """s AS (
  SELECT date_trunc('week', l_shipdate)::TIMESTAMP AS datetime, l_suppkey::VARCHAR AS symbol, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents,
    sum(l_quantity::BIGINT)::BIGINT AS q, sum(round(l_discount * 100)::BIGINT)::BIGINT AS d, count(l_discount) AS n FROM lineitem GROUP BY 1, 2),
p AS (SELECT datetime, symbol, ((cents * 200 + q) // (2 * q))::DOUBLE / 10000 AS close, q::DOUBLE AS volume, cents::DOUBLE / 100 AS amount, ((d * 20000 + n) // (2 * n))::DOUBLE / 1000000 AS discount FROM s),
panel AS (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY datetime) / nullif(close, 0) - 1 AS returns_1d FROM p)"""


def sql_rank(x: str, by: str = "datetime") -> str:
    """Mean-tie percentile rank in SQL."""
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) END"


def r6(*columns: str) -> str:
    return ", ".join(f"round({c} + 0.0, 6) AS {c}" for c in columns)


@query(f"""WITH {P1},
f AS (SELECT datetime, symbol, returns_1d, close / nullif(lag(close, 5) OVER (PARTITION BY symbol ORDER BY datetime), 0) - 1 AS x FROM panel),
g AS (SELECT * FROM f WHERE x IS NOT NULL AND returns_1d IS NOT NULL),
k AS (SELECT datetime, {sql_rank('x')} AS a, {sql_rank('returns_1d')} AS b FROM g),
d AS (SELECT datetime, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) AS ic, count(*) AS n FROM k GROUP BY 1 HAVING count(*) >= 2)
SELECT 'momentum' AS factor, round(avg(ic), 6) AS rank_ic_mean, round(stddev_samp(ic), 6) AS rank_ic_std, round(avg(ic) / greatest(abs(stddev_samp(ic)), 1e-12), 6) AS rank_ic_ir,
  round(avg((ic > 1e-12)::INT::DOUBLE), 6) AS rank_ic_positive, count(ic) AS rank_ic_dates FROM d WHERE ic IS NOT NULL""")
def momentum_rank_ic(spark, sf_dir):
    df, _ = with_factors(daily(spark, sf_dir), {"momentum": "RANK($close / DELAY($close, 5) - 1)"})
    long = evaluate.long_frame(df, ["momentum"], "returns_1d")
    return evaluate.ic_summary(evaluate.daily_ic(long, "spearman"), prefix="rank_ic")


@query(f"WITH {P1} SELECT datetime, symbol, {r6('open', 'high', 'low', 'close', 'volume', 'vwap', 'returns_1d')} FROM panel")
def panel_daily_bars(spark, sf_dir):
    return daily(spark, sf_dir)


@query(f"WITH {P2} SELECT datetime, symbol, {r6('close', 'volume', 'amount', 'discount', 'returns_1d')} FROM panel")
def panel_weekly(spark, sf_dir):
    return weekly(spark, sf_dir)


@query("""SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS datetime, l_suppkey::VARCHAR AS symbol,
  round(max(l_extendedprice), 6) AS high, round(min(l_discount), 6) AS low,
  round(first(l_tax ORDER BY l_shipdate, l_orderkey, l_linenumber), 6) AS open, round(last(l_extendedprice ORDER BY l_shipdate, l_orderkey, l_linenumber), 6) AS close,
  round(sum(l_quantity), 6) AS volume FROM lineitem GROUP BY 1, 2""")
def panel_resample(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("datetime"), F.col("l_suppkey").cast("string").alias("symbol"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("high"), F.col("l_discount").alias("low"), F.col("l_tax").alias("open"), F.col("l_extendedprice").alias("close"), F.col("l_quantity").alias("volume"))
    return panel.daily_bars(lines, order=("l_orderkey", "l_linenumber"), volume="sum")


@query(f"""WITH {P1} SELECT count(*) AS n_rows, 7 AS n_columns, count(DISTINCT symbol) AS n_symbols, count(DISTINCT datetime) AS n_dates, min(datetime) AS first_date, max(datetime) AS last_date,
  round((count(*) - count(open) + count(*) - count(high) + count(*) - count(low) + count(*) - count(close) + count(*) - count(volume) + count(*) - count(vwap) + count(*) - count(returns_1d)) / (count(*) * 7.0), 6) AS nan_ratio,
  'open,high,low,close,volume,vwap' AS features, 'returns_1d' AS labels FROM panel""")
def panel_summary(spark, sf_dir):
    return panel.summary(daily(spark, sf_dir))


@query(f"WITH {P1} SELECT symbol, min(datetime) AS first_date, max(datetime) AS last_date FROM panel GROUP BY symbol")
def panel_instruments(spark, sf_dir):
    return panel.instruments(daily(spark, sf_dir))


@query(f"WITH {P1} SELECT DISTINCT datetime, dense_rank() OVER (ORDER BY datetime)::INT - 1 AS date_no FROM panel")
def panel_calendar(spark, sf_dir):
    return panel.dates(daily(spark, sf_dir))


@query(f"""WITH {P2}, c AS (SELECT DISTINCT datetime FROM panel), g AS (SELECT epoch(datetime)::BIGINT - lag(epoch(datetime)::BIGINT) OVER (ORDER BY datetime) AS step FROM c),
m AS (SELECT step FROM g WHERE step IS NOT NULL GROUP BY step ORDER BY count(*) DESC, step LIMIT 1) SELECT step AS seconds, (step // 86400) || 'd' AS step FROM m""")
def panel_time_step(spark, sf_dir):
    return panel.time_step(weekly(spark, sf_dir))


@query(f"""WITH {P1} SELECT datetime, symbol, {r6('open', 'high', 'low', 'close', 'volume', 'vwap', 'returns_1d')} FROM panel
WHERE datetime IN (SELECT DISTINCT datetime FROM panel ORDER BY datetime DESC LIMIT 10) AND symbol IN (SELECT DISTINCT symbol FROM panel ORDER BY symbol LIMIT 20)""")
def panel_debug_slice(spark, sf_dir):
    return panel.debug_slice(daily(spark, sf_dir), 10, 20)


@query(f"""WITH {P1}, c AS (SELECT datetime, dense_rank() OVER (ORDER BY datetime) - 1 AS k FROM (SELECT DISTINCT datetime FROM panel)),
n AS (SELECT count(*) AS n FROM c) SELECT panel.datetime, symbol, CASE WHEN k < greatest(1, floor(n * 0.7)) THEN CASE WHEN greatest(1, floor(n * 0.7)) >= n THEN 'both' ELSE 'train' END ELSE 'valid' END AS segment
FROM panel JOIN c ON c.datetime = panel.datetime, n""")
def panel_train_split(spark, sf_dir):
    return panel.split_by_fraction(daily(spark, sf_dir), 0.7).select("datetime", "symbol", "segment")


RANGES = {"train": ("1992-01-01", "1998-12-31"), "valid": ("1999-01-01", "2000-06-30"), "test": ("2000-07-01", "2030-01-01")}


@query(f"""WITH {P2} SELECT CASE WHEN datetime BETWEEN '1992-01-01' AND '1998-12-31' THEN 'train' WHEN datetime BETWEEN '1999-01-01' AND '2000-06-30' THEN 'valid'
  WHEN datetime BETWEEN '2000-07-01' AND '2030-01-01' THEN 'test' END AS segment, count(*) AS n, count(DISTINCT datetime) AS n_dates FROM panel GROUP BY 1""")
def panel_segments(spark, sf_dir):
    return panel.segments(weekly(spark, sf_dir), RANGES).groupBy("segment").agg(F.count("*").alias("n"), F.count_distinct("datetime").alias("n_dates"))


@query(f"""WITH {P2} SELECT factor, round(1 - n / t, 6) AS missing_ratio, round(n / t, 6) AS coverage FROM (
  SELECT unnest(['close', 'volume', 'amount', 'discount', 'returns_1d']) AS factor, unnest([count(close), count(volume), count(amount), count(discount), count(returns_1d)]) AS n, count(*)::DOUBLE AS t FROM panel)""")
def panel_missing_ratio(spark, sf_dir):
    return panel.missing_ratio(weekly(spark, sf_dir), ["close", "volume", "amount", "discount", "returns_1d"])


@query(f"""WITH {P1} SELECT datetime, {', '.join(f"round(max(CASE WHEN symbol = '{a}' THEN {f} END), 6) AS \"{a}|{f}\"" for a in ('0', '1', '2', '3') for f in ('close', 'volume'))}
FROM panel WHERE symbol IN ('0', '1', '2', '3') GROUP BY datetime""")
def panel_wide_matrix(spark, sf_dir):
    return panel.wide_matrix(daily(spark, sf_dir), ["close", "volume"], ["0", "1", "2", "3"])


W = "OVER (PARTITION BY symbol ORDER BY datetime"


def rows(p: int) -> str:
    return f"{W} ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"


@query(f"""WITH {P1} SELECT datetime, symbol, round((close - open) / nullif(open, 0), 6) AS body, round(volume / nullif(avg(volume) {rows(20)}, 0), 6) AS volume_ratio,
  round((high - low) / nullif(lag(close) {W}), 0), 6) AS range_ratio, round(close / nullif(lag(close) {W}), 0) - 1, 6) AS momentum,
  round(lead(close, 2) {W}) / nullif(lead(close, 1) {W}), 0) - 1, 6) AS label FROM panel""")
def baseline_features(spark, sf_dir):
    return panel.baseline_features(daily(spark, sf_dir)).select("datetime", "symbol", "body", "volume_ratio", "range_ratio", "momentum", "label")


ASSET_FACTORS = {
    "delay": "DELAY($close, 2)", "delta": "DELTA($close, 3)", "ts_mean": "TS_MEAN($close, 5)", "ts_sum": "TS_SUM($volume, 4)", "ts_min": "TS_MIN($low, 6)", "ts_max": "TS_MAX($high, 6)", "ts_std": "TS_STD($close, 5)",
    "ts_median": "TS_MEDIAN($close, 5)", "ts_zscore": "TS_ZSCORE($close, 7)", "ts_pctchange": "TS_PCTCHANGE($close, 2)", "wma": "WMA($close, 3)", "ts_corr": "TS_CORR($close, $vwap, 6)",
}


@query(f"""WITH {P1}, b AS (SELECT *, row_number() {W}) AS rn FROM panel) SELECT datetime, symbol, round(lag(close, 2) {W}), 6) AS delay, round(close - lag(close, 3) {W}), 6) AS delta, round(avg(close) {rows(5)}, 6) AS ts_mean,
  round(sum(volume) {rows(4)}, 6) AS ts_sum, round(min(low) {rows(6)}, 6) AS ts_min, round(max(high) {rows(6)}, 6) AS ts_max, round(stddev_samp(close) {rows(5)}, 6) AS ts_std,
  round(median(close) {rows(5)}, 6) AS ts_median, round((close - avg(close) {rows(7)}) / nullif(stddev_samp(close) {rows(7)}, 0), 6) AS ts_zscore, round(close / nullif(lag(close, 2) {W}), 0) - 1, 6) AS ts_pctchange,
  round(close * 3 / 6 + CASE WHEN rn > 1 THEN lag(close, 1) {W}) ELSE 0 END * 2 / 6 + CASE WHEN rn > 2 THEN lag(close, 2) {W}) ELSE 0 END / 6, 6) AS wma,
  round(CASE WHEN count(close) {rows(6)} >= 2 THEN covar_samp(close, vwap) {rows(6)} / nullif(stddev_samp(close) {rows(6)} * stddev_samp(vwap) {rows(6)}, 0) END, 6) AS ts_corr FROM b""")
def factors_along_assets(spark, sf_dir):
    return with_factors(daily(spark, sf_dir), ASSET_FACTORS, ["datetime", "symbol"])[0]


@query(f"""WITH {P1}, w AS (SELECT datetime, symbol, close, list(close) {rows(5)} AS v FROM panel) SELECT datetime, symbol,
  round((len(list_filter(v, lambda x: x < close)) + (len(list_filter(v, lambda x: x = close)) + 1) / 2.0) / len(v), 6) AS ts_rank FROM w""")
def factor_ts_rank(spark, sf_dir):
    return with_factors(daily(spark, sf_dir), {"ts_rank": "TS_RANK($close, 5)"}, ["datetime", "symbol"])[0]


@query(f"""WITH {P2}, w AS (SELECT datetime, symbol, close, median(close) {rows(100)} AS m, list(close) {rows(100)} AS v FROM panel) SELECT datetime, symbol, round(m, 6) AS middle,
  round((len(list_filter(v, lambda x: x < close)) + (len(list_filter(v, lambda x: x = close)) + 1) / 2.0) / len(v), 6) AS place FROM w""")
def factors_long_windows(spark, sf_dir):
    """Medians and ranks of a hundred rows, streamed."""
    return with_factors(weekly(spark, sf_dir), {"middle": "TS_MEDIAN($close, 100)", "place": "TS_RANK($close, 100)"}, ["datetime", "symbol"])[0]


D = "OVER (PARTITION BY datetime)"


@query(f"""WITH {P1} SELECT datetime, symbol, round({sql_rank('close')}, 6) AS rank_, round(avg(close) {D}, 6) AS mean_, round(stddev_samp(close) {D}, 6) AS std_, round(median(close) {D}, 6) AS median_, round(max(close) {D}, 6) AS max_,
  round(min(close) {D}, 6) AS min_, round((close - avg(close) {D}) / nullif(stddev_samp(close) {D}, 0), 6) AS zscore, round(2 * volume / nullif(sum(abs(volume)) {D}, 0), 6) AS scale_ FROM panel""")
def factors_across_dates(spark, sf_dir):
    return with_factors(daily(spark, sf_dir), {"rank_": "RANK($close)", "mean_": "MEAN($close)", "std_": "STD($close)", "median_": "MEDIAN($close)", "max_": "MAX($close)", "min_": "MIN($close)", "zscore": "ZSCORE($close)", "scale_": "SCALE($volume, 2)"}, ["datetime", "symbol"])[0]


@query(f"""WITH {P1} SELECT datetime, symbol, round(abs(close - open), 6) AS abs_, round(ln(greatest(close - 20, 1e-12)), 6) AS log_, round(sign(close - open), 6) AS sign_, round(greatest(close, open), 6) AS max_, round(least(close, 10.0), 6) AS min_,
  round((close - open) / nullif(high - low, 0), 6) AS ratio, round(-close * 2 + 1, 6) AS linear, (close > open AND volume > 1)::DOUBLE AS flag FROM panel""")
def factors_within_rows(spark, sf_dir):
    return with_factors(daily(spark, sf_dir), {"abs_": "ABS($close - $open)", "log_": "LOG($close - 20)", "sign_": "SIGN($close - $open)", "max_": "MAX($close, $open)", "min_": "MIN($close, 10)", "ratio": "($close - $open) / ($high - $low)", "linear": "-$close * 2 + 1", "flag": "($close > $open) && ($volume > 1)"}, ["datetime", "symbol"])[0]


@query(f"""WITH {P1}, a AS (SELECT *, avg(close) {rows(3)} AS m3, avg(close) {rows(5)} AS m5 FROM panel),
b AS (SELECT *, {sql_rank('m3')} AS r3, (m5 - avg(m5) {D}) / nullif(stddev_samp(m5) {D}, 0) AS z5 FROM a)
SELECT datetime, symbol, round(r3, 6) AS f1, round(avg(r3) {rows(4)}, 6) AS f2, round(z5 - r3, 6) AS f3, round(z5 - lag(z5, 1) {W}), 6) AS f4 FROM b""")
def factors_nested(spark, sf_dir):
    return with_factors(daily(spark, sf_dir), {"f1": "RANK(TS_MEAN($close, 3))", "f2": "TS_MEAN(RANK(TS_MEAN($close, 3)), 4)", "f3": "ZSCORE(TS_MEAN($close, 5)) - RANK(TS_MEAN($close, 3))", "f4": "DELTA(ZSCORE(TS_MEAN($close, 5)), 1)"}, ["datetime", "symbol"])[0]


#: Twenty factors of the benchmark, evaluated level by level together.
TWENTY = {f"f{i}": e for i, e in enumerate([*ASSET_FACTORS.values(), "RANK(TS_MEAN($close, 3))", "ZSCORE(TS_STD($close, 5))", "RANK(DELTA($close, 1)) - RANK($volume)", "TS_MEAN(RANK($close), 5)", "SCALE(TS_SUM($volume, 3))", "TS_RANK($close, 8)", "$close / DELAY($close, 5) - 1", "ZSCORE($close) * RANK($volume)"])}


@query(f"""WITH {P1}, a AS (SELECT *, row_number() {W}) AS rn, avg(close) {rows(3)} AS m3, stddev_samp(close) {rows(5)} AS s5, close - lag(close, 1) {W}) AS d1, sum(volume) {rows(3)} AS v3, list(close) {rows(8)} AS l8, close / nullif(lag(close, 5) {W}), 0) - 1 AS f18 FROM panel),
b AS (SELECT *, {sql_rank('m3')} AS r3, {sql_rank('d1')} AS rd, {sql_rank('volume')} AS rv, {sql_rank('close')} AS rc, (s5 - avg(s5) {D}) / nullif(stddev_samp(s5) {D}, 0) AS f13, v3 / nullif(sum(abs(v3)) {D}, 0) AS f16, (close - avg(close) {D}) / nullif(stddev_samp(close) {D}, 0) AS zc FROM a)
SELECT datetime, symbol, round(lag(close, 2) {W}), 6) AS f0, round(close - lag(close, 3) {W}), 6) AS f1, round(avg(close) {rows(5)}, 6) AS f2, round(sum(volume) {rows(4)}, 6) AS f3, round(min(low) {rows(6)}, 6) AS f4, round(max(high) {rows(6)}, 6) AS f5, round(stddev_samp(close) {rows(5)}, 6) AS f6, round(median(close) {rows(5)}, 6) AS f7,
  round((close - avg(close) {rows(7)}) / nullif(stddev_samp(close) {rows(7)}, 0), 6) AS f8, round(close / nullif(lag(close, 2) {W}), 0) - 1, 6) AS f9, round(close * 3 / 6 + CASE WHEN rn > 1 THEN lag(close, 1) {W}) ELSE 0 END * 2 / 6 + CASE WHEN rn > 2 THEN lag(close, 2) {W}) ELSE 0 END / 6, 6) AS f10,
  round(CASE WHEN count(close) {rows(6)} >= 2 THEN covar_samp(close, vwap) {rows(6)} / nullif(stddev_samp(close) {rows(6)} * stddev_samp(vwap) {rows(6)}, 0) END, 6) AS f11, round(r3, 6) AS f12, round(f13, 6) AS f13, round(rd - rv, 6) AS f14, round(avg(rc) {rows(5)}, 6) AS f15, round(f16, 6) AS f16,
  round((len(list_filter(l8, lambda x: x < close)) + (len(list_filter(l8, lambda x: x = close)) + 1) / 2.0) / len(l8), 6) AS f17, round(f18, 6) AS f18, round(zc * rv, 6) AS f19 FROM b""")
def factors_twenty(spark, sf_dir):
    return with_factors(daily(spark, sf_dir), TWENTY, ["datetime", "symbol"])[0]


_MANY = [(f"f{i}", f"f{j}") for i in range(20) for j in range(i + 1, 20)]
_BOTH = lambda a, b: f"CASE WHEN {b} IS NOT NULL THEN {a} END"


@query(f"""WITH f AS ({re.sub(r"round[(]((?:(?!, 6[)] AS ).)*), 6[)] AS ", r"(\1) AS ", SQL["factors_twenty"])}),
c AS (SELECT {', '.join(f"covar_samp({_BOTH(a, b)}, {_BOTH(b, a)}) / nullif(stddev_samp({_BOTH(a, b)}) * stddev_samp({_BOTH(b, a)}), 0) AS c{k}" for k, (a, b) in enumerate(_MANY))} FROM f)
SELECT unnest({[a for a, _ in _MANY]}) AS f1, unnest({[b for _, b in _MANY]}) AS f2, round(unnest([{', '.join(f'c{k}' for k in range(len(_MANY)))}]), 6) AS corr FROM c""")
def factor_correlations_many(spark, sf_dir):
    """All pairs of twenty factors, from blocked matrices."""
    return diagnostics.correlation_pairs(with_factors(daily(spark, sf_dir), TWENTY, ["datetime", "symbol"])[0], list(TWENTY))


@query(f"""WITH {P2}, m AS (SELECT *, median(close) {D} AS m FROM panel), d AS (SELECT *, median(abs(close - m)) {D} * 1.4826 AS d FROM m)
SELECT datetime, symbol, round(CASE WHEN d > 0 THEN greatest(m - 3 * d, least(m + 3 * d, close)) ELSE close END, 6) AS close FROM d""")
def preprocess_winsorise(spark, sf_dir):
    return preprocess.winsorise(weekly(spark, sf_dir), ["close"]).select("datetime", "symbol", "close")


@query(f"""WITH {P2} SELECT datetime, symbol, round(CASE WHEN count(*) {D} >= 3 THEN close - avg(close) {D} - coalesce(covar_samp(close, volume) {D} / nullif(var_samp(volume) {D}, 0), 0) * (volume - avg(volume) {D}) ELSE close END, 6) AS close FROM panel""")
def preprocess_neutralise(spark, sf_dir):
    return preprocess.neutralise(weekly(spark, sf_dir), ["close"], "volume").select("datetime", "symbol", "close")


#: Ordinary least squares on two variables from a date's centred moments; the second one in units of 1e12.
TWO_SQL = f"""{P2}, m AS (SELECT *, amount * 1e9 AS cap, count(*) {D} AS n, avg(close) {D} AS my, avg(volume) {D} AS m1, avg(amount * 1e9) {D} AS m2 FROM panel),
c AS (SELECT *, sum((volume - m1) * (volume - m1)) {D} AS s11, sum((volume - m1) * (cap - m2) / 1e12) {D} AS s12, sum((cap - m2) / 1e12 * (cap - m2) / 1e12) {D} AS s22, sum((volume - m1) * (close - my)) {D} AS sy1, sum((cap - m2) / 1e12 * (close - my)) {D} AS sy2 FROM m),
o AS (SELECT *, s11 * s22 - s12 * s12 AS det FROM c)"""


@query(f"""WITH {TWO_SQL} SELECT datetime, symbol, round(CASE WHEN n < 4 THEN close WHEN det > 4e-10 * s11 * s22 THEN close - my - (s22 * sy1 - s12 * sy2) / det * (volume - m1) - (s11 * sy2 - s12 * sy1) / det * (cap - m2) / 1e12
  WHEN s11 > 0 THEN close - my - sy1 / s11 * (volume - m1) WHEN s22 > 0 THEN close - my - sy2 / s22 * (cap - m2) / 1e12 ELSE close - my END, 4) + 0.0 AS close, CASE WHEN n < 4 THEN round(discount, 6) ELSE 0 END AS planted FROM o""")
def preprocess_neutralise_many(spark, sf_dir):
    """Two factors on two variables, one in units of a market capitalisation; one of the factors is a sum of the variables."""
    df = weekly(spark, sf_dir).withColumns({"cap": F.col("amount") * 1e9, "planted": F.col("discount")})
    n = F.count("*").over(over_assets())
    df = df.withColumn("planted", F.when(n >= 4, F.col("volume") * 2 + F.col("cap") / 1e12).otherwise(F.col("discount")))
    out = preprocess.neutralise_many(df, ["close", "planted"], ["volume", "cap"])
    return out.select("datetime", "symbol", F.round("close", 4).alias("close"), "planted")


G = "OVER (PARTITION BY datetime, sector)"


@query(f"""WITH {P2}, t AS (SELECT *, 's' || (symbol::BIGINT % 3) AS sector FROM panel), g AS (SELECT *, close - avg(close) {G} AS y, volume - avg(volume) {G} AS x FROM t)
SELECT datetime, symbol, round(CASE WHEN count(*) {D} >= 3 THEN y - coalesce(sum(x * y) {D} / nullif(sum(x * x) {D}, 0), 0) * x ELSE close END, 5) + 0.0 AS close FROM g""")
def preprocess_neutralise_groups(spark, sf_dir):
    """Residuals on a text column, as if each of its values had a variable, and on a number."""
    df = weekly(spark, sf_dir).withColumn("sector", F.concat(F.lit("s"), (F.col("symbol").cast("bigint") % 3).cast("string")))
    return preprocess.neutralise_groups(df, ["close"], ["sector"], ["volume"]).select("datetime", "symbol", F.round("close", 5).alias("close"))


def _by_policy(c: str) -> str:
    return f"""m_{c} AS (SELECT datetime, symbol, {c} AS v, market_cap AS x, median({c}) {D} AS m FROM holes), d_{c} AS (SELECT *, median(abs(v - m)) {D} * 1.4826 AS d FROM m_{c}), w_{c} AS (SELECT datetime, symbol, CASE WHEN v IS NOT NULL THEN x END AS x, x AS own, CASE WHEN d > 0 THEN CASE WHEN v IS NOT NULL THEN greatest(m - 3 * d, least(m + 3 * d, v)) END ELSE v END AS v FROM d_{c}),
n_{c} AS (SELECT datetime, symbol, CASE WHEN count(x) {D} >= 3 THEN v - avg(v) {D} - coalesce(covar_samp(v, x) {D} / nullif(var_samp(x) {D}, 0), 0) * (x - avg(x) {D}) ELSE v END AS v FROM w_{c}), l_{c} AS (SELECT datetime, symbol, last_value(v IGNORE NULLS) {W} ROWS UNBOUNDED PRECEDING) AS v FROM n_{c})"""


@query(f"""WITH {P2}, holes AS (SELECT datetime, symbol, amount AS market_cap, CASE WHEN volume % 4 <> 0 THEN close END AS close, CASE WHEN volume % 5 <> 0 THEN discount END AS discount FROM panel), {_by_policy('close')}, {_by_policy('discount')}
SELECT datetime, symbol, round(l_close.v, 5) + 0.0 AS close, round(l_discount.v, 6) + 0.0 AS discount, 'daily' AS close_fill, 'quarterly' AS discount_fill FROM l_close JOIN l_discount USING (datetime, symbol)""")
def preprocess_policy(spark, sf_dir):
    """What the panel's columns and the factors' descriptions call for: clipped, neutralised by market value, filled forward."""
    df = weekly(spark, sf_dir).withColumnRenamed("amount", "market_cap")
    df = df.withColumns({"close": F.when(F.col("volume") % 4 != 0, F.col("close")), "discount": F.when(F.col("volume") % 5 != 0, F.col("discount"))})
    out, policy = preprocess.preprocess_by_policy(df, {"close": "price of the week", "discount": "of a Quarterly statement"})
    return out.select("datetime", "symbol", F.round("close", 5).alias("close"), "discount", *(F.lit(policy["fill"][c]).alias(f"{c}_fill") for c in ("close", "discount")))


@query(f"WITH {P2} SELECT unnest(['close', 'discount', 'some']) AS column_name, unnest([count(close), count(discount), count(CASE WHEN volume > 60 THEN close END)]) AS n FROM panel")
def panel_drop_empty(spark, sf_dir):
    """Columns that have a value at all, with the number of their values."""
    df = weekly(spark, sf_dir).withColumns({"some": F.when(F.col("volume") > 60, F.col("close")), "none": F.lit(None).cast("double"), "never": F.when(F.col("volume") < 0, F.col("close"))})
    left = panel.drop_empty(df, ["close", "none", "discount", "never", "some"])
    return df.agg(*(F.count(c).alias(c) for c in left)).unpivot([], left, "column_name", "n")


@query(f"""WITH {P2}, f AS (SELECT datetime, symbol, coalesce(returns_1d, avg(returns_1d) {D}, 0) AS returns_1d, close FROM panel)
SELECT datetime, symbol, round({sql_rank('returns_1d')}, 6) AS returns_1d, round((close - avg(close) {D}) / nullif(stddev_samp(close) {D}, 0), 6) AS close FROM f""")
def preprocess_fill_and_normalise(spark, sf_dir):
    df = preprocess.fill_missing(weekly(spark, sf_dir), ["returns_1d"])
    df = preprocess.normalise_columns(preprocess.normalise_columns(df, ["returns_1d"], "rank"), ["close"], "zscore")
    return df.select("datetime", "symbol", "returns_1d", "close")


@query(f"""WITH {P2}, f AS (SELECT datetime, symbol, coalesce((close - avg(close) {D}) / nullif(stddev_samp(close) {D}, 0)) AS z, returns_1d FROM panel)
SELECT datetime, symbol, round(coalesce(z, avg(z) {D}, 0), 6) AS close, round({sql_rank('returns_1d')}, 6) AS returns_1d FROM f WHERE returns_1d IS NOT NULL""")
def preprocess_training_frame(spark, sf_dir):
    return preprocess.training_frame(weekly(spark, sf_dir), ["close"], "returns_1d").select("datetime", "symbol", "close", "returns_1d")


def _cleaned(c: str) -> str:
    """Steps of the preprocessing of one column, as common table expressions."""
    return f"""m_{c} AS (SELECT datetime, symbol, {c} AS v, discount AS x, median({c}) {D} AS m FROM panel), d_{c} AS (SELECT *, median(abs(v - m)) {D} * 1.4826 AS d FROM m_{c}), w_{c} AS (SELECT datetime, symbol, x, CASE WHEN d > 0 THEN greatest(m - 3 * d, least(m + 3 * d, v)) ELSE v END AS v FROM d_{c}),
n_{c} AS (SELECT datetime, symbol, CASE WHEN count(*) {D} >= 3 THEN v - avg(v) {D} - coalesce(covar_samp(v, x) {D} / nullif(var_samp(x) {D}, 0), 0) * (x - avg(x) {D}) ELSE v END AS v FROM w_{c}), z_{c} AS (SELECT datetime, symbol, (v - avg(v) {D}) / nullif(stddev_samp(v) {D}, 0) AS v FROM n_{c})"""


@query(f"WITH {P2}, {_cleaned('close')}, {_cleaned('volume')} SELECT panel.datetime, panel.symbol, round(z_close.v, 6) AS close, round(z_volume.v, 6) AS volume, {r6('amount', 'discount', 'returns_1d')} FROM panel JOIN z_close USING (datetime, symbol) JOIN z_volume USING (datetime, symbol)")
def preprocess_pipeline(spark, sf_dir):
    return preprocess.preprocess(weekly(spark, sf_dir), ["close", "volume"], neutralise_by=["discount"])[0]


FACTORS = {"reversal": "0 - $close / DELAY($close, 1) + 1", "volume": "TS_MEAN($volume, 4)", "cheap": "ZSCORE($discount)"}
LONG_SQL = f"""{P2}, w AS (SELECT *, 0 - close / nullif(lag(close) {W}), 0) + 1 AS reversal, avg(volume) {rows(4)} AS vol, (discount - avg(discount) {D}) / nullif(stddev_samp(discount) {D}, 0) AS cheap FROM panel),
long AS (SELECT datetime, symbol, returns_1d AS target, 'reversal' AS factor, reversal AS value FROM w UNION ALL SELECT datetime, symbol, returns_1d, 'volume', vol FROM w UNION ALL SELECT datetime, symbol, returns_1d, 'cheap', cheap FROM w),
pairs AS (SELECT * FROM long WHERE value IS NOT NULL AND target IS NOT NULL)"""
IC_T = f"""ranked AS (SELECT *, {sql_rank('value', 'factor, datetime')} AS rv, {sql_rank('target', 'factor, datetime')} AS rt FROM pairs),
ics AS (SELECT factor, datetime, covar_samp(value, target) / nullif(stddev_samp(value) * stddev_samp(target), 0) AS ic, covar_samp(rv, rt) / nullif(stddev_samp(rv) * stddev_samp(rt), 0) AS rank_ic FROM ranked GROUP BY 1, 2 HAVING count(*) >= 2)"""
IC_SQL = f"{LONG_SQL}, {IC_T}"


def scored(spark, sf_dir) -> DataFrame:
    return with_factors(weekly(spark, sf_dir), FACTORS)[0]


def long(spark, sf_dir) -> DataFrame:
    return evaluate.long_frame(scored(spark, sf_dir), list(FACTORS), "returns_1d")


@query(f"WITH {IC_SQL} SELECT factor, datetime, {r6('ic', 'rank_ic')} FROM ics")
def ic_daily(spark, sf_dir):
    return evaluate.both_ics(long(spark, sf_dir))


@query(f"""WITH {IC_SQL} SELECT factor, round(avg(ic), 6) AS ic_mean, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / greatest(abs(stddev_samp(ic)), 1e-12), 6) AS ic_ir, round(avg((ic > 1e-12)::INT::DOUBLE), 6) AS ic_positive, count(ic) AS ic_dates FROM ics WHERE ic IS NOT NULL GROUP BY factor""")
def ic_summary(spark, sf_dir):
    return evaluate.ic_summary(evaluate.daily_ic(long(spark, sf_dir)))


@query(f"WITH {LONG_SQL} SELECT factor, round(count(CASE WHEN value IS NOT NULL AND target IS NOT NULL THEN 1 END) / count(*)::DOUBLE, 6) AS coverage FROM long GROUP BY factor")
def factor_coverage(spark, sf_dir):
    return evaluate.coverage(long(spark, sf_dir))


TURNOVER_SQL = f"""c AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS k FROM (SELECT DISTINCT datetime FROM panel)),
tr AS (SELECT long.*, k, {sql_rank('value', 'factor, long.datetime')} AS r FROM long JOIN c ON c.datetime = long.datetime),
td AS (SELECT *, CASE WHEN lag(k) OVER (PARTITION BY factor, symbol ORDER BY k) = k - 1 THEN abs(r - lag(r) OVER (PARTITION BY factor, symbol ORDER BY k)) END AS d FROM tr),
tv AS (SELECT factor, coalesce(avg(d), 0) AS turnover FROM (SELECT factor, datetime, avg(d) AS d FROM td GROUP BY 1, 2) GROUP BY 1)"""


@query(f"WITH {LONG_SQL}, {TURNOVER_SQL} SELECT factor, round(turnover, 6) AS turnover FROM tv")
def factor_turnover(spark, sf_dir):
    return evaluate.turnover(long(spark, sf_dir), panel.dates(weekly(spark, sf_dir)))


LAYER_T = f"""b AS (SELECT *, row_number() OVER (PARTITION BY factor, datetime ORDER BY value, symbol) AS rn, count(*) OVER (PARTITION BY factor, datetime) AS cnt FROM pairs),
l AS (SELECT *, least(5, greatest(1, ceil(rn / cnt::DOUBLE * 5)))::INT AS bucket FROM b WHERE cnt >= 2)"""
LAYER_SQL = f"{LONG_SQL}, {LAYER_T}"


@query(f"WITH {LAYER_SQL} SELECT factor, bucket, round(avg(target), 6) AS mean_return, count(*) AS n FROM l GROUP BY 1, 2")
def layer_returns(spark, sf_dir):
    return evaluate.layer_returns(long(spark, sf_dir))


LAYERS = ", ".join(f"avg(CASE WHEN bucket = {k} THEN target END) AS layer_{k}" for k in range(1, 6))


@query(f"WITH {LAYER_SQL}, t AS (SELECT factor, datetime, {LAYERS} FROM l GROUP BY 1, 2) SELECT factor, datetime, {r6(*(f'layer_{k}' for k in range(1, 6)))}, round(layer_5 - layer_1, 6) AS long_short FROM t")
def layer_table(spark, sf_dir):
    return evaluate.layer_table(long(spark, sf_dir))


@query(f"""WITH {LAYER_SQL}, t AS (SELECT factor, datetime, {LAYERS} FROM l GROUP BY 1, 2), g AS (SELECT factor, datetime, bucket::DOUBLE AS x, avg(target) AS y FROM l GROUP BY 1, 2, 3),
m AS (SELECT factor, avg(c) AS layer_monotonicity FROM (SELECT factor, datetime, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) AS c FROM g GROUP BY 1, 2) GROUP BY 1),
ls AS (SELECT factor, avg(layer_5 - layer_1) AS long_short_mean, stddev_samp(layer_5 - layer_1) AS sd, avg((layer_5 - layer_1 > 0)::INT::DOUBLE) AS long_short_positive FROM t GROUP BY 1)
SELECT ls.factor, round(long_short_mean, 6) AS long_short_mean, round(long_short_positive, 6) AS long_short_positive, round(CASE WHEN sd > 1e-12 THEN long_short_mean / sd ELSE 0 END, 6) AS long_short_ir, round(layer_monotonicity, 6) AS layer_monotonicity FROM ls LEFT JOIN m ON m.factor = ls.factor""")
def layer_stats(spark, sf_dir):
    return evaluate.layer_stats(long(spark, sf_dir))


@query(f"""WITH {LONG_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY factor, datetime ORDER BY value DESC, symbol) AS rn, count(*) OVER (PARTITION BY factor, datetime) // 5 AS z FROM long WHERE value IS NOT NULL),
g AS (SELECT factor, datetime, {', '.join(f'avg(CASE WHEN z > 0 AND (rn - 1) // z = {i} THEN target END) AS group_{i + 1}' for i in range(5))} FROM b GROUP BY 1, 2), a AS (SELECT factor, datetime, avg(target) AS m FROM long GROUP BY 1, 2)
SELECT g.factor, g.datetime, {', '.join(f'round(group_{i}, 6) AS group_{i}' for i in range(1, 6))}, round(group_1 - group_5, 6) AS long_short, round(group_1 - m, 6) AS long_average FROM g JOIN a ON a.factor = g.factor AND a.datetime = g.datetime
WHERE coalesce(group_1, group_2, group_3, group_4, group_5) IS NOT NULL""")
def group_returns(spark, sf_dir):
    return evaluate.group_returns(long(spark, sf_dir))


@query(f"""WITH {IC_SQL}, q AS (SELECT factor, datetime, avg(CASE WHEN rv >= 0.8 THEN target END) AS long_return, avg(CASE WHEN rv <= 0.2 THEN target END) AS short_return, avg(target) AS average_return FROM ranked GROUP BY 1, 2)
SELECT factor, datetime, {r6('long_return', 'short_return', 'average_return')}, round(long_return - short_return, 6) AS long_short, round(long_return - average_return, 6) AS long_average FROM q""")
def long_short_by_rank(spark, sf_dir):
    return evaluate.quantile_long_short(long(spark, sf_dir))


HALF_T = f"""k AS (SELECT *, row_number() OVER (PARTITION BY factor, datetime ORDER BY value DESC, symbol) AS hi, row_number() OVER (PARTITION BY factor, datetime ORDER BY value, symbol) AS lo, greatest(1, floor(count(*) OVER (PARTITION BY factor, datetime) * 0.2)) AS n FROM pairs),
q AS (SELECT factor, datetime, avg(CASE WHEN hi <= n THEN target END) AS long_return, avg(CASE WHEN lo <= n THEN target END) AS short_return, avg(target) AS average_return FROM k GROUP BY 1, 2)"""
HALF_SQL = f"{LONG_SQL}, {HALF_T}"


@query(f"""WITH {HALF_SQL} SELECT factor, datetime, {r6('long_return', 'short_return', 'average_return')}, round((long_return - short_return) / 2, 6) AS long_short, round(long_return - average_return, 6) AS long_average FROM q""")
def long_short_by_count(spark, sf_dir):
    return evaluate.quantile_long_short(long(spark, sf_dir), by_rank=False, half=True)


@query(f"""WITH {HALF_SQL}, h AS (SELECT factor, (long_return - short_return) / 2 AS v FROM q) SELECT factor, round(avg(v) * 252, 6) AS annual_return, round(avg(v) / nullif(stddev_samp(v), 0) * sqrt(252.0), 6) AS annual_sharpe FROM h GROUP BY 1""")
def annualised_return(spark, sf_dir):
    return evaluate.annualised(evaluate.quantile_long_short(long(spark, sf_dir), by_rank=False, half=True), "long_short")


SCREEN_SQL = f"""{LONG_SQL}, {TURNOVER_SQL}, n AS (SELECT greatest(1, floor(count(*) * 0.7)) AS n FROM c),
t AS (SELECT long.* FROM long JOIN c ON c.datetime = long.datetime, n WHERE k < n), tp AS (SELECT * FROM t WHERE value IS NOT NULL AND target IS NOT NULL),
rk AS (SELECT *, {sql_rank('value', 'factor, datetime')} AS rv, {sql_rank('target', 'factor, datetime')} AS rt FROM tp),
i AS (SELECT factor, datetime, covar_samp(rv, rt) / nullif(stddev_samp(rv) * stddev_samp(rt), 0) AS ic FROM rk GROUP BY 1, 2 HAVING count(*) >= 2),
st AS (SELECT factor, avg(ic) AS m, avg(ic) / greatest(abs(coalesce(stddev_samp(ic), 0)), 1e-12) AS ir, avg((ic > 1e-12)::INT::DOUBLE) AS pos, count(ic) AS n FROM i WHERE ic IS NOT NULL GROUP BY 1),
cv AS (SELECT factor, count(CASE WHEN value IS NOT NULL AND target IS NOT NULL THEN 1 END) / count(*)::DOUBLE AS cov FROM t GROUP BY 1),
screened AS (SELECT cv.factor, round(m, 6) AS ic_mean, round(m, 6) AS rank_ic_mean, round(ir, 6) AS ic_ir, round(ir, 6) AS rank_ic_ir, round(cov, 6) AS coverage, round(turnover, 6) AS turnover, round(pos, 6) AS ic_positive, coalesce(st.n, 0) AS n_valid_dates,
  coalesce(abs(m) >= 0.01 AND abs(ir) >= 0.1 AND cov >= 0.3, false) AS passed, CASE WHEN coalesce(st.n, 0) < 2 THEN 'too_few_valid_dates' WHEN abs(m) >= 0.01 AND abs(ir) >= 0.1 AND cov >= 0.3 THEN 'passed' ELSE 'below_threshold' END AS reason
FROM cv LEFT JOIN st ON st.factor = cv.factor LEFT JOIN tv ON tv.factor = cv.factor)"""


@query(f"WITH {SCREEN_SQL} SELECT * FROM screened")
def factor_screen(spark, sf_dir):
    return evaluate.screen(scored(spark, sf_dir), list(FACTORS))


@query(f"""WITH {SCREEN_SQL}, g AS (SELECT * EXCLUDE (passed, reason), CASE WHEN ic_mean IS NULL THEN 'metrics' WHEN abs(ic_mean) < 0.003 THEN 'ic' WHEN abs(ic_ir) < 0.02 THEN 'icir' WHEN turnover > 1 THEN 'turnover' WHEN coverage < 0.3 THEN 'coverage' END AS gate FROM screened)
SELECT *, gate IS NULL AS passed, coalesce('failed_' || gate, 'passed') AS reason FROM g""")
def factor_gate(spark, sf_dir):
    return evaluate.threshold_gate(evaluate.screen(scored(spark, sf_dir), list(FACTORS)))


@query(f"WITH {IC_SQL}, g AS (SELECT factor, avg(ic) AS m, avg(ic) / greatest(abs(coalesce(stddev_samp(ic), 0)), 1e-12) AS r, count(ic) AS n FROM ics WHERE ic IS NOT NULL GROUP BY 1) SELECT factor, round(m, 6) AS ic_mean, round(r, 6) AS ic_ir, n, n >= 5 AND abs(m) >= 0.02 AND abs(r) >= 0.1 AS passed FROM g")
def factor_batch_screen(spark, sf_dir):
    return evaluate.batch_screen(evaluate.daily_ic(long(spark, sf_dir)), min_icir=0.1)


@query(f"""WITH {LONG_SQL} SELECT datetime, symbol, round((coalesce(reversal, 0) + coalesce(cheap, 0)) / nullif((reversal IS NOT NULL)::INT + (cheap IS NOT NULL)::INT, 0), 6) AS score FROM w""")
def factor_score(spark, sf_dir):
    return evaluate.factor_score(scored(spark, sf_dir), ["reversal", "cheap"], list(FACTORS)).select("datetime", "symbol", "score")


def sql_stats(v: str, name: str, floor: bool, share: str = "") -> str:
    """Mean, deviation, ratio, positive share (of the values, or of the rows that ``share`` counts) and number of a daily value, as aggregates."""
    positive = f"sum(({v} > 1e-12)::INT) / {share}::DOUBLE" if share else f"avg(({v} > 1e-12)::INT::DOUBLE)"
    ratio = f"avg({v}) / greatest(coalesce(stddev_samp({v}), 0), 1e-12)" if floor else f"CASE WHEN stddev_samp({v}) > 1e-12 THEN avg({v}) / stddev_samp({v}) END"
    return f"round(avg({v}), 6) AS {name}_mean, round(stddev_samp({v}), 6) AS {name}_std, round({ratio}, 6) AS {name}_ir, round({positive}, 6) AS {name}_positive, count({v}) AS {name}_dates"


def sql_annual(v: str, mean: str, ratio: str) -> str:
    return f"round(avg({v}) * 252, 6) AS {mean}, round(avg({v}) / nullif(stddev_samp({v}), 0) * sqrt(252.0), 6) AS {ratio}"


COVER = "round(sum((value IS NOT NULL AND target IS NOT NULL)::INT) / count(*)::DOUBLE, 6) AS coverage"


@query(f"""WITH {LONG_SQL}, {HALF_T}, {IC_T}, big AS (SELECT factor, datetime FROM pairs GROUP BY 1, 2 HAVING count(*) >= 3), h AS (SELECT q.*, (long_return - short_return) / 2 AS ls, long_return - average_return AS la FROM q),
i AS (SELECT factor, {sql_stats('ic', 'ic', False, 'count(*)')}, {sql_stats('rank_ic', 'rank_ic', False, 'count(*)')} FROM (SELECT h.factor, h.datetime, CASE WHEN big.factor IS NOT NULL THEN ic END AS ic, CASE WHEN big.factor IS NOT NULL THEN rank_ic END AS rank_ic FROM h LEFT JOIN ics USING (factor, datetime) LEFT JOIN big USING (factor, datetime)) GROUP BY 1), a AS (SELECT factor, {sql_annual('ls', 'long_short_annual_return', 'long_short_sharpe')}, {sql_annual('la', 'long_average_annual_return', 'long_average_sharpe')} FROM h GROUP BY 1),
cv AS (SELECT factor, {COVER} FROM long GROUP BY 1) SELECT * FROM cv JOIN i USING (factor) JOIN a USING (factor) WHERE factor = 'reversal'""")
def signal_analysis(spark, sf_dir):
    return evaluate.signal_analysis(scored(spark, sf_dir), "reversal", "returns_1d")


#: A factor without any value.
NOTHING = {"nothing": "TS_MEAN($close / 0, 3)"}
LONG4_SQL = LONG_SQL.replace("'cheap', cheap FROM w)", "'cheap', cheap FROM w UNION ALL SELECT datetime, symbol, returns_1d, 'nothing', NULL FROM w)")

#: Held dates, layers and their order by day, and the metrics of held_out_metrics with the fitness.
DAYS_T = f"""n AS (SELECT greatest(1, floor(count(*) * 0.7)) AS n, count(*) AS every FROM c), lt AS (SELECT factor, datetime, {LAYERS} FROM l GROUP BY 1, 2),
mono AS (SELECT factor, datetime, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) AS mono FROM (SELECT factor, datetime, bucket::DOUBLE AS x, avg(target) AS y FROM l GROUP BY 1, 2, 3) GROUP BY 1, 2),
hp AS (SELECT factor, sum((value IS NOT NULL AND target IS NOT NULL AND (k >= n OR n >= every))::INT) AS late_pairs, sum((value IS NOT NULL AND target IS NOT NULL)::INT) AS all_pairs FROM long JOIN c ON c.datetime = long.datetime CROSS JOIN n GROUP BY 1),
days AS (SELECT f.factor, f.datetime, c.k, c.k >= n.n OR n.n >= n.every OR late_pairs = 0 AS held, c.k < n.n AS train, ic, rank_ic, layer_5 - layer_1 AS ls, mono FROM (SELECT DISTINCT factor, datetime FROM long) f JOIN c ON c.datetime = f.datetime JOIN hp ON hp.factor = f.factor CROSS JOIN n LEFT JOIN ics ON ics.factor = f.factor AND ics.datetime = f.datetime LEFT JOIN lt ON lt.factor = f.factor AND lt.datetime = f.datetime LEFT JOIN mono ON mono.factor = f.factor AND mono.datetime = f.datetime)"""


def sql_held(v: str, name: str) -> str:
    """``sql_stats`` of held days, not rounded, 0 where there is none."""
    x = f"CASE WHEN held THEN {v} END"
    return f"coalesce(avg({x}), 0) AS {name}_mean, stddev_samp({x}) AS {name}_std, coalesce(avg({x}) / greatest(coalesce(stddev_samp({x}), 0), 1e-12), 0) AS {name}_ir, coalesce(avg(({x} > 1e-12)::INT::DOUBLE), 0) AS {name}_positive, count({x}) AS {name}_dates"


_LS = "CASE WHEN held THEN ls END"
TEF_T = f"""te AS (SELECT factor, {sql_held('ic', 'ic')}, {sql_held('rank_ic', 'rank_ic')}, coalesce(avg(CASE WHEN train THEN rank_ic END), 0) AS train_rank_ic, coalesce(avg({_LS}), 0) AS long_short_mean, coalesce(avg(({_LS} > 0)::INT::DOUBLE), 0) AS long_short_positive,
  CASE WHEN stddev_samp({_LS}) > 1e-12 THEN avg({_LS}) / stddev_samp({_LS}) ELSE 0 END AS long_short_ir, avg(CASE WHEN held THEN mono END) AS layer_monotonicity FROM days GROUP BY 1),
cv AS (SELECT factor, sum((value IS NOT NULL AND target IS NOT NULL)::INT) / count(*)::DOUBLE AS coverage FROM long GROUP BY 1),
ov AS (SELECT te.*, coverage, CASE WHEN all_pairs = 0 THEN 1 ELSE turnover END AS turnover, all_pairs, train_rank_ic AS a, rank_ic_mean AS b FROM te JOIN cv USING (factor) JOIN tv USING (factor) JOIN hp USING (factor)),
ot AS (SELECT *, CASE WHEN all_pairs = 0 THEN 1 WHEN abs(a) > 1e-12 THEN CASE WHEN a * b < 0 THEN greatest(1, (abs(a) - abs(b)) / abs(a)) ELSE greatest(0, (abs(a) - abs(b)) / abs(a)) END ELSE 0 END AS overfit FROM ov)"""


def sql_fitness(**parts: str) -> str:
    """The fitness of columns that are named as its parts; absent ones count as 0, missing values too."""
    one = {"rank_ic": "abs(rank_ic_mean) / 0.05", "icir": "abs(rank_ic_ir) / 1.5", "long_short_ir": "abs(long_short_ir)", "coverage": "coverage", "positive": "rank_ic_positive", "turnover": "turnover", "overfit": "overfit"} | parts
    return " + ".join(f"({evaluate.FITNESS_WEIGHTS[k]}) * CASE WHEN {v} IS NULL THEN 0 ELSE greatest(0, least(1, {v})) END" for k, v in one.items())


_TEF = ["ic_mean", "ic_std", "ic_ir", "ic_positive", "rank_ic_mean", "rank_ic_std", "rank_ic_ir", "rank_ic_positive", "train_rank_ic", "long_short_mean", "long_short_positive", "long_short_ir", "layer_monotonicity", "coverage", "turnover", "overfit"]
TEF_SQL = f"{LONG4_SQL}, {IC_T}, {LAYER_T}, {TURNOVER_SQL}, {DAYS_T}, {TEF_T}"


@query(f"WITH {TEF_SQL} SELECT factor, {r6(*_TEF)}, ic_dates, rank_ic_dates, round({sql_fitness()}, 6) AS fitness FROM ot")
def train_eval_fitness(spark, sf_dir):
    df = with_factors(weekly(spark, sf_dir), FACTORS | NOTHING)[0]
    return evaluate.fitness(evaluate.train_eval_metrics(df, [*FACTORS, *NOTHING]))


@query(f"""WITH {LONG4_SQL}, {IC_T}, {LAYER_T}, {TURNOVER_SQL}, {DAYS_T}, sp AS (SELECT factor, datetime, CASE WHEN count(*) > 1 THEN coalesce(avg(CASE WHEN rv >= 0.8 THEN target END) - avg(CASE WHEN rv <= 0.2 THEN target END), 0) ELSE 0 END AS spread FROM ranked GROUP BY 1, 2),
cu AS (SELECT *, product(1 + spread) OVER (PARTITION BY factor ORDER BY datetime) AS cum FROM sp), dd AS (SELECT factor, avg(spread) * 252 AS annual_return, abs(min(f)) AS max_drawdown FROM (SELECT *, cum / nullif(max(cum) OVER (PARTITION BY factor ORDER BY datetime), 0) - 1 AS f FROM cu) GROUP BY 1),
g AS (SELECT factor, {sql_stats('ic', 'ic', True)}, {sql_stats('rank_ic', 'rank_ic', True)}, {sql_stats('ls', 'long_short', True)}, round(avg((ls > 0)::INT::DOUBLE), 6) AS ls_positive, round(CASE WHEN count(ls) = 0 THEN NULL WHEN stddev_samp(ls) > 1e-12 THEN avg(ls) / stddev_samp(ls) ELSE 0 END, 6) AS ls_ir, round(avg(mono), 6) AS layer_monotonicity FROM days GROUP BY 1),
pl AS (SELECT factor, {', '.join(f'round(avg(CASE WHEN bucket = {k} THEN target END), 6) AS layer_{k}_mean_return' for k in range(1, 6))} FROM l GROUP BY 1),
cv AS (SELECT factor, {COVER} FROM long GROUP BY 1), e AS (SELECT * REPLACE (coalesce(ic_mean, 0) AS ic_mean, coalesce(ic_ir, 0) AS ic_ir, coalesce(rank_ic_mean, 0) AS rank_ic_mean, coalesce(rank_ic_ir, 0) AS rank_ic_ir, coalesce(max_drawdown, 1) AS max_drawdown) FROM cv JOIN g USING (factor) JOIN tv USING (factor) JOIN hp USING (factor) LEFT JOIN dd USING (factor) LEFT JOIN pl USING (factor) WHERE factor IN ('reversal', 'nothing'))
SELECT factor, coverage, ic_mean, ic_std, ic_ir, ic_positive, ic_dates, rank_ic_mean, rank_ic_std, rank_ic_ir, rank_ic_positive, rank_ic_dates, {', '.join(f'layer_{k}_mean_return' for k in range(1, 6))}, long_short_mean, ls_positive AS long_short_positive, ls_ir AS long_short_ir, layer_monotonicity, round(turnover, 6) AS turnover, round(annual_return, 6) AS annual_return, round(max_drawdown, 6) AS max_drawdown,
  CASE WHEN all_pairs > 0 THEN ic_ir END AS information_ratio, ic_ir AS sharpe, CASE WHEN all_pairs = 0 THEN 'partial' ELSE 'finished' END AS status, abs(ic_mean) AS ic_mean_abs, sign(ic_mean)::DOUBLE AS ic_mean_sign, abs(rank_ic_mean) AS rank_ic_mean_abs, sign(rank_ic_mean)::DOUBLE AS rank_ic_mean_sign, abs(ic_ir) AS ic_ir_abs, abs(ic_ir) AS sharpe_abs,
  round(annual_return / abs(nullif(max_drawdown, 0)), 6) AS calmar FROM e""")
def evaluation_report(spark, sf_dir):
    df = with_factors(weekly(spark, sf_dir), FACTORS | NOTHING)[0]
    return evaluate.evaluation_report(df, "reversal").unionByName(evaluate.evaluation_report(df, "nothing"))


@query(None)
def research_pipeline(spark, sf_dir):
    return evaluate.research(weekly(spark, sf_dir), FACTORS)["evaluation"]


@query(f"""WITH {IC_SQL}, mo AS (SELECT factor, year(datetime) AS y, month(datetime) AS m, avg(ic) AS ic FROM ics WHERE ic IS NOT NULL GROUP BY 1, 2, 3),
sp AS (SELECT factor, unnest(range(min(y), max(y) + 1)) AS y FROM mo GROUP BY 1)
SELECT sp.factor, sp.y::INT AS year, {', '.join(f'round(max(CASE WHEN m = {m} THEN ic END), 6) AS m{m:02d}' for m in range(1, 13))} FROM sp LEFT JOIN mo ON mo.factor = sp.factor AND mo.y = sp.y GROUP BY 1, 2""")
def monthly_ic(spark, sf_dir):
    return diagnostics.monthly_ic(evaluate.daily_ic(long(spark, sf_dir)))


@query(f"""WITH {HALF_SQL}, sr AS (SELECT datetime, (long_return - short_return) / 2 AS v, year(datetime) AS y, month(datetime) AS m FROM q WHERE factor = 'reversal'),
c AS (SELECT *, sum(coalesce(v, 0)) OVER (PARTITION BY y, m ORDER BY datetime) AS cum FROM sr), d AS (SELECT *, cum - max(cum) OVER (PARTITION BY y, m ORDER BY datetime) AS dd FROM c)
SELECT y::INT AS year, m::INT AS month, round(avg(v) * 252, 6) AS annual_return, round(min(dd), 6) AS max_drawdown, round(CASE WHEN stddev_samp(v) > 1e-12 THEN avg(v) / stddev_samp(v) ELSE 0 END, 6) AS information_ratio, round(stddev_samp(v), 6) AS std, count(*) AS n FROM d GROUP BY 1, 2 HAVING count(*) >= 3""")
def monthly_risk(spark, sf_dir):
    series = evaluate.quantile_long_short(long(spark, sf_dir), by_rank=False, half=True).filter("factor = 'reversal'")
    return diagnostics.monthly_risk(series, "long_short")


@query(f"""WITH {HALF_SQL}, sr AS (SELECT factor, datetime, (long_return - short_return) / 200 AS v FROM q), c AS (SELECT *, exp(sum(ln(1 + coalesce(v, 0))) OVER (PARTITION BY factor ORDER BY datetime)) AS cumulative FROM sr),
pk AS (SELECT *, max(cumulative) OVER (PARTITION BY factor ORDER BY datetime) AS peak FROM c) SELECT factor, datetime, round(cumulative, 6) AS cumulative, round(cumulative / peak - 1, 6) AS drawdown FROM pk""")
def drawdown(spark, sf_dir):
    series = evaluate.quantile_long_short(long(spark, sf_dir), by_rank=False, half=True).withColumn("r", F.col("long_short") / 100)
    return diagnostics.drawdown(series, "r", ("factor",)).select("factor", "datetime", "cumulative", "drawdown")


LAG_SQL = f"{LONG_SQL}, o AS (SELECT *, lag(value) OVER (PARTITION BY factor, symbol ORDER BY datetime) AS old FROM long)"


@query(f"""WITH {LAG_SQL}, r AS (SELECT factor, datetime, {sql_rank('value', 'factor, datetime')} AS a, {sql_rank('old', 'factor, datetime')} AS b FROM o), p2 AS (SELECT factor, datetime, CASE WHEN b IS NOT NULL THEN a END AS a, CASE WHEN a IS NOT NULL THEN b END AS b FROM r), ac AS (SELECT factor, datetime, round(covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0), 6) AS autocorrelation FROM p2 GROUP BY 1, 2) SELECT * FROM ac WHERE autocorrelation IS NOT NULL""")
def score_autocorrelation(spark, sf_dir):
    return diagnostics.score_autocorrelation(long(spark, sf_dir))


@query(f"""WITH {LAG_SQL}, r AS (SELECT *, count(*) OVER (PARTITION BY factor, datetime) // 5 AS n, {', '.join(f'row_number() OVER (PARTITION BY factor, datetime ORDER BY {c} {o} NULLS LAST, symbol) AS {t}' for c, o, t in (('value', 'DESC', 'tn'), ('old', 'DESC', 'tp'), ('value', 'ASC', 'bn'), ('old', 'ASC', 'bp')))} FROM o)
SELECT factor, datetime, round(1 - count(CASE WHEN tn <= n AND tp <= n THEN 1 END) / nullif(max(n), 0)::DOUBLE, 6) AS top_turnover, round(1 - count(CASE WHEN bn <= n AND bp <= n THEN 1 END) / nullif(max(n), 0)::DOUBLE, 6) AS low_turnover FROM r GROUP BY 1, 2 HAVING max(n) > 0""")
def set_turnover(spark, sf_dir):
    return diagnostics.set_turnover(long(spark, sf_dir))


@query(f"WITH {LONG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY factor, datetime ORDER BY value DESC, symbol) AS place FROM long WHERE value IS NOT NULL) SELECT factor, datetime, symbol, round(value, 6) AS value, place FROM r WHERE place <= 50")
def top_scores(spark, sf_dir):
    return diagnostics.top_scores(long(spark, sf_dir))


@query(f"""WITH {LONG_SQL}, d AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY value DESC, symbol) AS rn, count(*) OVER (PARTITION BY factor) // 5 AS z FROM long WHERE value IS NOT NULL AND datetime = (SELECT max(datetime) FROM long)),
g AS (SELECT *, CASE WHEN z > 0 THEN least((rn - 1) // z, 4) ELSE 4 END + 1 AS group_no FROM d), k AS (SELECT *, row_number() OVER (PARTITION BY factor, group_no ORDER BY rn) AS place FROM g)
SELECT factor, datetime, group_no::INT AS group_no, place, symbol, round(value, 6) AS value FROM k WHERE place <= 5""")
def inspect_groups(spark, sf_dir):
    return diagnostics.inspect_groups(long(spark, sf_dir))


PORTFOLIO_SQL = f"""{P2}, b AS (SELECT datetime, avg(returns_1d) AS bench, avg(CASE WHEN discount > 0.05 THEN returns_1d END) AS ret, 0.001 AS cost FROM panel WHERE returns_1d IS NOT NULL GROUP BY 1)"""


def portfolio(spark, sf_dir) -> DataFrame:
    p = weekly(spark, sf_dir).filter("returns_1d is not null")
    daily_table = p.groupBy("datetime").agg(F.avg("returns_1d").alias("bench"), F.avg(F.when(F.col("discount") > 0.05, F.col("returns_1d"))).alias("ret"), F.lit(0.001).alias("cost"))
    return diagnostics.portfolio_report(daily_table)


@query(f"""WITH {PORTFOLIO_SQL}, e AS (SELECT *, ret - bench AS excess, ret - bench - cost AS excess_net FROM b), c AS (SELECT *, sum(excess_net) OVER (ORDER BY datetime) AS cum FROM e)
SELECT datetime, round(excess_net, 6) AS excess_net, round(cum, 6) AS cum_excess_net, round(cum - max(cum) OVER (ORDER BY datetime), 6) AS drawdown_excess_net FROM c""")
def portfolio_report(spark, sf_dir):
    return portfolio(spark, sf_dir).select("datetime", "excess_net", "cum_excess_net", "drawdown_excess_net")


@query(f"""WITH {PORTFOLIO_SQL}, e AS (SELECT datetime, ret - bench - cost AS x FROM b), c AS (SELECT *, sum(x) OVER (ORDER BY datetime) AS cum FROM e), d AS (SELECT *, cum - max(cum) OVER (ORDER BY datetime) AS dd FROM c), f AS (SELECT datetime AS last FROM d WHERE dd IS NOT NULL ORDER BY dd, datetime LIMIT 1)
SELECT round(avg(x) * 252, 6) AS annual_excess, round(avg(x) / nullif(stddev_samp(x), 0) * sqrt(252.0), 6) AS information_ratio, round(min(dd), 6) AS max_drawdown, (SELECT last FROM f) AS drawdown_end, (SELECT datetime FROM d WHERE datetime <= (SELECT last FROM f) AND cum IS NOT NULL ORDER BY cum DESC, datetime DESC LIMIT 1) AS drawdown_start FROM d""")
def portfolio_summary(spark, sf_dir):
    return diagnostics.portfolio_summary(portfolio(spark, sf_dir))


@query(f"""WITH {LONG_SQL}, v AS (SELECT long.*, panel.volume AS v FROM long JOIN panel ON panel.datetime = long.datetime AND panel.symbol = long.symbol), sd AS (SELECT factor, avg(s) AS mean_std FROM (SELECT factor, datetime, stddev_samp(value) AS s FROM long GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT factor, count(value) / count(*)::DOUBLE AS coverage, quantile_cont(value, 0.01) AS q1, quantile_cont(value, 0.5) AS q5, quantile_cont(value, 0.99) AS q9, covar_samp(value, CASE WHEN value IS NOT NULL THEN v END) / nullif(stddev_samp(CASE WHEN v IS NOT NULL THEN value END) * stddev_samp(CASE WHEN value IS NOT NULL THEN v END), 0) AS size_corr FROM v GROUP BY 1),
off AS (SELECT factor, avg(abs(value - q5)) AS off FROM v JOIN a USING (factor) GROUP BY 1), r AS (SELECT a.factor, coverage, mean_std, CASE WHEN q9 > q1 THEN off / ((q9 - q1) / 1.4826 + 1e-12) END AS tail_ratio, size_corr FROM a JOIN sd ON sd.factor = a.factor JOIN off ON off.factor = a.factor)
SELECT factor, {r6('coverage', 'mean_std', 'tail_ratio', 'size_corr')}, concat_ws(',', CASE WHEN coverage < 0.3 THEN 'low_coverage' END, CASE WHEN mean_std < 0.01 THEN 'low_dispersion' END, CASE WHEN tail_ratio > 10 THEN 'heavy_tail' END, CASE WHEN abs(size_corr) > 0.8 THEN 'size_exposure' END) AS warnings FROM r""")
def factor_quality(spark, sf_dir):
    df, _ = with_factors(weekly(spark, sf_dir).withColumn("units", F.col("volume")), FACTORS)
    return diagnostics.factor_quality(df, list(FACTORS), "units")


@query(f"""WITH {LONG_SQL}, c AS (SELECT {', '.join(f"covar_samp(CASE WHEN {b} IS NOT NULL THEN {a} END, CASE WHEN {a} IS NOT NULL THEN {b} END) / nullif(stddev_samp(CASE WHEN {b} IS NOT NULL THEN {a} END) * stddev_samp(CASE WHEN {a} IS NOT NULL THEN {b} END), 0) AS c{i}" for i, (a, b) in enumerate((('reversal', 'vol'), ('reversal', 'cheap'), ('vol', 'cheap'))))} FROM w)
SELECT unnest(['reversal', 'reversal', 'volume']) AS f1, unnest(['volume', 'cheap', 'cheap']) AS f2, round(unnest([c0, c1, c2]), 6) AS corr FROM c""")
def factor_correlations(spark, sf_dir):
    return diagnostics.correlation_pairs(scored(spark, sf_dir), list(FACTORS))


@query(f"""WITH {LONG_SQL}, c AS (SELECT datetime, row_number() OVER (ORDER BY datetime) - 1 AS k FROM (SELECT DISTINCT datetime FROM panel)), n AS (SELECT greatest(1, floor(count(*) * 0.7)) AS n FROM c),
rk AS (SELECT *, {sql_rank('value', 'factor, datetime')} AS rv, {sql_rank('target', 'factor, datetime')} AS rt FROM pairs), i AS (SELECT factor, datetime, CASE WHEN count(*) < 2 THEN 0 ELSE covar_samp(rv, rt) / nullif(stddev_samp(rv) * stddev_samp(rt), 0) END AS ic FROM rk GROUP BY 1, 2),
j AS (SELECT factor, avg(CASE WHEN k < n THEN ic END) AS ic_in, avg(CASE WHEN k >= n THEN ic END) AS ic_out FROM i JOIN c ON c.datetime = i.datetime, n GROUP BY 1),
d AS (SELECT *, coalesce(ic_in, 0) AS a, coalesce(ic_out, 0) AS b, CASE WHEN abs(coalesce(ic_in, 0)) > 1e-12 THEN (abs(ic_in) - abs(coalesce(ic_out, 0))) / abs(ic_in) ELSE 0 END AS decay FROM j),
x AS (SELECT *, CASE WHEN abs(a) > 0.01 AND decay > 0.7 THEN 'decay' WHEN abs(a) > 0.01 AND a * b < 0 THEN 'sign_flip' WHEN abs(a) < 0.002 THEN 'underfit' ELSE 'ok' END AS reason FROM d)
SELECT factor, round(ic_in, 6) AS ic_in, round(ic_out, 6) AS ic_out, round(decay, 6) AS decay, reason, reason IN ('decay', 'sign_flip') AS overfit, abs(a) < 0.002 AS underfit, reason = 'ok' AS robust FROM x""")
def overfit_check(spark, sf_dir):
    return diagnostics.overfit_check(scored(spark, sf_dir), list(FACTORS))


#: A factor that reads the next date's price through a column made beforehand.
LEAK = {"leak": "DELTA($returns_1d, 1)"}


_CUT_W = "OVER (PARTITION BY e, symbol ORDER BY datetime"
_CUT_D = "OVER (PARTITION BY e, datetime)"


@query(f"""WITH {P2}, days AS (SELECT datetime AS e FROM (SELECT DISTINCT datetime FROM panel) ORDER BY 1 DESC LIMIT 6), cut AS (SELECT e, datetime, symbol, close, volume, discount, lead(close) {_CUT_W}) / nullif(close, 0) - 1 AS r FROM p JOIN days ON datetime <= e),
v AS (SELECT e, datetime, symbol, 0 - close / nullif(lag(close) {_CUT_W}), 0) + 1 AS reversal, avg(volume) {_CUT_W} ROWS 3 PRECEDING) AS volume, (discount - avg(discount) {_CUT_D}) / nullif(stddev_samp(discount) {_CUT_D}, 0) AS cheap, r - lag(r) {_CUT_W}) AS leak FROM cut),
l AS ({' UNION ALL '.join(f"SELECT e, datetime, symbol, '{f}' AS factor, {f} AS x FROM v" for f in [*FACTORS, *LEAK])}), whole AS (SELECT * FROM l WHERE e = (SELECT max(e) FROM days)),
g AS (SELECT l.factor, max(CASE WHEN (l.x IS NULL) <> (whole.x IS NULL) THEN 'infinity'::DOUBLE ELSE coalesce(abs(l.x - whole.x), 0) END) AS d FROM l JOIN whole ON l.factor = whole.factor AND l.symbol = whole.symbol AND l.datetime = whole.datetime WHERE l.e < whole.e GROUP BY 1)
SELECT factor, round(d, 6) AS max_diff, d <= 1e-8 AS passed FROM g""")
def look_ahead_check(spark, sf_dir):
    """The panel's label is derived again for each cut-off, so that a factor of it gives itself away."""
    return diagnostics.look_ahead(weekly(spark, sf_dir).drop("returns_1d"), FACTORS | LEAK, prepare=panel.with_label, prepared=(0, 1))


#: Candidates: good ones (the delay of one is clamped to 2), one without values, an equal one, one with an unknown column, one with too many nodes.
CANDIDATES = FACTORS | NOTHING | {"same": " ( ".join(FACTORS["cheap"].split("(")), "broken": "RANK($nothing)", "wide": " + ".join(["$close"] * 25)}
_NODES = {k: sum(1 for _ in ast.walk(ast.parse(CANDIDATES[k].replace("$", "").strip(), mode="eval"))) for k in CANDIDATES}
_POP = ["rank_ic_mean", "rank_ic_ir", "long_short_ir", "coverage", "turnover", "overfit"]
_REJECTED = {"same": ("duplicate", "duplicate_expression"), "broken": ("rejected", "unknown_column:$nothing"), "wide": ("rejected", "expression_too_many_nodes")}


@query(f"""WITH {TEF_SQL.replace("lag(close) ", "lag(close, 2) ")}, nd(factor, complexity) AS (VALUES {', '.join(f"('{k}', {min(1, v / 40)}::DOUBLE)" for k, v in _NODES.items())}), x AS (SELECT * FROM ot JOIN nd USING (factor))
SELECT factor AS factor_name, 'evaluated' AS status, NULL AS reason, {r6(*_POP, 'complexity')}, round({sql_fitness(complexity='complexity')}, 6) AS fitness FROM x
UNION ALL SELECT * FROM (VALUES {', '.join(f"('{k}', '{a}', '{b}', {'NULL, ' * len(_POP)}round({min(1, _NODES[k] / 40)}::DOUBLE, 6), NULL)" for k, (a, b) in _REJECTED.items())})""")
def population_scores(spark, sf_dir):
    candidates = spark.createDataFrame([*CANDIDATES.items()], "factor_name string, factor_expression string")
    return model.score_population(weekly(spark, sf_dir), candidates).select("factor_name", "status", "reason", *_POP, "complexity", "fitness")


_SUBSETS = {k: sorted(f for i, f in enumerate(FACTORS) if k >> i & 1) for k in range(1, 8)}
_MEAN = lambda own: f"({' + '.join(f'coalesce(r_{f}, 0)' for f in own)}) / nullif({' + '.join(f'(r_{f} IS NOT NULL)::INT' for f in own)}, 0)"
_PAIRS = {frozenset(("reversal", "volume")): "c0", frozenset(("reversal", "cheap")): "c1", frozenset(("volume", "cheap")): "c2"}
_CORR = lambda own: next(iter([f"({' + '.join(f'abs({c})' for c in used)}) / {len(used)}"] if (used := [c for p, c in _PAIRS.items() if p <= set(own)]) else ["0"]))
SUBSET_SQL = f"""{P2}, w AS (SELECT *, 0 - close / nullif(lag(close) {W}), 0) + 1 AS reversal, avg(volume) {rows(4)} AS vol, (discount - avg(discount) {D}) / nullif(stddev_samp(discount) {D}, 0) AS cheap FROM panel),
cr AS (SELECT {', '.join(f"covar_samp(CASE WHEN {b} IS NOT NULL THEN {a} END, CASE WHEN {a} IS NOT NULL THEN {b} END) / nullif(stddev_samp(CASE WHEN {b} IS NOT NULL THEN {a} END) * stddev_samp(CASE WHEN {a} IS NOT NULL THEN {b} END), 0) AS c{i}" for i, (a, b) in enumerate((('reversal', 'vol'), ('reversal', 'cheap'), ('vol', 'cheap'))))} FROM w),
rr AS (SELECT *, {sql_rank('reversal')} AS r_reversal, {sql_rank('vol')} AS r_volume, {sql_rank('cheap')} AS r_cheap FROM w),
long AS ({' UNION ALL '.join(f"SELECT datetime, symbol, returns_1d AS target, '{k}' AS factor, {_MEAN(own)} AS value FROM rr" for k, own in _SUBSETS.items())}), pairs AS (SELECT * FROM long WHERE value IS NOT NULL AND target IS NOT NULL), {IC_T}, {TURNOVER_SQL},
{LAYER_T}, {DAYS_T}, {TEF_T}, sz(factor, size, correlation) AS ({' UNION ALL '.join(f"SELECT '{k}', {len(own)}, {_CORR(own)} FROM cr" for k, own in _SUBSETS.items())} UNION ALL SELECT '8', 0, 0 FROM cr),
fi AS (SELECT *, CASE WHEN size > 0 THEN {sql_fitness(complexity='abs(size - 5) / 5.0', correlation='correlation')} END AS fitness FROM sz LEFT JOIN ot USING (factor))"""
_SUB = ["rank_ic_mean", "long_short_ir", "coverage", "turnover", "overfit"]


@query(f"WITH {SUBSET_SQL} SELECT factor AS subset_id, size::BIGINT AS size, {r6(*_SUB)}, rank_ic_dates, round(correlation, 6) AS correlation, CASE WHEN size = 0 THEN 'empty_subset' END AS reason, round(fitness, 6) AS fitness, row_number() OVER (ORDER BY round(fitness, 9) DESC NULLS LAST, factor) AS place FROM fi")
def subset_scores(spark, sf_dir):
    names = list(FACTORS)
    masks = spark.createDataFrame([(k, f) for k in range(1, 8) for i, f in enumerate(names) if k >> i & 1] + [(8, None), (1, "unknown")], "subset_id int, factor string")
    return model.score_subsets(scored(spark, sf_dir), names, masks).select("subset_id", "size", *_SUB, "rank_ic_dates", "correlation", "reason", "fitness", "place")


@query(None)
def model_boosted(spark, sf_dir):
    frame, features = model.feature_matrix(scored(spark, sf_dir), list(FACTORS), "returns_1d")
    fitted = model.train_boosted(panel.segments(frame, RANGES), features, "returns_1d")
    return model.predict(fitted, panel.segments(frame, RANGES).filter("segment = 'test'")).select("datetime", "symbol", "score", "returns_1d")


@query(None)
def model_ridge(spark, sf_dir):
    frame, features = model.feature_matrix(scored(spark, sf_dir), list(FACTORS), "returns_1d")
    fitted = model.train_ridge(panel.segments(frame, RANGES), features, "returns_1d")
    return model.predict(fitted, panel.segments(frame, RANGES).filter("segment = 'test'")).select("datetime", "symbol", "score", "returns_1d")


@query(None)
def parameter_scores(spark, sf_dir):
    frame, features = model.feature_matrix(scored(spark, sf_dir), list(FACTORS), "returns_1d")
    grid = [{"leaves": 15, "depth": 3, "min_leaf": 50, "l1": 0.0, "l2": 1.0, "feature_share": 1.0}, {"leaves": 31, "depth": 4, "min_leaf": 20, "l1": 0.0, "l2": 0.0, "feature_share": 0.8}]
    return model.score_parameters(frame, features, "returns_1d", grid)
