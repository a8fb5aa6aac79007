"""Rules on ties, missing values, gaps, partial windows and zero division, on panels written by hand."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factorloom.functions.factor_functions import register
from factorloom.functions import stats
from factorloom.functions.stats import compound, over_time, rank_pct
from factorloom.operators import diagnostics, evaluate, library, model, panel, preprocess, text
from factorloom.operators.factors import parse, reach, shape, with_factors

DAY = datetime(2024, 1, 1)


def make(spark, table, columns="x double"):
    """{symbol: [values by day]}; None is missing, ... is no row."""
    rows = [(DAY + timedelta(days=i), s, *(v if isinstance(v, tuple) else (v,))) for s, vs in table.items() for i, v in enumerate(vs) if v is not ...]
    return spark.createDataFrame(rows, f"datetime timestamp, symbol string, {columns}")


def values(df, name):
    return {(r["symbol"], (r["datetime"] - DAY).days): r[name] for r in df.collect()}


def factor(spark, table, expression, columns="x double"):
    out, failed = with_factors(make(spark, table, columns), {"f": expression})
    assert not failed
    return values(out, "f")


def test_rank_gives_ties_their_mean_and_skips_missing(spark):
    got = factor(spark, {"a": [1.0], "b": [2.0], "c": [2.0], "d": [None]}, "RANK($x)")
    assert got == {("a", 0): pytest.approx(1 / 3), ("b", 0): pytest.approx(2.5 / 3), ("c", 0): pytest.approx(2.5 / 3), ("d", 0): None}


def test_windows_count_rows_and_skip_missing(spark):
    got = factor(spark, {"a": [1.0, None, 3.0, ..., 5.0]}, "TS_MEAN($x, 2)")
    assert got == {("a", 0): 1.0, ("a", 1): 1.0, ("a", 2): 3.0, ("a", 4): 4.0}


def test_wma_doesnt_renormalise_partial_windows(spark):
    got = factor(spark, {"a": [1.0, 2.0, 3.0]}, "WMA($x, 3)")
    assert got == {("a", 0): pytest.approx(0.5), ("a", 1): pytest.approx(1 + 1 / 3), ("a", 2): pytest.approx(14 / 6)}


def test_pctchange_fills_forward(spark):
    assert factor(spark, {"a": [2.0, None, 3.0]}, "TS_PCTCHANGE($x, 1)") == {("a", 0): None, ("a", 1): 0.0, ("a", 2): 0.5}


def test_zero_division_is_missing_at_once(spark):
    got = factor(spark, {"a": [(1.0, 0.0)], "b": [(1.0, 2.0)]}, "RANK($x / $y)", "x double, y double")
    assert got == {("a", 0): None, ("b", 0): 1.0}


def test_two_argument_max_takes_numbers_and_keeps_missing(spark):
    assert factor(spark, {"a": [-1.0, None, 4.0]}, "MAX($x, 0)") == {("a", 0): 0.0, ("a", 1): None, ("a", 2): 4.0}


def test_constant_cross_section_has_no_zscore(spark):
    assert set(factor(spark, {"a": [1.0], "b": [1.0]}, "ZSCORE($x)").values()) == {None}


def test_ts_rank_and_corr(spark):
    assert factor(spark, {"a": [1.0, 3.0, 2.0]}, "TS_RANK($x, 3)")[("a", 2)] == pytest.approx(2 / 3)
    got = factor(spark, {"a": [(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)]}, "TS_CORR($x, $y, 3)", "x double, y double")
    assert got[("a", 0)] is None and got[("a", 2)] == pytest.approx(1.0)


def test_failures_are_reported_for_each_factor(spark):
    df = make(spark, {"a": [1.0, 2.0]})
    bad = {"unknown": "$y + 1", "function": "NOPE($x)", "syntax": "$x +", "ahead": "DELAY($x, -1)", "window": "TS_MEAN($x, 0)", "code": "__import__('os')", "text": "$x + 'a'"}
    out, failed = with_factors(df, {"good": "$x * 2", **bad})
    assert set(failed) == set(bad)
    assert values(out, "good") == {("a", 0): 2.0, ("a", 1): 4.0}


def test_levels_share_windows_and_shuffles(spark):
    df = make(spark, {s: [float(i) for i in range(5)] for s in "abc"})
    out, _ = with_factors(df, {f"f{k}": f"RANK(TS_MEAN($x, 3)) * {k} + ZSCORE(TS_STD($x, 2))" for k in range(1, 6)}, ["datetime", "symbol"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_user_functions(spark):
    register("TWICE", "row", 1)(lambda x: x * 2)
    assert factor(spark, {"a": [3.0]}, "TWICE($x)") == {("a", 0): 6.0}
    assert shape("RANK(TS_MEAN($x, 3)) + 1")[:3] == (6, 4, 2)
    assert parse("a$x + $x", ["x"]) is not None


def test_appending_rows_doesnt_change_factors(spark):
    df = make(spark, {"a": [1.0, 4.0, 2.0, 8.0, 3.0, 9.0], "b": [2.0, 1.0, 5.0, 3.0, 7.0, 1.0]})
    got = {r["factor"]: r["passed"] for r in diagnostics.look_ahead(df, {"good": "RANK(TS_MEAN($x, 3))", "filled": "TS_PCTCHANGE($x, 1)", "broken": "RANK($nothing)"}, cuts=2).collect()}
    assert got == {"good": True, "filled": True, "broken": False}
    register("_AHEAD", "asset", 1)(lambda x: F.lead(x, 1).over(over_time()))
    got = {r["factor"]: r["passed"] for r in diagnostics.look_ahead(df, {"bad": "_AHEAD($x)"}, cuts=2).collect()}
    assert got == {"bad": False}
    few = diagnostics.look_ahead(df, {"bad": "_AHEAD($x)"}, cuts=5).collect()
    assert [tuple(r) for r in few] == [("bad", None, True)]  # six dates are too few for five cuts
    assert diagnostics.look_ahead(df.filter("false"), {"good": "RANK($x)"}).first()["max_diff"] is None


def test_reach_of_expressions(spark):
    register("_NEXT", "asset", 1, 2, lambda p=1: (0, p))(lambda x, p=1: F.lead(x, int(p)).over(over_time()))
    register("_ALL", "asset", 1)(lambda x: F.avg(x).over(over_time().rowsBetween(-10, 10)))
    spans = {
        "$x + 1": [(0, 0)],
        "TS_MEAN(DELAY($x, 3), 4) - TS_STD($x)": [(6, 0)],
        "TS_MEAN(DELTA($x), p=2 + 2)": [(4, 0)],
        "RANK(TS_MEAN($x, 3)) + DELAY($x, 9)": [(9, 0), (2, 0)],
        "TS_SUM(RANK(TS_CORR($x, $x, 10)), 3) * ZSCORE($x)": [(2, 0), (9, 0)],
        "TS_PCTCHANGE($x, 2)": [(None, 0)],
        "RANK(_NEXT($x, 2))": [(0, 0), (0, 2)],
        "_ALL($x)": [(None, None)],
    }
    assert {e: reach(e, ["x"]) for e in spans} == spans
    assert reach("TS_MEAN($x, 3)", ["x"], (0, 1)) == [(2, 0), (0, 1)]


def scattered(spark):
    """Assets with gaps, one that ends early, one that begins late, and one with two rows far apart."""
    days = {"a": range(40), "b": [d for d in range(40) if d % 3], "c": range(15), "d": range(33, 40), "e": [2, 38], "f": [d for d in range(40) if d % 7 == 0]}
    return make(spark, {s: [float((i * 37 + ord(s) * 11) % 23) if i in own else ... for i in range(40)] for s, own in days.items()})


def whole_look_ahead(df, expressions, cuts):
    """The largest difference by plain recomputation of the whole panel for each cut."""
    names, worst = list(expressions), dict.fromkeys(expressions, 0.0)
    cells = lambda d: {(r["datetime"], r["symbol"]): r for r in with_factors(d, expressions)[0].collect()}
    full = cells(df)
    for end in sorted({t for t, _ in full})[-cuts - 1 : -1]:
        for key, r in cells(df.filter(F.col("datetime") <= F.lit(end))).items():
            for n in names:
                a, b = r[n], full[key][n]
                worst[n] = max(worst[n], float("inf") if (a is None) != (b is None) else abs((a or 0.0) - (b or 0.0)))
    return worst


def test_look_ahead_by_reach_equals_whole_recomputation(spark):
    register("_NEXT", "asset", 1, 2, lambda p=1: (0, p))(lambda x, p=1: F.lead(x, int(p), 5.0).over(over_time()))
    register("_ALL", "asset", 1)(lambda x: F.avg(x).over(over_time().rowsBetween(-10, 10)))
    df = scattered(spark)
    expressions = {
        "mean": "TS_MEAN($x, 3)", "deep": "RANK(TS_SUM(ZSCORE(DELAY($x, 2)), 4))", "filled": "TS_PCTCHANGE($x, 2)", "long": "TS_MEDIAN($x, 70)",
        "next": "_NEXT($x, 2)", "spread": "TS_MEAN(RANK(_NEXT($x, 3)), 2)", "twice": "_NEXT(MEAN(_NEXT($x, 2)), 2)", "all": "_ALL($x)",
    }
    got = {r["factor"]: r for r in diagnostics.look_ahead(df, expressions, least=1).collect()}
    worst = whole_look_ahead(df, expressions, 5)
    assert {n: r["max_diff"] for n, r in got.items()} == pytest.approx(worst, abs=1e-12)
    assert {n for n, r in got.items() if not r["passed"]} == {"next", "spread", "twice", "all"} == {n for n, d in worst.items() if d > 1e-8}


def test_look_ahead_reads_only_the_rows_in_reach(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(diagnostics, "written", lambda d, label, keep=diagnostics.written: seen.setdefault(label, keep(d, label)))
    df = make(spark, {s: [float((i * 7 + ord(s)) % 13) for i in range(200)] for s in "abc"})
    assert diagnostics.look_ahead(df, {"good": "RANK(TS_MEAN($x, 4))"}).first()["passed"]
    # the last date, five cuts, five dates compared at the first of them, and three rows before these
    assert seen["tail"].count() == 3 * (1 + 5 + 4 + 3)


def test_turnover_needs_adjacent_dates(spark):
    df = make(spark, {"a": [1.0, 2.0, 1.0], "b": [2.0, ..., 2.0], "c": [3.0, 1.0, 3.0]})
    long = evaluate.long_frame(df.withColumn("returns_1d", F.lit(0.0)), ["x"], "returns_1d")
    got = evaluate.turnover(long, panel.dates(df)).first()["turnover"]
    # day 1: a 1/3 -> 1, c 1 -> 1/2; day 2: a 1 -> 1/3, c 1/2 -> 1; b was absent the day before
    assert got == pytest.approx(((2 / 3 + 1 / 2) / 2 + (2 / 3 + 1 / 2) / 2) / 2)


def test_layers_partition_rows_and_ic_is_bounded(spark):
    df = make(spark, {s: [(float(i * k % 7), float((i + k) % 5)) for i in range(6)] for k, s in enumerate("abcdefgh", 1)}, "x double, returns_1d double")
    long = evaluate.long_frame(df, ["x"], "returns_1d")
    assert evaluate.layers(long).count() == 48
    assert all(abs(r["ic"]) <= 1 + 1e-12 for r in evaluate.daily_ic(long, "spearman").collect())


def test_an_empty_factor_fails_the_screen(spark):
    df = make(spark, {s: [(float(i * k % 7), None, float(i * k % 7) / 100) for i in range(8)] for k, s in enumerate("abcdef", 1)}, "good double, empty double, returns_1d double")
    got = {r["factor"]: (r["passed"], r["reason"]) for r in evaluate.screen(df, ["good", "empty"]).collect()}
    assert got == {"good": (True, "passed"), "empty": (False, "too_few_valid_dates")}


def test_winsorise_leaves_values_where_mad_is_zero(spark):
    df = make(spark, {"a": [1.0, 1.0], "b": [1.0, 2.0], "c": [1.0, 3.0], "d": [9.0, 900.0]})
    got = values(preprocess.winsorise(df, ["x"]), "x")
    assert got[("d", 0)] == 9.0 and got[("d", 1)] < 900


def test_neutralise_needs_three_rows_and_agrees_with_many(spark):
    df = make(spark, {"a": [(1.0, 1.0), (1.0, 2.0)], "b": [(3.0, 2.0), (5.0, 1.0)], "c": [(4.0, 4.0), ...]}, "x double, y double")
    one, many = values(preprocess.neutralise(df, ["x"], "y"), "x"), values(preprocess.neutralise_many(df, ["x"], ["y"]), "x")
    assert one[("a", 1)] == 1.0 and many[("a", 1)] == 1.0
    assert all(one[k] == pytest.approx(many[k]) for k in one)
    assert sum(one[(s, 0)] for s in "abc") == pytest.approx(0)


def test_preprocess_warns_of_missing_columns(spark):
    df = make(spark, {"a": [1.0, None], "b": [5.0, 2.0], "c": [3.0, 4.0]})
    out, report, notes = preprocess.preprocess(df, ["x"], neutralise_by=["market_cap"])
    assert notes == ["missing_neutralizer:market_cap"] and out.filter("x is null").count() == 0
    assert report.first()["missing_before"] == pytest.approx(1 / 6)


def test_panel_normalises_keys_and_infinity(spark):
    raw = spark.createDataFrame([(DAY, "A", float("inf"), 1), (DAY, "B", float("nan"), 2)], "datetime timestamp, instrument string, x double, n int")
    df = panel.normalise(raw)
    assert df.columns == ["datetime", "symbol", "x", "n"] and df.filter("x is null").count() == 2
    with pytest.raises(ValueError):
        panel.normalise(raw, strict=True)


def test_compound_with_a_total_loss(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame([(i, r) for i, r in enumerate([0.5, -3.0, None, -1.0, 0.2])], "i int, r double")
    w = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    got = [r["c"] for r in df.withColumn("c", compound(F.col("r"), w)).orderBy("i").collect()]
    assert got == [pytest.approx(1.5), pytest.approx(-3.0), pytest.approx(-3.0), 0.0, 0.0]


def test_rank_pct_of_an_empty_group(spark):
    assert spark.createDataFrame([], "datetime timestamp, x double").withColumn("r", rank_pct(F.col("x"))).count() == 0


def test_text_before_the_first_bar_goes_and_after_the_last_stays(spark):
    bars = make(spark, {"A": [1.0, ..., 3.0]})
    rec = spark.createDataFrame([(DAY - timedelta(hours=1), "A"), (DAY + timedelta(days=1, hours=5), "A"), (DAY + timedelta(days=90), "*"), (DAY, "nope")], "timestamp timestamp, symbol string")
    got = {(r["timestamp"], r["datetime"]) for r in text.align_to_bars(rec, bars).collect()}
    assert got == {(DAY + timedelta(days=1, hours=5), DAY), (DAY + timedelta(days=90), DAY + timedelta(days=2)), (DAY, DAY)}
    assert {r["symbol"] for r in text.unknown_symbols(rec, bars).collect()} == {"nope"}


def test_market_wide_text_reaches_every_symbol(spark):
    df = make(spark, {s: [1.0] for s in "abc"})
    rec = spark.createDataFrame([(DAY, "*", "hack", "no growth, growth"), (DAY, "a", None, "open interest")], "timestamp timestamp, symbol string, title string, body string")
    got = {r["symbol"]: (r["news_count"], r["news_sentiment_score"], r["risk_event_count"], r["liquidity_event_score"]) for r in text.text_features(rec, df).collect()}
    assert got == {"A": (2.0, 0.0, 1.0, 1.0), "B": (1.0, 0.0, 1.0, 0.0), "C": (1.0, 0.0, 1.0, 0.0)}


def test_merging_again_changes_nothing(spark):
    cols = "source_file string, chunk_id int, timestamp string, symbol string, title string, body string, url string"
    old = spark.createDataFrame([("f1", 0, "t", "A", "x", "b", None), ("f2", 0, "t", "A", "x", "b", None)], cols)
    new = spark.createDataFrame([("f1", 0, "t", "A", "y", "b", None), ("f1", 0, "t", "a", "y", "b", None)], cols)
    once, counts = text.merge_records(old, new)
    assert once.count() == 2 and counts.first()["duplicates"] == 1
    twice, _ = text.merge_records(once, new)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_reports(spark):
    files = [("/r/a_2024-05-23.md", "# Big ETF note\n\nDated 2024-05-20\nBTC and ETHUSDT rise"), ("/r/b20240102.txt", "Nothing here"), ("/r/c.html", "<html><title>T</title><p>btc &amp; more</p><script>ETHUSDT</script></html>"), ("/r/late.txt", "x" * 9000 + " BTC")]
    rep = spark.createDataFrame([(f, DAY, t) for f, t in files], "source_file string, modified timestamp, text string")
    names = spark.createDataFrame([("BTCUSDT",), ("ETHUSDT",)], "symbol string")
    got = {(r["source_file"][-6:], r["symbol"], r["confidence"]) for r in text.report_records(rep, names).collect()}
    assert got == {("-23.md", "BTCUSDT", 0.72), ("-23.md", "ETHUSDT", 0.72), ("02.txt", "*", 0.48), ("c.html", "BTCUSDT", 0.72), ("te.txt", "*", 0.48)}
    when = {r["source_file"][-6:]: (r["timestamp"], r["title"]) for r in text.report_records(rep, names).collect()}
    assert when["-23.md"] == (datetime(2024, 5, 20), "Big ETF note") and when["02.txt"][0] == datetime(2024, 1, 2)


def test_chunks(spark):
    def one(t, n=10):
        return spark.createDataFrame([(t,)], "t string").select(text.chunks_of(F.col("t"), n)).first()[0]

    assert one("aaa\n\nbbb\n\ncccccc") == ["aaa\n\nbbb", "cccccc"]
    assert one("a" * 25) == ["a" * 10, "a" * 10, "a" * 5]
    assert one("x\n\n" + "a" * 12) == ["x", "a" * 10, "aa"]
    assert one("") == []


def test_symbol_mapping(spark):
    names = spark.createDataFrame([("BTCUSDT",), ("600519.SH",)], "symbol string")
    raw = spark.createDataFrame([(x,) for x in ("btcusdt", "BTC-USDT", "btc", "600519", "sh", "none", "", None)], "raw string")
    got = {r["raw"]: r["symbol"] for r in text.map_symbols(raw, text.default_aliases(names), names).collect()}
    assert got == {"btcusdt": "BTCUSDT", "BTC-USDT": "BTCUSDT", "btc": "BTCUSDT", "600519": "600519.SH", "sh": "600519.SH", "none": "*", "": None, None: None}


def test_expression_rules(spark):
    df = spark.createDataFrame([(e,) for e in ("TS_MEAN($close, 1) + TS_STD($volume, 999)", "ZSCORE(ZSCORE($close))", "$close / ($low - $low + 1e-08)", "RANK(TS_MEAN(RANK($close), 200))", "RANK($close)", "", None, "IF($close, 1)", "$close > 1")], "factor_expression string")
    cols = ["close", "low", "volume"]
    rules = {r[0]: r[1] for r in library.rule_check(df, cols).collect()}
    assert rules["TS_MEAN($close, 1) + TS_STD($volume, 999)"] == "window_too_small" and rules["RANK(TS_MEAN(RANK($close), 200))"] == "window_too_large"
    assert rules["RANK($close)"] is None and rules[""] == rules[None] == "empty" and rules["IF($close, 1)"] == "condition" and rules["$close > 1"] == "comparison"
    bad = {r[0]: r[1] for r in library.candidate_check(df, cols).collect()}
    assert bad["ZSCORE(ZSCORE($close))"] == "recursive_normalization" and bad["$close / ($low - $low + 1e-08)"] == "degenerate_self_operation" and bad["RANK($close)"] is None
    fixed = {r[0]: r[1] for r in df.select("factor_expression", library.repair_windows("factor_expression")).collect()}
    assert fixed["TS_MEAN($close, 1) + TS_STD($volume, 999)"] == "TS_MEAN($close, 2) + TS_STD($volume, 120)" and fixed["RANK(TS_MEAN(RANK($close), 200))"] == "RANK(TS_MEAN(RANK($close), 120))"


def test_common_subtrees_ignore_the_order_of_sums(spark):
    a = spark.createDataFrame([("RANK($a + $b * 2)",)], "factor_expression string")
    b = spark.createDataFrame([("ZSCORE(2 * $b + $a)",), ("$a",)], "factor_expression string")
    assert library.largest_common_subtree(a, b).first()["size"] == 5


def test_chunks_lose_white_space_of_all_kinds(spark):
    df = spark.createDataFrame([("\ta \n\n\n b\n\n \x0b\n\n\x1fc",)], "t string")
    assert df.select(text.chunks_of("t", 1)).first()[0] == ["a", "b", "c"]


def test_pairs_are_found_by_pattern_without_a_universe(spark):
    reports = spark.createDataFrame([("a", "Buy btcusdt and ETHUSD, not XUSDT or AUSDTX.\n" + "line\n" * 80 + "SOLUSDT"), ("b", "nothing"), ("c", None)], "source_file string, text string")
    none = spark.createDataFrame([], "symbol string")
    assert sorted((r["source_file"], r["symbol"]) for r in text.detect_symbols(reports, none).collect()) == [("a", "BTCUSDT"), ("a", "ETHUSD"), ("b", "*"), ("c", "*")]


def test_bars_are_handed_on_over_tasks(spark):
    """Many bars a second, records of one time in several tasks, times before the first bar, none and odd columns."""
    bars = spark.range(5000).select(F.timestamp_millis(F.col("id") * 7 + 1000).alias("datetime"))
    rec = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.timestamp_millis(F.lit(20_000))).when(F.col("id") % 50 == 1, None).otherwise(F.timestamp_millis(F.col("id") * 20)).alias("timestamp"), F.array(F.lit("x")).alias("extra")).repartition(5)
    got = {r["id"]: r for r in text.align_to_bars(rec, bars).collect()}
    for i in range(3000):
        at = None if i % 50 == 1 and i % 3 else 20_000 if i % 3 == 0 else i * 20
        if at is None or at < 1000:
            assert i not in got
        else:
            assert round(got[i]["datetime"].timestamp() * 1000) == 1000 + min((at - 1000) // 7, 4999) * 7 and got[i]["extra"] == ["x"]
    assert text.align_to_bars(rec, bars.limit(0)).count() == 0 and text.align_to_bars(rec.limit(0), bars).count() == 0


def test_missing_metrics_are_the_low_end(spark):
    row = spark.createDataFrame([(None, 0.4, float("nan"), float("inf"), 3.0, -1.0)], "a double, b double, c double, d double, e double, f double")
    got = row.select(*(stats.bounded(F.col(c)).alias(c) for c in "abcdef"), stats.abs_score(F.col("a"), 0.05).alias("g"), stats.abs_score(F.col("f"), 2.0).alias("h")).first()
    assert tuple(got) == (0.0, 0.4, 0.0, 0.0, 1.0, 0.0, 0.0, 0.5)
    metrics = spark.createDataFrame([("none", None, None, None), ("some", 0.01, 0.1, 0.5)], "factor string, rank_ic_mean double, rank_ic_ir double, turnover double")
    fit = {r["factor"]: r["fitness"] for r in evaluate.fitness(metrics).collect()}
    # 0.35 * 0.2 + 0.25 * 0.1 / 1.5 - 0.1 * 0.5
    assert fit["none"] == 0.0 and fit["some"] == pytest.approx(0.07 + 0.25 / 15 - 0.05)


def test_held_out_metrics_worked_by_hand(spark):
    """Ten dates, three assets: f follows the return on the first seven dates and is its opposite on the last three; g has values on
    the first dates only, so that all its pairs count; h has none."""
    table = {s: [(float(k + d), float(k if d < 7 else -k), float(k) if d < 4 else None, None, float(k) / 100) for d in range(10)] for k, s in enumerate("abc", 1)}
    df = make(spark, table, "x double, f double, g double, h double, returns_1d double")
    got = {r["factor"]: r for r in evaluate.fitness(evaluate.train_eval_metrics(df, ["f", "g", "h"])).collect()}
    f, g, h = got["f"], got["g"], got["h"]
    assert (f["train_rank_ic"], f["rank_ic_mean"], f["overfit"], f["coverage"], f["rank_ic_dates"]) == pytest.approx((1.0, -1.0, 1.0, 1.0, 3))
    assert (f["long_short_mean"], f["long_short_positive"], f["long_short_ir"]) == (0.0, 0.0, 0.0)  # three assets leave the first of five layers empty
    assert f["turnover"] == pytest.approx((2 / 3 * 2 / 3) / 9)  # two assets change by two thirds on one of nine days
    assert (g["coverage"], g["rank_ic_mean"], g["rank_ic_dates"], g["overfit"], g["turnover"]) == pytest.approx((0.4, 1.0, 4, 0.0, 0.0))
    assert (h["coverage"], h["rank_ic_mean"], h["overfit"], h["turnover"], h["ic_ir"]) == (0.0, 0.0, 1.0, 1.0, 0.0)
    assert h["fitness"] == pytest.approx(-0.2) and h["fitness"] == min(r["fitness"] for r in got.values())


def test_reports_count_days_without_groups(spark):
    """Three assets a day: no one is in the lowest fifth, so that all days return 0 and nothing is lost; without pairs all is lost."""
    df = make(spark, {s: [(float(k), None, float(k * d) / 100) for d in range(4)] for k, s in enumerate("abc", 1)}, "f double, none double, returns_1d double")
    some, none = evaluate.evaluation_report(df, "f").first(), evaluate.evaluation_report(df, "none").first()
    assert (some["annual_return"], some["max_drawdown"], some["status"]) == (0.0, 0.0, "finished") and some["sharpe"] == some["ic_ir"] == some["information_ratio"]
    assert some["layer_5_mean_return"] == pytest.approx(0.045) and some["layer_1_mean_return"] is None
    assert (none["ic_mean"], none["sharpe"], none["max_drawdown"], none["status"], none["annual_return"]) == (0.0, 0.0, 1.0, "partial", None)
    assert evaluate.evaluation_report(df, "f", failed=1).first()["status"] == "partial" and evaluate.evaluation_report(df, "f", selected=0).first()["status"] == "failed"


def test_positive_share_is_of_all_days_with_pairs(spark):
    """Two of four days have an IC above 0; one has equal scores and one only two pairs."""
    table = {s: [(float(k), float(k)), (float(k), float(k)), (1.0, float(k)), (float(k) if k < 3 else None, float(k))] for k, s in enumerate("abcd", 1)}
    got = evaluate.signal_analysis(make(spark, table, "f double, returns_1d double"), "f", "returns_1d").first()
    assert (got["ic_positive"], got["rank_ic_positive"], got["ic_dates"]) == (0.5, 0.5, 2)


def test_populations_are_repaired_checked_and_distinct(spark):
    df = make(spark, {s: [(float(i * k % 7), float(i * k % 7) / 100) for i in range(9)] for k, s in enumerate("abcdef", 1)}, "close double, returns_1d double")
    rows = [("good", "0 - $close"), ("late", " 0-$close "), ("window", "TS_MEAN($close, 1)"), ("self", "$close - $close + ($close - $close)"), ("long", " + ".join(["$close"] * 25)), ("unknown", "FOO($close)"), ("nothing", "$close / 0")]
    got = {r["factor_name"]: r for r in model.score_population(df, spark.createDataFrame(rows, "factor_name string, factor_expression string")).collect()}
    assert {k: (r["status"], r["reason"]) for k, r in got.items()} == {
        "good": ("evaluated", None), "late": ("duplicate", "duplicate_expression"), "window": ("evaluated", None), "self": ("rejected", "degenerate_self_operation"), "long": ("rejected", "expression_too_many_nodes"), "unknown": ("rejected", "unknown_function:FOO"), "nothing": ("evaluated", None),
    }
    assert got["window"]["factor_expression"] == "TS_MEAN($close, 2)" and got["good"]["complexity"] == 6 / 40  # expression, operation, minus, number, name, reading of the name
    assert [*got][-4:] == ["late", "long", "self", "unknown"] and got["nothing"]["fitness"] < got["good"]["fitness"]


def test_subsets_and_fitness(spark):
    df = make(spark, {s: [(float(i * k % 7), float(-i * k % 7), float(i * k % 7) / 100) for i in range(9)] for k, s in enumerate("abcdef", 1)}, "f1 double, f2 double, returns_1d double")
    masks = spark.createDataFrame([(1, "f1"), (2, "f1"), (2, "f2"), (3, None), (4, "other")], "subset_id int, factor string")
    got = {r["subset_id"]: r for r in model.score_subsets(df, ["f1", "f2"], masks).collect()}
    assert got["1"]["fitness"] > got["2"]["fitness"] and got["1"]["correlation"] == 0
    assert [got[k]["complexity"] for k in "12"] == [0.8, 0.6]  # |1 - 5| / 5 and |2 - 5| / 5
    assert [(got[k]["reason"], got[k]["fitness"], got[k]["place"]) for k in "34"] == [("empty_subset", None, 3), ("empty_subset", None, 4)]


def test_segments_and_policy(spark):
    df = make(spark, {"a": [1.0, 2.0, 3.0, 4.0]})
    assert [r["segment"] for r in panel.split_by_fraction(df, 0.5).orderBy("datetime").collect()] == ["train", "train", "valid", "valid"]
    assert {r["segment"] for r in panel.split_by_fraction(df, 1.0).collect()} == {"both"}
    policy = preprocess.choose_policy(["close", "Sector", "total_mv", "market_cap ", "industry"], {"profit": "from the Annual statement", "f10_size": "", "momentum": "of five days"})
    assert policy["neutralise_by"] == ["market_cap", "total_mv", "industry", "sector"] and policy["neutralise"]
    assert policy["fill"] == {"profit": "quarterly", "f10_size": "quarterly", "momentum": "daily"}
    assert not preprocess.choose_policy(["close"])["neutralise"] and not preprocess.choose_policy(["close"])["fill_forward"]
    got, _ = preprocess.preprocess_by_policy(make(spark, {"a": [1.0, None, 3.0], "b": [None, 2.0, None]}), {"x": ""})
    assert values(got, "x") == {("a", 0): 1.0, ("a", 1): 1.0, ("a", 2): 3.0, ("b", 0): None, ("b", 1): 2.0, ("b", 2): 2.0}
    assert library.resolve_signal_columns("RANK(close / Vol)", ["close", "volume"], {"vol": "volume"}) == ["close", "volume"]


def test_groups_are_sorted_once_and_dealt(spark):
    """Places in both directions and the ranks of all rows and of pairs come from one order; groups go to many tasks whatever their bytes."""
    from factorloom.functions.stats import SORTING, places
    from factorloom.operators import diagnostics, evaluate

    rows = [(f, d, f"s{(i * 7) % 23:02}", None if i % 6 == 0 else float((i * i + d) % 5), None if i % 7 == 3 else float((i * 3 + d) % 11)) for f in ("a", "b") for d in range(4) for i in range(23)]
    long = spark.createDataFrame(rows, "factor string, d int, symbol string, value double, target double").selectExpr("factor", "timestamp_seconds(d * 86400) AS datetime", "symbol", "value", "target")
    found = long
    for k, v in places(F.col("value"), "factor", "datetime").items():
        found = found.withColumn(k, v)
    for r in found.filter("value is not null").collect():
        own = [x for x in rows if x[0] == r["factor"] and x[1] == r["datetime"].day - 1 and x[3] is not None]
        assert r["size"] == len(own) and r["upto"] == sum(x[3] <= r["value"] for x in own) and r["peers"] == sum(x[3] == r["value"] for x in own)
        assert r["rising"] == sum((x[3], x[2]) <= (r["value"], r["symbol"]) for x in own) and r["falling"] == sum((-x[3], x[2]) <= (-r["value"], r["symbol"]) for x in own)
    days = evaluate.daily_metrics(long, evaluate.dates(long), 5)
    for df, sorts in ((days, 6), (evaluate.daily_metrics(long, None, 0, 3, 0.2, by_rank=False), 2), (diagnostics.set_turnover(long), 3)):  # of days: four for the calendar's join, its numbers, and changes by asset
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert f", {SORTING})" in plan and len([x for x in plan.splitlines() if "- Sort [" in x or "+ Sort [" in x]) <= sorts, plan
