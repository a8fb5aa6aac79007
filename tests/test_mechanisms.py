"""Quantiles by narrowing, streamed order statistics and blocked matrices against plain forms."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.functions.factor_functions import REGISTRY
from factorloom.functions.stats import SORTING, last_rows
from factorloom.operators import diagnostics, evaluate, factors, panel, preprocess, quantiles, rolling
from factorloom.operators.factors import with_factors

DAY = datetime(2024, 1, 1)


@pytest.mark.parametrize("few", [1, 7, 4096])
def test_quantiles_are_those_of_sorted_values(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = np.random.default_rng(2)
    groups = {
        "even": rng.random(500), "ties": rng.integers(0, 3, 400).astype(float), "one": np.full(300, 4.25), "single": np.array([7.0]), "two": np.array([1.0, 2.0]), "signs": rng.normal(size=401), "tiny": 10.0 ** rng.uniform(-300, -200, 300),
        "wide": np.concatenate([10.0 ** rng.uniform(-300, 300, 150), -(10.0 ** rng.uniform(-300, 300, 150)), [0.0, 0.0]]), "huge": np.array([1.7e308, -1.7e308, 1.6e308, 0.0, 5e-324]), "near": 1 + rng.integers(0, 50, 300) * 2.0**-52, None: rng.normal(size=60),
    }
    rows = [(g, float(v)) for g, own in groups.items() for v in own] + [("even", None), ("even", float("nan")), ("empty", None)]
    probabilities = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r["q"] for r in quantiles.exact_quantiles(df, ["g"], "v", probabilities).collect()}
    assert got.keys() == groups.keys()
    for g, own in groups.items():
        own = np.sort(own)
        for p, q in zip(probabilities, got[g], strict=True):
            h = p * (len(own) - 1)
            a, b = own[int(np.floor(h))], own[int(np.ceil(h))]
            with np.errstate(over="ignore"):
                assert q == a + (b - a) * (h - np.floor(h)) or (a == b == q), (g, p)
    assert quantiles.exact_quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0
    every = quantiles.exact_quantiles(df.filter("g = 'even'"), [], "v", [0.5]).first()["q"]
    assert every == [np.median(groups["even"])]


def test_no_task_sorts_a_group(spark, monkeypatch):
    """After the first round only the ranges that hold the ranks are read on."""
    monkeypatch.setattr(quantiles, "FEW", 50)
    df = spark.range(200_000).select(F.lit("g").alias("g"), (F.col("id") * 1.5).alias("v"))
    assert quantiles.exact_quantiles(df, ["g"], "v", [0.5]).first()["q"] == [1.5 * 199_999 / 2]


def test_clipping_needs_no_date_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 5)
    rng = np.random.default_rng(3)
    rows = [(DAY + timedelta(days=d), f"s{a}", float(rng.standard_t(2)), None if a % 7 == 0 else float(a % 3)) for d in range(4) for a in range(60)] + [(None, "x", 1.0, 2.0), (DAY + timedelta(days=9), "y", None, None)]
    df = spark.createDataFrame(rows, "datetime timestamp, symbol string, a double, b double")
    key = lambda r: (str(r["datetime"]), r["symbol"])
    one, two = (sorted(preprocess.winsorise(df, ["a", "b"], gather=g).collect(), key=key) for g in (True, False))
    assert one == two


@pytest.mark.parametrize(("groups", "by"), [(["g"], []), (["g"], ["x", "z"]), (["g", "h"], ["x"]), (["g", "h"], [])])
def test_groups_are_taken_off_as_by_dummy_variables(spark, groups, by):
    rng = np.random.default_rng(6)
    rows = []
    for d in range(3):
        for a in range(50):
            g, h = f"g{rng.integers(4)}", f"h{rng.integers(3)}"
            rows.append([DAY + timedelta(days=d), f"s{a}", None if a == 3 else g, h, float(rng.normal()), 1e6 * float(rng.normal()), float(rng.normal()) + len(g) * d, None if a == 7 else float(rng.normal() + int(g[1]) - 2 * int(h[1]))])
    rows += [[DAY + timedelta(days=9), "s", "g", "h", 1.0, 1.0, 1.0, 5.0]]
    df = spark.createDataFrame(rows, "datetime timestamp, symbol string, g string, h string, x double, z double, f double, k double").repartition(3)
    got = {(r["datetime"], r["symbol"]): r for r in preprocess.neutralise_groups(df, ["f", "k"], groups, by).collect()}
    assert len(got) == len(rows)
    at = {"g": 2, "h": 3, "x": 4, "z": 5, "f": 6, "k": 7}
    for d in range(3):
        for c in ("f", "k"):
            own = [r for r in rows if r[0] == DAY + timedelta(days=d)]
            good = [r for r in own if all(r[at[v]] is not None for v in [*groups, *by, c])]
            columns = [np.array([float(r[at[v]] == one) for r in good]) for v in groups for one in sorted({r[at[v]] for r in good})] + [np.array([r[at[v]] for r in good]) for v in by]
            y = np.array([r[at[c]] for r in good])
            m = np.column_stack(columns)
            m = m / np.maximum(np.abs(m).max(axis=0), 1e-300)
            want = y - m @ np.linalg.lstsq(m, y, rcond=None)[0]
            assert [got[r[0], r[1]][c] for r in good] == pytest.approx(want.tolist(), abs=1e-7)
            assert all(got[r[0], r[1]][c] is None for r in own if r not in good)
    assert got[DAY + timedelta(days=9), "s"]["f"] == (1.0 if len(by) + 2 > 1 else 0.0)


def panel_of(spark, n, assets=3, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(DAY + timedelta(hours=i), f"s{a}", None if rng.random() < 0.1 else float(rng.integers(0, 40)) if a else float(rng.normal()), "text") for a in range(assets) for i in range(n)] + [(DAY, "empty", None, "t"), (DAY, None, 2.0, "t"), (DAY + timedelta(hours=1), None, 1.0, "t")]
    return spark.createDataFrame(rows, "datetime timestamp, symbol string, x double, note string").repartition(4)


@pytest.mark.parametrize("p", [1, 2, 5, 64, 500])
def test_streamed_orders_are_those_of_windows(spark, p):
    df = panel_of(spark, 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)  # windows reach over batches
    try:
        got = rolling.rolling_orders(df, {"m": ("median", "x", p), "r": ("rank", "x", p)})
        window = F.collect_list("x").over(last_rows(p))
        less, equal = F.size(F.filter(window, lambda v: v < F.col("x"))), F.size(F.filter(window, lambda v: v == F.col("x")))
        want = df.withColumns({"m": F.percentile("x", 0.5).over(last_rows(p)), "r": F.when(F.col("x").isNotNull(), (less + (equal + 1) / 2) / F.size(window))})
        assert got.columns == [*df.columns, "m", "r"]
        key = lambda r: (str(r["symbol"]), r["datetime"])
        for a, b in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
            assert a["note"] == b["note"] and a["x"] == b["x"] and (a["m"], a["r"]) == pytest.approx((b["m"], b["r"])), (a, b)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_windows_of_expressions_are_streamed(spark, monkeypatch):
    df = panel_of(spark, 200)
    expressions = {"m": "TS_MEDIAN($x, 70)", "r": "RANK(TS_RANK($x + 1, 90)) - TS_MEAN($x, 3)", "k": "TS_RANK(TS_MEDIAN($x, p=64), p=65)", "inf": "TS_MEDIAN($x / 0, 64)"}
    got, failed = with_factors(df, expressions)
    assert not failed and "PythonMapInArrow" in (plan := got._jdf.queryExecution().executedPlan().toString()) or "MapInArrow" in plan
    monkeypatch.setattr(factors, "LONG_ORDER", 10**9)
    want, _ = with_factors(df, expressions)
    assert "MapInArrow" not in want._jdf.queryExecution().executedPlan().toString()
    key = lambda r: (str(r["symbol"]), r["datetime"])
    for a, b in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
        assert {k: a[k] for k in expressions} == pytest.approx({k: b[k] for k in expressions}), (a, b)


def test_own_functions_of_that_name_stay(spark, monkeypatch):
    monkeypatch.setitem(REGISTRY, "TS_MEDIAN", REGISTRY["TS_MEAN"])
    got, _ = with_factors(panel_of(spark, 5), {"m": "TS_MEDIAN($x, 100)"})
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()


def test_windows_of_ten_thousand_rows(spark):
    df = spark.range(25_000).select(F.timestamp_seconds(F.col("id") * 60).alias("datetime"), F.lit("s").alias("symbol"), (F.col("id") * 7919 % 25_013).cast("double").alias("x"))
    got, _ = with_factors(df, {"m": "TS_MEDIAN($x, 10000)", "r": "TS_RANK($x, 10000)"})
    x = np.arange(25_000) * 7919 % 25_013
    rows = {r["datetime"].timestamp(): (r["m"], r["r"]) for r in got.filter(F.unix_timestamp("datetime") % 60_000 == 0).collect()}
    assert len(rows) == 25
    for at, (m, r) in rows.items():
        i = int(at) // 60
        own = x[max(0, i - 9999) : i + 1]
        assert m == np.median(own) and r == pytest.approx(((own < x[i]).sum() + 1) / len(own))


@pytest.mark.parametrize("tile", [4, 128])
def test_blocked_correlations_are_those_of_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(diagnostics, "TILE", tile)
    rng = np.random.default_rng(4)
    n = 17
    base = rng.normal(size=(200, n)) + rng.normal(size=(200, 1))
    base[:, 3] = 5.0
    base[:, 4] = base[:, 5] * -3 + 1e6
    names = [f"f{i}" for i in range(n)]
    rows = [tuple(None if i == 6 or rng.random() < 0.1 else float(v) for i, v in enumerate(r)) for r in base]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(3)
    want = {(r["f1"], r["f2"]): r["corr"] for r in diagnostics.correlation_pairs(df, names, most=10_000).collect()}
    got = {(r["f1"], r["f2"]): r["corr"] for r in diagnostics.correlation_pairs(df, names, most=0).collect()}
    assert got.keys() == want.keys() and len(got) == n * (n - 1) // 2
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want), [(k, got[k], want[k]) for k in want if got[k] != pytest.approx(want[k], abs=1e-9)][:3]
    assert got["f4", "f5"] == pytest.approx(-1) and got["f0", "f3"] is None and got["f5", "f6"] is None


def test_a_thousand_factors(spark):
    names = [f"f{i}" for i in range(1000)]
    df = spark.range(40).select(*(F.when((F.col("id") + i) % 11 > 0, F.sin(F.col("id") * (i + 1) * 0.37)).alias(c) for i, c in enumerate(names)))
    found = diagnostics.correlation_pairs(df, names).agg(F.count("*").alias("n"), F.count("corr").alias("c"), F.max(F.abs("corr")).alias("m")).first()
    assert found["n"] == 499_500 and found["c"] == found["n"] and found["m"] <= 1 + 1e-9


def test_held_out_metrics_deal_rows_once(spark):
    """The calendar is no reason to deal the rows of all factors by date first, into as few tasks as their bytes ask for."""
    rows = [(datetime(2024, 1, 1 + i), s, float(i * k % 5), float(i + k)) for i in range(6) for k, s in enumerate("abc")]
    df = spark.createDataFrame(rows, "datetime timestamp, symbol string, x double, returns_1d double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = evaluate.daily_metrics(evaluate.long_frame(df, ["x"], "returns_1d"), panel.dates(df), 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [x for x in plan.split("Exchange hashpartitioning(")[1:] if x.startswith("factor")]
    assert "SortMergeJoin" not in plan and len(dealt) == 3 and f"{SORTING}), REPARTITION_BY_NUM" in plan  # by date, by asset, and the sums of days


def test_windows_across_dates_take_few_dates_a_task(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), "a", 1.0)], "datetime timestamp, symbol string, x double")
    out = preprocess.preprocess(with_factors(df, {"f": "ZSCORE(DELTA($x, 1))"})[0], ["f"])[0]
    plan = out._jdf.queryExecution().executedPlan().toString()
    by_date = [x for x in plan.split("Exchange hashpartitioning(")[1:] if x.startswith("datetime")]
    assert len(by_date) == 1 and f"{SORTING}), REPARTITION_BY_NUM" in plan


def test_quality_joins_no_factor_in_one_task(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1 + i), s, float(i + k), float(k)) for i in range(3) for k, s in enumerate("ab")], "datetime timestamp, symbol string, f double, units double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the table of spans were taken for a large one
    try:
        plan = diagnostics.factor_quality(df, ["f"], "units")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("BroadcastHashJoin") == 1


def test_subsets_stay_in_their_rows_until_they_are_summed_up(spark, monkeypatch):
    import random

    from factorloom.functions.stats import rank_pct, row_mean
    from factorloom.operators import model

    rng = random.Random(3)
    some = lambda x, share=0.2: None if rng.random() < share else x
    rows = [(datetime(2024, 1, 1 + d), f"a{a}", some(float(rng.randrange(4))), some(rng.random(), 0.5), some(round(rng.random(), 1))) for d in range(9) for a in range(12) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "datetime timestamp, symbol string, f1 double, f2 double, returns_1d double")
    masks = spark.createDataFrame([("x", "f1"), ("y", "f2"), ("z", "f1"), ("z", "f2"), ("e", None)], "subset_id string, factor string")
    ranked = df.withColumns({f: rank_pct(F.col(f)) for f in ("f1", "f2")})
    plain = ranked.select("datetime", "symbol", F.col("returns_1d").alias("target"), F.col("f1").alias("x"), F.col("f2").alias("y"), row_mean(F.col("f1"), F.col("f2")).alias("z"))
    calendar = panel.dates(df)
    want = evaluate.daily_metrics(plain.unpivot(["datetime", "symbol", "target"], ["x", "y", "z"], "factor", "value"), calendar, 5)
    read = lambda days: {(r["factor"], r["datetime"]): [None if r[c] is None else round(r[c], 9) for c in want.columns[2:]] for r in days.collect()}
    expected = read(want)
    assert len(expected) == 27 and any(v[-1] for v in expected.values())
    for block in (12, 2):
        monkeypatch.setattr(model, "BLOCK", block)
        assert read(model.subset_days(df, ["f1", "f2"], masks, "returns_1d", calendar)) == expected
    monkeypatch.undo()
    plan = model.score_subsets(df, ["f1", "f2"], masks)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan  # no row for each subset before the windows
