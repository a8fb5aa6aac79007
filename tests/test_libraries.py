"""Library, backtest and report operators on small tables."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import diagnostics, evaluate, library, model, panel, text

DAY = datetime(2024, 1, 1)
LIB = "run_id string, loop_round int, intra_loop_index int, factor_name string, factor_expression string, factor_file string, metrics map<string,string>, source string, hypothesis string"


def lib(spark, *rows):
    return spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], None, {"IC": str(r[5]), "Sharpe": str(r[5] * 10), "Rank IC": str(r[5])}, "evolution" if r[2] % 2 else "mining", "h") for r in rows], LIB)


def test_metrics_join_names_without_case_and_fall_back_to_the_round(spark):
    impl = spark.createDataFrame([("Alpha", 1), ("beta", 2), ("gamma", 3)], "factor_name string, loop_round int")
    own = spark.createDataFrame([("ALPHA", {"IC": 1.0})], "factor_name string, metrics map<string,double>")
    rounds = spark.createDataFrame([(1, {"IC": 9.0}), (2, {"IC": 2.0})], "loop_round int, metrics map<string,double>")
    got = {r["factor_name"]: r["metrics"] for r in library.join_metrics(impl, own, rounds).collect()}
    assert got == {"Alpha": {"IC": 1.0}, "beta": {"IC": 2.0}, "gamma": None}


def test_rebuild_and_snapshot(spark):
    logs = spark.createDataFrame([("r", 1, 0, "a", "$x", {"IC": 0.01}, False), ("r", 1, 1, "A", "$y", {"IC": 0.02}, False), ("r", 1, 2, "b", "$z", {"IC": 0.001}, False), ("r", 1, 3, "c", "$w", {"IC": 0.5}, True), ("r", 2, 0, "d", "$known", {"IC": 0.5}, None)], "run_id string, loop_round int, intra_loop_index int, factor_name string, factor_expression string, metrics map<string,double>, rejected boolean")
    stored = lib(spark, ("r", 0, 0, "k", "$ known", 0.3), ("r", 0, 1, "e", "$e", -0.9))
    assert [r["factor_name"] for r in library.rebuild(logs, stored).collect()] == ["a"]
    events = spark.createDataFrame([("n", "r", DAY, "why", "$x")], "name string, run_id string, timestamp timestamp, reason string, expression string")
    snap = library.knowledge_snapshot(stored, events)
    assert [r["factor_name"] for r in snap["top_factors"].collect()] == ["e", "k"] and [r["factor_name"] for r in snap["top_evolved"].collect()] == ["e"]
    assert snap["failures"].count() == 3 and library.discovery_log(stored).first()["factor_name"] == "k"


def test_rankings(spark):
    runs = spark.createDataFrame([("t1", "a", {"IC": "0.1"}), ("t2", "a", {"Rank IC": "0.3"}), ("t3", "b", {})], "trajectory_id string, phase string, metrics map<string,string>")
    assert [r["trajectory_id"] for r in library.best_trajectories(runs, 2).collect()] == ["t2", "t1"]
    pages = spark.createDataFrame([("| name | ic |\n|---|---|\n| [alpha one](x.md) | 1 |\n| beta | 2 |",)], "text string")
    assert [r["name"] for r in library.markdown_names(pages).collect()] == ["name", "alpha one", "beta"]
    assert spark.range(1).select(library.ordered_union(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("c"))).alias("x")).first()["x"] == ["b", "a", "c"]


def test_rounds_name_the_larger_side(spark):
    """Worked by hand: equal goes to the baseline, a side without a value loses, a metric without any is left out."""
    rounds = spark.createDataFrame([(1, True, 0.1, 5.0, None, 1.0, None), (2, False, 9.9, 9.0, 1.0, 1.0, 1.0), (3, True, 0.2, 4.0, None, 2.0, None), (4, False, 0.3, 4.0, 7.0, None, None)], "round int, accepted boolean, ic double, sharpe double, icir double, calmar double, odd double")
    got = {r["metric"]: (r["current"], r["best"], r["larger"]) for r in evaluate.compare_rounds(rounds, ["ic", "sharpe", "icir", "calmar", "odd"]).collect()}
    assert got == {"ic": (0.3, 0.2, "current"), "sharpe": (4.0, 4.0, "best"), "icir": (7.0, None, "current"), "calmar": (None, 2.0, "best")}
    first = evaluate.compare_rounds(rounds.filter("round = 1"), ["ic"]).first()
    assert (first["best"], first["larger"]) == (None, "current")


def test_derived_and_default_metrics(spark):
    m = evaluate.derived_metrics(spark.createDataFrame([(-0.1, -0.7, 0.5, -0.25, -1.5)], "ic_mean double, ic_ir double, annual_return double, max_drawdown double, sharpe double")).first()
    assert (m["ic_mean_abs"], m["ic_mean_sign"], m["calmar"], m["ic_ir_abs"], m["sharpe_abs"]) == (0.1, -1.0, 2.0, 0.7, 1.5) and "rank_ic_mean_abs" not in m
    rows = [(4, 3, 1), (0, 0, 0), (None, None, None), (10, 0, 10), (2, 9, None)]
    d = evaluate.default_metrics(spark.createDataFrame(rows, "total int, generated int, failed int")).collect()
    # 0.9 * 0.75 - 0.2 * 0.25, 0.18 + 0.27 * 0.25, 0.1 + 0.25 * 0.25, ...
    assert [(r["sharpe"], r["turnover"], r["drawdown"], r["coverage"]) for r in d] == [(0.625, 0.248, 0.163, 0.75), (0.0, 1.0, 1.0, 0.0), (0.0, 1.0, 1.0, 0.0), (-0.2, 0.45, 0.35, 0.0), (0.9, 0.18, 0.1, 1.0)]


def small_panel(spark, days=60, assets=12):
    rows = [(DAY + timedelta(days=d), f"s{a:02d}", 10.0 + (a * 7 + d * 3) % 11 + a * 0.1, float((a * d) % 13 + 1)) for d in range(days) for a in range(assets)]
    return spark.createDataFrame(rows, "datetime timestamp, symbol string, close double, volume double")


RANGES = {"train": ("2024-01-01", "2024-01-31"), "valid": ("2024-02-01", "2024-02-10"), "test": ("2024-02-11", "2024-03-30")}


def test_backtest_runs_or_says_where_it_stopped(spark):
    df = small_panel(spark)
    rows = [("r", 0, i, n, e, 0.1) for i, (n, e) in enumerate({"rev": "0 - $close", "REV": "0-$close", "mom": "$close / DELAY($close, 3)", "vol": "TS_MEAN($volume, 3)", "bad": "$none"}.items())]
    assert model.library_backtest(df, lib(spark, *rows), RANGES)["step"] == "load"
    assert model.library_backtest(df, lib(spark, *rows), RANGES, min_factors=4)["step"] == "evaluate"
    assert model.library_backtest(df, lib(spark, *rows), RANGES, min_factors=2, min_ic=5)["step"] == "screen"
    done = model.library_backtest(df, lib(spark, *rows), RANGES, min_factors=1, min_ic=0.0, min_icir=0.0, rounds=2)
    assert done["status"] == "done" and done["predictions"].count() > 0 and done["analysis"].count() == 1 and done["importance"].count() == len(done["features"])


def test_batches_change_nothing(spark):
    df = panel.with_label(small_panel(spark))
    rows = [("rev", "0 - $close"), ("mom", "$close / DELAY($close, 3)"), ("vol", "TS_MEAN($volume, 3)"), ("bad", "$none"), ("rank", "RANK($volume)")]
    candidates = spark.createDataFrame(rows, "factor_name string, factor_expression string")
    few, many = ([(r["factor_name"], r["status"], None if r["fitness"] is None else round(r["fitness"], 9)) for r in model.score_population(df, candidates, batch=n).collect()] for n in (2, 100))
    assert few == many and [r[0] for r in few][-1] == "bad"
    lib_rows = [("r", 0, i, n, e, 0.1) for i, (n, e) in enumerate(rows)]
    a, b = (model.library_backtest(df, lib(spark, *lib_rows), RANGES, min_factors=1, min_ic=0.0, min_icir=0.0, rounds=2, batch=n) for n in (2, 100))
    assert a["features"] == b["features"] and a["analysis"].first()["rank_ic_mean"] == pytest.approx(b["analysis"].first()["rank_ic_mean"])
    assert model.score_population(df, candidates.filter("factor_name = 'bad'")).first()["status"] == "rejected"


def test_training_is_reproducible(spark):
    from factorloom.operators.factors import with_factors

    df = panel.segments(panel.with_label(small_panel(spark)), RANGES)
    frame, features = model.feature_matrix(with_factors(df, {"a": "$close", "b": "TS_MEAN($volume, 3)", "empty": "$close / 0"})[0], ["a", "b", "empty"], "returns_1d")
    assert features == ["a", "b"]
    frame = panel.segments(frame, RANGES)
    scores = [sorted(r["score"] for r in model.predict(model.train_boosted(frame, features, "returns_1d", rounds=3), frame).collect()) for _ in range(2)]
    assert scores[0] == pytest.approx(scores[1])
    ridge = model.train_ridge(frame, features, "returns_1d")
    assert model.importances(ridge, features, spark).count() == 2


def test_portfolio_and_fallback(spark):
    daily = spark.createDataFrame([(DAY + timedelta(days=i), r, 0.0, 0.0) for i, r in enumerate([0.1, -0.2, -0.1, 0.3])], "datetime timestamp, ret double, bench double, cost double")
    s = diagnostics.portfolio_summary(diagnostics.portfolio_report(daily)).first()
    assert s["max_drawdown"] == pytest.approx(-0.3) and (s["drawdown_start"], s["drawdown_end"]) == (DAY, DAY + timedelta(days=2))
    df = library.fallback_signal(small_panel(spark, 2, 3), ["close", "volume"])
    assert df.filter("signal between 0 and 1").count() == 6


def test_manifests(spark):
    old = spark.createDataFrame([("f", 1, "ingested", None), ("g", 0, "skipped", "no_records")], "source_file string, records long, status string, reason string")
    new = spark.createDataFrame([("g", 2, "ingested", None)], old.schema)
    got = {r["source_file"]: r["records"] for r in text.merge_manifests(old, new).collect()}
    assert got == {"f": 1, "g": 2}
    files = spark.createDataFrame([("f",), ("h",)], "source_file string")
    assert {r["source_file"]: r["status"] for r in text.manifest(files, spark.createDataFrame([("f",)], "source_file string")).collect()} == {"f": "ingested", "h": "skipped"}


def test_diagnostic_tables(spark):
    df = panel.with_label(small_panel(spark, 40, 12)).withColumn("score", 0 - F.col("close"))
    tables = diagnostics.diagnostic_tables(df, "score", "returns_1d")
    assert {n: t.count() for n, t in tables.items() if n in ("groups", "ic", "monthly_ic", "summary")} == {"groups": 39, "ic": 39, "monthly_ic": 1, "summary": 1}
    assert tables["top"].count() == 480 and tables["last_date"].count() == 12 and tables["summary"].first()["ic_mean"] > 0


def test_ridge_as_by_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3)) * [1, 50, 1e-3] + [0, 7, 1]
    y = x @ [0.5, 0.02, 300] + rng.normal(size=80) * 0.1
    rows = [(DAY + timedelta(days=i), "s", *map(float, r), float(t), "train" if i < 60 else "test") for i, (r, t) in enumerate(zip(x, y, strict=True))]
    frame = spark.createDataFrame(rows, "datetime timestamp, symbol string, a double, b double, c double, returns_1d double, segment string")
    fitted = model.predict(model.train_ridge(frame, ["a", "b", "c"], "returns_1d", l2=3.0), frame)
    mean, sd, own = x[:60].mean(axis=0), x[:60].std(axis=0, ddof=1), y[:60]
    z = (x - mean) / sd
    w = np.linalg.solve(z[:60].T @ z[:60] + 3.0 * np.eye(3), z[:60].T @ (own - own.mean()))
    want = z @ w + own.mean()
    assert [r["score"] for r in fitted.orderBy("datetime").collect()] == pytest.approx(want.tolist(), abs=1e-8)


def rows_of(x, y, segment):
    names = [f"f{i}" for i in range(x.shape[1])]
    return [(DAY + timedelta(days=i), "s", *map(float, r), float(t), g) for i, (r, t, g) in enumerate(zip(x, y, segment, strict=True))], names, f"datetime timestamp, symbol string, {', '.join(f'{n} double' for n in names)}, returns_1d double, segment string"


def test_one_tree_splits_as_by_plain_search(spark):
    rng = np.random.default_rng(5)
    x = rng.permutation(40).astype(float)
    y = np.where(x > 24, 3.0, -1.0) + rng.normal(size=40) * 0.01
    rows, names, schema = rows_of(x[:, None], y, ["train"] * 40)
    frame = spark.createDataFrame(rows, schema)
    fitted = model.predict(model.train_boosted(frame, names, "returns_1d", rounds=1, depth=1, min_leaf=1, step=1.0, l1=0.0, l2=0.0, subsample=1.0), frame)
    cuts = [(sum(((y[m] - y[m].mean()) ** 2).sum() for m in (x <= c, x > c)), c) for c in sorted(x)[:-1]]
    cut = min(cuts)[1]
    want = np.where(x <= cut, y[x <= cut].mean(), y[x > cut].mean())
    assert [r["score"] for r in fitted.orderBy("datetime").collect()] == pytest.approx(want.tolist(), abs=1e-9)


def plain_tree(x, g, s):
    """Predictions of one tree grown strictly leaf by leaf: always the split with the most gain, by comparing all cuts."""
    shrunk = lambda t: np.sign(t) * max(abs(t) - s.l1, 0)
    score = lambda rows: shrunk(g[rows].sum()) ** 2 / (len(rows) + s.l2)

    def best(rows, depth):
        found = (0.0, None, None)
        if depth < s.depth:
            for f in range(x.shape[1]):
                for c in np.unique(x[rows, f])[:-1]:
                    a, b = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                    gain = score(a) + score(b) - score(rows)
                    if min(len(a), len(b)) >= s.min_leaf and gain > found[0] + 1e-9:
                        found = (gain, a, b)
        return found

    leaves = [(np.arange(len(x)), 0)]
    while len(leaves) < s.leaves:
        options = [(best(r, d), i) for i, (r, d) in enumerate(leaves)]
        (gain, a, b), i = max(options, key=lambda o: o[0][0])
        if gain <= 0:
            break
        depth = leaves.pop(i)[1] + 1
        leaves += [(a, depth), (b, depth)]
    out = np.zeros(len(x))
    for rows, _ in leaves:
        out[rows] = -s.step * shrunk(g[rows].sum()) / (len(rows) + s.l2)
    return out


@pytest.mark.parametrize("params", [{"leaves": 5, "depth": 4, "min_leaf": 3, "l1": 0.0, "l2": 0.0}, {"leaves": 7, "depth": 3, "min_leaf": 8, "l1": 0.5, "l2": 2.0}, {"leaves": 31, "depth": 2, "min_leaf": 1, "l1": 0.0, "l2": 1.0}])
def test_trees_grow_leaf_by_leaf_as_by_plain_search(spark, params):
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.normal(size=150), rng.integers(0, 6, 150), rng.normal(size=150)])
    y = np.sin(2 * x[:, 0]) + (x[:, 1] > 3) * x[:, 2] + 0.1 * rng.normal(size=150)
    rows, names, schema = rows_of(x, y, ["train"] * 150)
    frame = spark.createDataFrame(rows, schema).repartition(3)
    fitted = model.train_boosted(frame, names, "returns_1d", rounds=4, step=0.3, subsample=1.0, feature_share=1.0, **params)
    want = np.full(150, y.mean())
    for _ in range(4):
        want = want + plain_tree(x, want - y, fitted.settings)
    assert [r["score"] for r in model.predict(fitted, frame).orderBy("datetime").collect()] == pytest.approx(want.tolist(), abs=1e-9)
    assert fitted.losses[-1][0] == pytest.approx(((want - y) ** 2).mean()) and max(t.feature.count(-1) for t in fitted.trees) <= params["leaves"]
    gain = model.importances(fitted, names, spark).collect()
    assert {r["feature"] for r in gain} == set(names) and gain[0]["importance"] >= gain[-1]["importance"] >= 0


def test_training_stops_without_gain(spark, monkeypatch):
    """Of 500 rounds those after 50 without a lower loss on valid aren't run, and the best are kept; blocks and passes change nothing."""
    from factorloom.operators import trees

    monkeypatch.setattr(trees, "BLOCK", 40)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 2))
    y = (x[:, 0] > 0) + rng.normal(size=240)
    x[3, 1] = np.nan
    rows, names, schema = rows_of(x, y, ["train"] * 160 + ["valid"] * 80)
    frame = spark.createDataFrame([(*r[:3], None if r[3] != r[3] else r[3], *r[4:]) for r in rows], schema).repartition(4)
    few, other = trees.train_many(frame, names, "returns_1d", [trees.Settings(step=0.3, min_leaf=5), trees.Settings(step=0.3, min_leaf=5, rounds=7, patience=0, subsample=1.0)])
    valid = [v for _, v in few.losses]
    assert len(few.trees) == valid.index(min(valid)) < len(valid) - 1 == len(few.trees) + 50 < 500
    assert len(other.trees) == 7 and len(other.losses) == 8
    monkeypatch.setattr(trees, "KEEP", 3)
    monkeypatch.setattr(trees, "PARTIALS", 1)
    again = trees.train_many(frame, names, "returns_1d", [other.settings])[0]
    assert [r["score"] for r in other.transform(frame).orderBy("datetime").collect()] == pytest.approx([r["score"] for r in again.transform(frame).orderBy("datetime").collect()])
    none = trees.train_many(frame.filter("segment = 'valid'"), names, "returns_1d", [trees.Settings()])[0]
    assert none.transform(frame).first()["score"] == 0.0 and not none.trees
    with pytest.raises(ValueError, match="no such trees"):
        trees.Settings(leaves=1)


def test_research_is_its_steps_one_after_the_other(spark):
    from factorloom.operators import preprocess
    from factorloom.operators.factors import with_factors

    df = panel.with_label(small_panel(spark))
    expressions = {"rev": "0 - $close", "vol": "TS_MEAN($volume, 3)", "bad": "$none"}
    got = evaluate.research(df, expressions)
    values, failed = with_factors(df, expressions)
    cleaned = preprocess.normalise_columns(preprocess.fill_missing(preprocess.winsorise(values, ["rev", "vol"]), ["rev", "vol"]), ["rev", "vol"])
    passed = [r["factor"] for r in evaluate.screen(cleaned, ["rev", "vol"]).filter("passed").collect()]
    want = evaluate.evaluation_report(evaluate.factor_score(cleaned, passed, ["rev", "vol"]), "score").first()
    assert got["failed"].keys() == failed.keys() == {"bad"} and sorted(got["passed"]) == sorted(passed)
    mine = got["evaluation"].first().asDict()
    assert {k: v for k, v in mine.items() if isinstance(v, float)} == pytest.approx({k: v for k, v in want.asDict().items() if isinstance(v, float)}, nan_ok=True)


def test_parameter_sets_are_judged_on_their_predictions(spark):
    from factorloom.operators.factors import with_factors

    df = panel.with_label(small_panel(spark))
    frame, features = model.feature_matrix(with_factors(df, {"a": "0 - $close", "b": "TS_MEAN($volume, 3)"})[0], ["a", "b"], "returns_1d")
    whole = {"subsample": 1.0, "feature_share": 1.0}  # samples follow from the blocks
    grid = [{"rounds": 2, "depth": 2, "leaves": 4, "min_leaf": 20} | whole, {"rounds": 4, "depth": 3, "leaves": 31, "min_leaf": 100} | whole]
    got = {r["param_id"]: r for r in model.score_parameters(frame, features, "returns_1d", grid).collect()}
    days = sorted(r["datetime"] for r in frame.select("datetime").distinct().collect())
    split = frame.withColumn("segment", F.when(F.col("datetime") < days[int(len(days) * 0.7)], "train").otherwise("valid"))
    for i, (params, complexity) in enumerate(zip(grid, ((4 / 63 + 2 / 8 + 2.5) / 3, (31 / 63 + 3 / 8 + 0.5) / 3), strict=True)):
        fitted = model.train_boosted(split, features, "returns_1d", patience=0, **params)
        scores = model.predict(fitted, split).toPandas()
        loss = {s: ((g["score"] - g["returns_1d"]) ** 2).mean() for s, g in scores.groupby("segment")}
        daily = scores.groupby(["segment", "datetime"]).apply(lambda g: g["score"].rank().corr(g["returns_1d"].rank()), include_groups=False).dropna()
        a, b = daily["train"].mean(), daily["valid"].mean()
        lost = max(0, (abs(a) - abs(b)) / abs(a), 1 if a * b < 0 else 0)
        r = got[f"p{i}"]
        assert (r["rank_ic_mean"], r["train_loss"], r["valid_loss"], r["complexity"]) == pytest.approx((b, loss["train"], loss["valid"], complexity))
        assert r["overfit"] == pytest.approx(max(lost, loss["valid"] / loss["train"] - 1, 0)) and r["reason"] is None and r["fitness"] is not None
    empty = model.score_parameters(frame.limit(0), features, "returns_1d", grid).collect()
    assert [(r["fitness"], r["reason"]) for r in empty] == [(None, "empty_training_frame")] * 2


@pytest.mark.parametrize("threshold", [0.3, 0.55, 0.7, 0.9])
def test_similar_expressions_equal_all_pairs_in_a_grid(spark, monkeypatch, threshold):
    monkeypatch.setattr(library, "HOT", 3)
    rng = np.random.default_rng(5)
    parts = ["RANK($close)", "TS_MEAN($volume, 5)", "DELAY($close, 1)", "ZSCORE($open)", "ABS($low)", "LOG($high)"]
    texts = [" + ".join(rng.choice(parts, rng.integers(1, 5))) for _ in range(60)] + ["$x", "$x", "", None]
    frame = lambda rows: spark.createDataFrame([(t,) for t in rows], "factor_expression string")
    new, old = texts[::2], texts[1::2]
    forms = {r[0]: r[1] for r in frame(texts).select("factor_expression", library.normal_form(F.col("factor_expression"))).distinct().collect() if r[1] is not None}
    grams = lambda f: {f[i : i + 3] for i in range(len(f) - 2)} or {f}
    count = lambda rows: {f: sum(forms.get(t) == f for t in rows) for t in rows if (f := forms.get(t)) is not None}
    a, b = count(new), count(old)
    plain = {(x, y): (len(grams(x) & grams(y)) / len(grams(x) | grams(y)), a[x], b[y]) for x in a for y in b}
    got = library.similar_expressions(frame(new), frame(old), threshold).collect()
    assert {(r["new_form"], r["old_form"]): (r["similarity"], r["n_new"], r["n_old"]) for r in got} == {k: v for k, v in plain.items() if v[0] >= threshold}
    assert len(got) == len({(r["new_form"], r["old_form"]) for r in got}) > 0


def test_events_of_one_time_and_name(spark):
    """Which of them are the latest doesn't depend on where they lie."""
    rows = [(k, "n", f"r{k * 7 % 11}") for k in range(40)]
    found = [{r["event_id"] for r in library.recent(spark.createDataFrame(own, "event_id int, name string, reason string").coalesce(1).withColumn("timestamp", F.lit(0)), 5).collect()} for own in (rows, rows[::-1])]
    assert found[0] == found[1] == {0, 1, 2, 3, 4}


def test_trees_of_two_features_take_one_pass(spark, monkeypatch):
    """The same trees as by passes for each level, which they took before."""
    from factorloom.operators import trees

    rng = np.random.default_rng(5)
    rows = [(*map(float, x), float(x[0] * x[1] + x[2] + e), "train" if i % 4 else "valid") for i, (x, e) in enumerate(zip(rng.integers(0, 9, (400, 3)), rng.normal(size=400)))]
    frame, passes, one = spark.createDataFrame(rows, "a double, b double, c double, y double, segment string").coalesce(1), [], trees._pass
    monkeypatch.setattr(trees, "_pass", lambda *x: passes.append(1) or one(*x))
    found = []
    for joint in (2, 0):
        monkeypatch.setattr(trees, "JOINT", joint)
        passes.clear()
        found.append((trees.train_many(frame, ["a", "b", "c"], "y", [trees.Settings(rounds=4, min_leaf=5, feature_share=0.6)])[0], len(passes)))
    (fast, few), (slow, many) = found
    assert few == 5 and many > 12 and len(fast.trees) == len(slow.trees) == 4
    for a, b in zip(fast.trees, slow.trees, strict=True):
        assert (a.feature, a.bin, a.left, a.right) == (b.feature, b.bin, b.left, b.right) and a.value == pytest.approx(b.value) and a.gain == pytest.approx(b.gain)
        bins = rng.integers(0, 256, (3, 5000)).astype(np.uint8)
        plain = a.scores(bins)
        monkeypatch.setattr(trees, "JOINT", 2)
        a.seen = 1 << 20
        assert (a.scores(bins) == plain).all() and a.table is not None or len(a.used()) > trees.JOINT


def test_expressions_are_parsed_by_all_cores_and_once_a_batch(spark):
    from factorloom.operators.library import acceptable_shape, candidate_check, each_once, rule_check

    df = spark.createDataFrame([("TS_MEAN($x, 3)",), (None,)], "factor_expression string")
    for out in (candidate_check(df, ["x"]), acceptable_shape(df), rule_check(df, ["x"])):
        assert "RoundRobinPartitioning(16)" in out._jdf.queryExecution().executedPlan().toString()  # four tasks for each of 4 cores
    seen = []
    assert each_once(lambda x: seen.append(x) or len(x or ""), pd.Series(["a", None, "bb", "a", None])) == [1, 0, 2, 1, 0] and len(seen) == 3


def test_factors_of_one_size_and_name(spark):
    """Which of them are at the top doesn't depend on where they lie, and a loss and a gain of one size are told apart by place."""
    rows = [(k, "n", {"Sharpe": "3" if k % 4 else "-3"}) for k in range(40)]
    schema = "intra_loop_index int, factor_name string, metrics map<string,string>"
    found = [[r["value"] for r in library.top_factors(spark.createDataFrame(own, schema).coalesce(1), 4).collect()] for own in (rows, rows[::-1])]
    assert found == [[-3.0, 3.0, 3.0, 3.0]] * 2


def test_training_keeps_one_copy_of_its_blocks(spark, monkeypatch, tmp_path):
    """Blocks whose scores were carried on go at once, and nothing but the matrix is left in the end."""
    from factorloom.operators import trees
    from factorloom.sources import files

    folders = lambda *names: [p.name for p in tmp_path.glob("tables-*/*") if p.name.split("-")[0] in names]
    seen, one = [], trees._pass
    monkeypatch.setattr(files, "shared_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(trees, "_pass", lambda *x: seen.append(len(folders("blocks"))) or one(*x))
    monkeypatch.setattr(trees, "KEEP", 2)
    frame, features = model.feature_matrix(panel.with_label(small_panel(spark)), ["close", "volume"], "returns_1d")
    assert [x.split("-")[0] for x in folders("features", "matrix")] == ["matrix"]
    fitted = model.train_boosted(panel.segments(frame, RANGES), features, "returns_1d", rounds=9, patience=0, min_leaf=5)
    assert len(fitted.trees) == 9 and len(fitted.losses) == 10 and set(seen) == {1} and not folders("blocks")
    assert frame.count() > 0


def test_backtest_leaves_no_panel(spark, monkeypatch, tmp_path):
    from factorloom.sources import files

    monkeypatch.setattr(files, "shared_dir", lambda _: str(tmp_path))
    rows = [("r", 0, i, n, e, 0.1) for i, (n, e) in enumerate({"rev": "0 - $close", "vol": "TS_MEAN($volume, 3)"}.items())]
    done = model.library_backtest(small_panel(spark), lib(spark, *rows), RANGES, min_factors=1, min_ic=0.0, min_icir=0.0, rounds=2)
    left = {p.name.split("-")[0] for p in tmp_path.glob("tables-*/*")}
    assert not left & {"panel", "values", "features", "blocks"} and {"screen", "predictions"} <= left
    assert done["screen"].count() == 2 and done["predictions"].count() > 0 and done["analysis"].count() == 1


def test_backtest_evaluates_one_batch_once(spark, monkeypatch):
    rows = [("r", 0, i, n, e, 0.1) for i, (n, e) in enumerate({"rev": "0 - $close", "vol": "TS_MEAN($volume, 3)"}.items())]
    asked, one = [], model.with_factors
    monkeypatch.setattr(model, "with_factors", lambda df, group, keep: asked.append(sorted(group)) or one(df, group, keep))
    for n, want in ((100, [["rev", "vol"]]), (1, [["rev"], ["vol"], ["rev", "vol"]])):
        asked.clear()
        assert model.library_backtest(small_panel(spark), lib(spark, *rows), RANGES, min_factors=1, min_ic=0.0, min_icir=0.0, rounds=1, batch=n)["status"] == "done"
        assert sorted(asked) == sorted(want)
