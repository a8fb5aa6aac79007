"""Rules whose results are fixed: expected values worked out by hand."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.operators import diagnostics, evaluate, library, preprocess, text
from factorloom.operators.factors import shape

DAY = datetime(2024, 1, 1)


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_quote_currencies_in_their_order(spark):
    got = {s: one(spark, text.base_symbol(F.col("s")), s=s) for s in ("BTCUSDT", "BTCUSD", "BTCUSDC", "BTCBUSD", "USDT", "BUSD", "BTC")}
    assert got == {"BTCUSDT": "BTC", "BTCUSD": "BTC", "BTCUSDC": "BTC", "BTCBUSD": "BTCB", "USDT": "USDT", "BUSD": "B", "BTC": "BTC"}


def test_silent_roles_and_confidence(spark):
    body = '{"events": [%s]}' % ", ".join(f'{{"symbol": "*", "body": "b", "asset_role": "{r}"}}' for r in ("backtest_example", "Illustration", "incidental_reference", "example"))
    docs = spark.createDataFrame([("f", "t", DAY, body)], "source_file string, title string, timestamp timestamp, summary_json string")
    names = spark.createDataFrame([("A",)], "symbol string")
    got = text.summary_events(docs, text.default_aliases(names), names).orderBy("event_no").collect()
    assert [r["emitted"] for r in got] == [False, False, False, True] and {r["confidence"] for r in got} == {0.6}


def test_white_space_of_any_kind(spark):
    raw = "\t# Title\x0b\r\n\u00a0 body \u3000\r\n \x1c \n"
    tidy = one(spark, text.tidy_lines(F.col("t")), t=raw)
    assert tidy == "# Title\nbody" and one(spark, text.title_of(F.col("t"), F.lit("f")), t=tidy) == "Title" and one(spark, text.title_of(F.col("t"), F.lit("f")), t="--\n* ") == "f"
    assert one(spark, text.body_of(F.col("t"), F.lit("Title")), t="\tTitle\u00a0more\n") == "more" and one(spark, text.body_of(F.col("t"), F.lit("T")), t=" T ") == "T"


@pytest.mark.parametrize(("body", "file", "want"), [
    ("on 2024-3-5 and 2023-01-01", "x", "2024-03-05 00:00:00"), ("at 2024/03/05T07:08 sharp", "x", "2024-03-05 07:08:00"), ("2024-03-05 07:08:09", "x", "2024-03-05 07:08:09"), ("2024-13-05 but 20240607", "x", "2024-06-07 00:00:00"),
    ("a2024-03-05 no", "r_20220203.txt", "2022-02-03 00:00:00"), ("none", "dir20220101/none.txt", "2020-02-02 00:00:00"), ("20249999", "x", "2020-02-02 00:00:00"),
])
def test_dates(spark, body, file, want):
    assert str(one(spark, text.date_of(F.col("t"), F.col("f"), F.lit(datetime(2020, 2, 2))), t=body, f=file)) == want


def test_entities_of_any_kind(spark):
    html = "<p>a &amp; b &lt;c&gt; &eacute; &#233; &#xe9;</p><script>no</script> x&nbsp;y &mdash; &unknown;"
    assert one(spark, text.tidy_lines(text.html_to_text(F.col("t"))), t=html).split() == ["a", "&", "b", "<c>", "é", "é", "é", "x", "y", "—", "&unknown;"]
    assert spark.createDataFrame([(None,)], "t string").select(text.html_to_text(F.col("t"))).first()[0] is None


def records(spark, *rows):
    return spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], r[5]) for r in rows], "run_id string, loop_round int, intra_loop_index int, factor_name string, factor_expression string, factor_file string")


def test_slugs_and_orphans(spark):
    got = {s: one(spark, library.slug(F.col("s")), s=s) for s in ("RANK($close / 2)", "__a--B__", "$", "", "É x", "a" * 79 + "-b")}
    assert got == {"RANK($close / 2)": "rank_close_2", "__a--B__": "a_b", "$": "expression", "": "expression", "É x": "é_x", "a" * 79 + "-b": "a" * 79 + "_"}
    lib = records(spark, ("r1", 2, 3, "n", " RANK($x) ", "own.py"), ("", None, None, "m", "$y", None), ("r2", 0, 1, "k", None, ""), (None, 1, 1, "l", "$", " "))
    names = ["own.py", "r1_2_3_rank_x.py", "0_0_y.py", "r2_0_1_expression.py", "1_1_expression.py", "r1_2_n.py", "R1_2_3_RANK_x.py"]
    files = spark.createDataFrame([(n,) for n in names], "file string")
    assert {r["file"] for r in library.orphans(files, lib).collect()} == {"r2_0_1_expression.py", "r1_2_n.py", "R1_2_3_RANK_x.py"}


def test_recovery_says_why(spark):
    stored = records(spark, ("r", 1, 1, "a", "$a", None), ("r", 1, 2, "b", "$b", "b.py")).withColumn("source", F.lit("mined"))
    legacy = records(spark, ("r", 1, 1, "a", "$a", None), ("r", 1, 2, "b", "$b", None), ("r", 1, 3, "c", "$c", None), ("r", 1, 3, "d", "$c", None), ("r", 1, 4, "e", "$gone", None), ("", 1, 5, "f", "$f", None), ("r", 1, 6, "g", "", None))
    files = spark.createDataFrame([("r_1_1_a.py",), ("r_1_2_b.py",), ("r_1_3_c.py",)], "file string")
    out, counts = library.recover(stored, legacy, files)
    assert {r["action"]: r["n"] for r in counts.collect()} == {"updated_existing": 1, "already_present": 2, "recovered": 1, "code_missing": 1, "unparseable_record": 2}
    assert sorted((r["factor_name"], r["factor_file"], r["source"]) for r in out.collect()) == [("a", "r_1_1_a.py", "mined"), ("b", "b.py", "mined"), ("c", "r_1_3_c.py", "legacy_old_json_recovery")]


@pytest.mark.parametrize(("expression", "want"), [
    ("RANK($close)", None), (" ", "empty_expression"), ("$nope + 1", "unknown_column:$nope"), ("RANK( rank($close))", "recursive_normalization"), ("TS_MEAN(($close - $close), 3)", "degenerate_self_operation"), ("($close - $CLOSE + 1e-3)", "unknown_column:$CLOSE"),
    ("($close - $close + .5e-3)", "degenerate_self_operation"), ("($close - $close * 2)", None), ("$close / $close", "degenerate_self_operation"), ("$close / $close2", "unknown_column:$close2"), ("(", "syntax_error"),
    (" + ".join(["TS_MEAN($close, 5)"] * 6), "expression_too_many_nodes"), ("ABS(" * 6 + "$close" + ")" * 6, "expression_too_deep"), ("ABS(" * 5 + "$close" + ")" * 5, None), ("EMA($close, 3)", "unknown_function:EMA"), ("$close - $close", None),
])
def test_candidates(spark, expression, want):
    df = spark.createDataFrame([(expression,)], "factor_expression string")
    assert library.candidate_check(df, ["close", "open"]).first()["invalid"] == want


def test_every_node_counts():
    # the root, a call, its name and the name's context, a column and its context, a number
    assert shape("TS_MEAN($close, 5)")[3:5] == (7, 4) and shape("TS_MEAN($close, 5)")[:3] == (3, 2, 1)
    # six calls of six nodes below five sums with an operator each, and the root
    assert shape(" + ".join(["TS_MEAN($close, 5)"] * 6))[3] == 6 * 6 + 5 * 2 + 1


def test_acceptable_shapes(spark):
    rows = ["RANK($a)", "$a", "$a + 1", "TS_MEAN($a, 2)", "RANK(TS_MEAN($a, 5) + $b)", "($a", "RANK(" + " + ".join(f"$v{i} * 2 * 3" for i in range(7)) + ")"]
    df = spark.createDataFrame([(r,) for r in rows], "factor_expression string")
    got = {r["factor_expression"]: r["acceptable"] for r in library.acceptable_shape(df).collect()}
    assert got == dict(zip(rows, [False, False, True, True, True, False, False], strict=True))  # half of two nodes isn't less than half
    big = "ZSCORE(RANK(TS_MEAN($a, 5) + TS_STD($b, 5)))"
    pair = spark.createDataFrame([(big,), ("RANK(TS_MEAN($a, 5) + $b)",)], "factor_expression string")
    known = spark.createDataFrame([("DELTA(ZSCORE(RANK(TS_STD($b, 5) + TS_MEAN($a, 5))), 2)",)], "factor_expression string")
    got = {r["factor_expression"]: (r["common_size"], r["acceptable"]) for r in library.acceptable_shape(pair, references=known).collect()}
    assert got == {big: (9, False), "RANK(TS_MEAN($a, 5) + $b)": (3, True)}


def test_gate_reads_missing_metrics_as_the_worst(spark):
    base = {"IC": "0.01", "ICIR": "0.1", "turnover": "0.2", "coverage": "0.9"}
    cases = {"fine": base, "no_ic": base | {"IC": None}, "other_ic": {"rank_ic": "0.01", "rank_icir": "-0.2", "turnover": "0.2", "coverage": "0.9"}, "no_coverage": {k: v for k, v in base.items() if k != "coverage"}, "no_turnover": {k: v for k, v in base.items() if k != "turnover"}, "still": base | {"turnover": "0"}, "weak": base | {"ICIR": "0.004"}, "text": base | {"IC": "high"}}
    new = spark.createDataFrame([(k, f"RANK($close) * {i + 2}" if k != "fine" else "$open", v) for i, (k, v) in enumerate(cases.items())], "factor_name string, factor_expression string, metrics map<string,string>")
    old = spark.createDataFrame([("known", "$volume")], "factor_name string, factor_expression string")
    got = {r["factor_name"]: r["gate"] for r in library.quality_gate(new, old, ["close", "open", "volume"]).collect()}
    assert got == {"fine": None, "no_ic": "ic", "other_ic": None, "no_coverage": "coverage", "no_turnover": "turnover", "still": "turnover", "weak": "icir", "text": "ic"}
    assert tuple(library.gate_summary(library.quality_gate(new, old, ["close", "open", "volume"])).first()) == (2, 6, 0.25)


def test_failures_without_reason_are_unknown_and_samples_are_the_first(spark):
    rows = [("n", "r", DAY + timedelta(hours=i), reason, e) for i, (reason, e) in enumerate([("old", "$old"), (None, "$b"), ("why", "$a"), (" ", "$a"), ("why", None), ("why", "$c"), ("why", "$d"), ("why", "$e"), ("why", "$f"), ("why", "$f")])]
    events = spark.createDataFrame([*rows, (None, "r", DAY + timedelta(hours=99), "why", "")], "name string, run_id string, timestamp timestamp, reason string, expression string")
    got = [(r["kind"], r["value"], r["n"]) for r in library.failure_summary(events, last=10).collect()]
    assert got == [("reason", "why", 8), ("reason", "unknown", 2), ("name", "n", 9), ("name", "unknown", 1), ("expression", "$b", 1), ("expression", "$a", 2), ("expression", "$c", 1), ("expression", "$d", 1), ("expression", "$e", 1)]


def test_upserts_fill_fields_and_proposals_only_add(spark):
    kind = "name string, run_id string, timestamp timestamp, reason string, expression string, type string, metrics map<string,string>"
    log = spark.createDataFrame([("a", "r", DAY, "one", "$a", "low_metric", {"IC": "0"}), ("a", "r", DAY + timedelta(1), "two", None, None, None)], kind)
    new = spark.createDataFrame([("a", "r", DAY + timedelta(5), None, "$z", None, None), ("b", "r", DAY + timedelta(2), None, "$late", None, None), ("b", "r", DAY, None, "$b", None, None)], kind)
    got = {r["name"]: (r["timestamp"], r["reason"], r["expression"], r["type"], r["metrics"]) for r in library.upsert_failures(log, proposals=new).collect()}
    assert got == {"a": (DAY + timedelta(1), "two", "$a", "low_metric", {"IC": "0"}), "b": (DAY, "Proposed but results pending or rejected.", "$b", "unsuccessful_attempt", None)}
    last = library.recent_rejected(spark.createDataFrame([("a", DAY, "x"), ("a", DAY + timedelta(1), "y"), ("b", DAY, "z")], "name string, timestamp timestamp, reason string"), 2)
    assert [(r["name"], r["reason"]) for r in last.collect()] == [("a", "y"), ("b", "z")]


def long(spark, rows):
    return spark.createDataFrame([("f", DAY + timedelta(d), s, v, 0.0) for d, s, v in rows], "factor string, datetime timestamp, symbol string, value double, target double")


def test_ranks_of_scores_are_among_all_of_the_date(spark):
    rows = [(0, s, v) for s, v in zip("abc", (1.0, 2.0, 3.0), strict=True)] + [(1, s, v) for s, v in zip("abcd", (1.0, 3.0, 4.0, 2.0), strict=True)]
    got = diagnostics.score_autocorrelation(long(spark, rows)).collect()
    a, b = np.array([1, 3, 4]) / 4, np.array([1, 2, 3]) / 3  # d has no earlier score, but takes a rank
    assert len(got) == 1 and got[0]["autocorrelation"] == pytest.approx(np.corrcoef(a, b)[0, 1])


def test_turnover_counts_all_assets_of_the_date(spark):
    rows = [(0, s, float(v)) for s, v in zip("abcd", (1, 2, 3, 4), strict=True)] + [(1, s, float(v)) for s, v in zip("abcdef", (4, 3, 2, 1, 9, 8), strict=True)]
    got = {r["datetime"].day: (r["top_turnover"], r["low_turnover"]) for r in diagnostics.set_turnover(long(spark, rows), share=3).collect()}
    # day 2: top two now e, f, before d, c; lowest now d, c, before a, b; day 1: no scores before, assets in order
    assert got == {1: (1.0, 0.0), 2: (1.0, 1.0)}


def test_monthly_ratio_is_not_annual_and_0_without_variation(spark):
    rows = [(DAY + timedelta(i), v) for i, v in enumerate([0.1, 0.3, 0.2])] + [(datetime(2024, 2, 1) + timedelta(i), 0.1) for i in range(3)] + [(datetime(2024, 3, 1), 0.1)]
    got = {r["month"]: (r["information_ratio"], r["annual_return"]) for r in diagnostics.monthly_risk(spark.createDataFrame(rows, "datetime timestamp, v double"), "v").collect()}
    assert got == {1: (pytest.approx(2.0), pytest.approx(50.4)), 2: (0.0, pytest.approx(25.2))}


def test_overfit_needs_an_ic_and_decay_comes_first(spark):
    days, assets = 10, 8
    order = lambda sign: [sign * a for a in range(assets)]
    tiny = [[(a * 3 + d) % 8 for a in range(assets)] for d in range(days)]
    rows = []
    for d in range(days):
        inside = d < 7
        flip, fade = order(1 if inside else -1), order(1) if inside else [3, 1, 4, 1.5, 5, 9, 2, 6]
        rows += [(DAY + timedelta(d), f"s{a}", float(a), float(flip[a]), float(fade[a]), float(tiny[d][a])) for a in range(assets)]
    df = spark.createDataFrame(rows, "datetime timestamp, symbol string, returns_1d double, flip double, fade double, tiny double")
    got = {r["factor"]: r for r in diagnostics.overfit_check(df, ["flip", "fade", "tiny"], decay=0.2).collect()}
    assert (got["flip"]["reason"], got["flip"]["overfit"], got["flip"]["decay"]) == ("sign_flip", True, pytest.approx(0.0)) and got["fade"]["reason"] == "decay" and got["fade"]["robust"] is False
    strict = {r["factor"]: r for r in diagnostics.overfit_check(df, ["flip"], judged=1.5).collect()}
    assert strict["flip"]["reason"] == "ok" and strict["flip"]["robust"]


def test_tail_ratio(spark):
    values = [float(v) for v in range(100)] + [10_000.0]
    df = spark.createDataFrame([(DAY, f"s{i:03d}", v) for i, v in enumerate(values)], "datetime timestamp, symbol string, f double")
    got = diagnostics.factor_quality(df, ["f"]).first()
    q1, q99 = np.quantile(values, [0.01, 0.99])
    assert got["tail_ratio"] == pytest.approx(np.abs(np.array(values) - 50).mean() / ((q99 - q1) / 1.4826))


def test_residuals_on_variables_of_any_size(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for d in range(4):
        n = 3 if d == 3 else 40
        cap, beta, y = rng.uniform(1e11, 1e12, n), rng.normal(size=n), rng.normal(size=n)
        design = np.stack([np.ones(n), cap / 1e12, beta], 1)
        residual = y - design @ np.linalg.lstsq(design, y, rcond=None)[0]
        for i in range(n):
            rows.append((DAY + timedelta(d), f"s{i}", float(y[i]), float(3 + 2 * cap[i] - beta[i]), float(cap[i]), float(beta[i])))
            want[d, f"s{i}"] = y[i] if n < 4 else residual[i]
    rows.append((DAY, "gap", 1.0, 1.0, None, 0.5))
    df = spark.createDataFrame(rows, "datetime timestamp, symbol string, y double, planted double, cap double, beta double")
    out = preprocess.neutralise_many(df, ["y", "planted"], ["cap", "beta"]).collect()
    assert {((r["datetime"] - DAY).days, r["symbol"]): r["y"] for r in out if r["symbol"] != "gap"} == pytest.approx(want, abs=1e-9)
    assert all(abs(r["planted"]) < 1e-2 for r in out if r["symbol"] != "gap" and r["datetime"] != DAY + timedelta(3)) and next(r for r in out if r["symbol"] == "gap")["y"] is None


def test_screens(spark):
    daily = spark.createDataFrame([("a", DAY + timedelta(i), v) for i, v in enumerate([0.05, 0.06, 0.04, 0.05, 0.05])] + [("b", DAY + timedelta(i), 0.5) for i in range(4)] + [("c", DAY + timedelta(i), v) for i, v in enumerate([0.5, -0.5, 0.4, -0.4, 0.1])], "factor string, datetime timestamp, ic double")
    assert {r["factor"]: r["passed"] for r in evaluate.batch_screen(daily).collect()} == {"a": True, "b": False, "c": False}
    rows = spark.createDataFrame([("a", 0.1, 0.6, 0.0), ("b", -0.1, 0.9, 0.1), ("c", 0.2, None, 0.1)], "name string, fitness double, coverage double, rank_ic_mean double")
    assert {r["name"]: r["passed"] for r in evaluate.candidate_gate(rows).collect()} == {"a": True, "b": False, "c": False}


def test_many_correlations_in_long_form(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 6))
    x[rng.random(x.shape) < 0.1] = np.nan
    names = [f"f{i}" for i in range(6)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{n} double" for n in names))
    few, many = ({(r["f1"], r["f2"]): r["corr"] for r in diagnostics.correlation_pairs(df, names, most).collect()} for most in (100, 1))
    assert len(many) == 15 and many == pytest.approx(few)
    both = ~np.isnan(x[:, 1]) & ~np.isnan(x[:, 4])
    assert many["f1", "f4"] == pytest.approx(np.corrcoef(x[both, 1], x[both, 4])[0, 1])


def test_largest_common_subtrees_as_by_all_pairs(spark):
    import ast
    import re

    new = ["RANK($a + TS_MEAN($b, 5))", "TS_MEAN($b, 5) * 2", "$c", "-$a / ($b - 1)", "RANK(($a", "ZSCORE($d)"]
    old = ["TS_MEAN($b, 5) + $a", "2 * TS_MEAN($b, 5)", "($b - 1) / $a", "(1 - $b)", "$a - $b", "RANK($x"]

    def parts(text):
        try:
            tree = ast.parse(re.sub(r"\$", "v_", text), mode="eval").body
        except SyntaxError:
            return {}
        out = {}

        def walk(node):
            if isinstance(node, ast.BinOp):
                kids = [walk(node.left), walk(node.right)]
                key = (type(node.op).__name__, *(sorted(k for k, _ in kids) if isinstance(node.op, ast.Add | ast.Mult) else [k for k, _ in kids]))
            elif isinstance(node, ast.UnaryOp):
                kids = [walk(node.operand)]
                key = (type(node.op).__name__, kids[0][0])
            elif isinstance(node, ast.Call):
                kids = [walk(x) for x in node.args]
                key = (node.func.id, *(k for k, _ in kids))
            else:
                kids, key = [], (ast.unparse(node),)
            size = 1 + sum(n for _, n in kids)
            out[str(key)] = size
            return str(key), size

        walk(tree)
        return out

    want = {}
    for n in new:
        best = max((parts(n)[k] for o in old for k in parts(n).keys() & parts(o).keys()), default=0)
        if best:
            want[n] = best
    frames = [spark.createDataFrame([(e,) for e in x], "factor_expression string") for x in (new, old)]
    got = {r["new"]: (r["size"], r["old"]) for r in library.largest_common_subtree(*frames).collect()}
    assert {k: v[0] for k, v in got.items()} == want and got[new[0]][1] == old[0] and all(got[n][0] in parts(got[n][1]).values() for n in got)


def test_reports_as_by_plain_python(spark):
    pages = {
        "a/btc_2024-report.html": "<html><head><style>x</style></head><body><h1># BTC &amp; co</h1><p>On 2024-02-03 10:20 btc rose.</p><p>ETHUSDT fell</p></body></html>",
        "b/plain_20230405.txt": "  \n** Market note\r\nnothing here\r\n", "c/empty.md": "", "d/only-title.md": "- one line", "e/words.txt": "XBTC and SOLVE; sol\nSOL at 20240101",
    }
    df = spark.createDataFrame([(k, datetime(2020, 1, 1), v) for k, v in pages.items()], "source_file string, modified timestamp, text string")
    names = spark.createDataFrame([("BTCUSDT",), ("ethusdt",), ("SOLUSD",)], "symbol string")
    got = {}
    for r in text.report_records(df, names).collect():
        got.setdefault(r["source_file"], []).append((r["chunk_id"], r["symbol"], r["title"], r["body"], str(r["timestamp"]), r["confidence"]))
    assert {k: sorted(v) for k, v in got.items()} == {
        "a/btc_2024-report.html": [(0, "BTCUSDT", "BTC & co", "# BTC & co\nOn 2024-02-03 10:20 btc rose.\nETHUSDT fell", "2024-02-03 10:20:00", 0.72), (1, "ETHUSDT", "BTC & co", "# BTC & co\nOn 2024-02-03 10:20 btc rose.\nETHUSDT fell", "2024-02-03 10:20:00", 0.72)],
        "b/plain_20230405.txt": [(0, "*", "Market note", "** Market note\nnothing here", "2023-04-05 00:00:00", 0.48)], "c/empty.md": [(0, "*", "Empty", "Empty", "2020-01-01 00:00:00", 0.48)], "d/only-title.md": [(0, "*", "one line", "- one line", "2020-01-01 00:00:00", 0.48)],
        "e/words.txt": [(0, "SOLUSD", "XBTC and SOLVE; sol", "SOL at 20240101", "2024-01-01 00:00:00", 0.72)],
    }


def test_entities_are_resolved_without_texts_in_python(spark):
    import html

    odd = [None, "", "&", "&amp;", "a&amp;lt;b&ltc &notit; &#65;&#x1F600;&#0;&#xD800; x&y;z", "&&amp;&", "&eacute" * 3, "é&" + "ü" * 40 + ";", "no", "&#38;amp; 😀&😀;", "&copy&reg;;"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").repartition(1)
    got = {r["i"]: r["x"] for r in df.select("i", text.resolved(F.col("t"), text.characters_of(text.entities(F.col("t")))).alias("x")).collect()}
    assert [got[i] for i in range(len(odd))] == [t if t is None else html.unescape(t) for t in odd]
    rep = df.select(F.lit("a.html").alias("source_file"), F.current_timestamp().alias("modified"), F.col("t").alias("text"))
    names = spark.createDataFrame([("A",)], "symbol string")
    plan = text.report_records(rep, names)._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" not in plan and "script|style" not in plan  # texts were tidied once, not for each join
