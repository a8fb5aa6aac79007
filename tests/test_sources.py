"""Readers and sinks round trip; incremental jobs give what a batch gives."""

import json

import pytest
from pyspark.sql import functions as F

from factorloom.operators import text
from factorloom.sources import files
from factorloom.streaming import jobs


def test_market_text_formats(spark, tmp_path):
    rows = [{"timestamp": "2024-01-01T00:00:00Z", "symbol": "A", "title": "t", "body": "b"}, {"timestamp": "2024-01-02T00:00:00Z", "symbol": "*", "title": "u", "body": 'say "x"'}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "a.csv").write_text('timestamp,symbol,title,body\n2024-01-01T00:00:00Z,A,t,b\n2024-01-02T00:00:00Z,*,u,"say ""x"""\n')
    found = [sorted((r["symbol"], r["body"]) for r in files.read_market_text(spark, f"{tmp_path}/a.{k}").collect()) for k in ("jsonl", "json", "csv")]
    assert found[0] == found[1] == found[2] == [("*", 'say "x"'), ("A", "b")]
    with pytest.raises(ValueError):
        files.read_market_text(spark, "a.xml")


def test_reports_are_found_by_suffix(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.md").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("x")
    (tmp_path / "c.pdf").write_text("no")
    assert sorted(r["text"] for r in files.read_reports(spark, str(tmp_path)).collect()) == ["one\ntwo", "x"]


def test_bad_lines_are_counted(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"name": "a"}\nnot json\n\n{"name": "b"}\n{"name": ')
    events, counts = files.read_events(spark, f"{tmp_path}/log.jsonl", "name string")
    assert sorted(r["name"] for r in events.collect()) == ["a", "b"]
    assert tuple(counts.select("events", "bad_lines").first()) == (2, 2)


def test_library_layouts_and_priority(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"metadata": {}, "records": [{"factor_name": "n1", "factor_expression": "RANK( $x )", "metrics": {"IC": 0.1}}]}))
    (tmp_path / "2.json").write_text(json.dumps({"factors": {"id7": {"expression": "RANK($x)"}, "id8": {"name": "m", "expression": "$y"}}}))
    (tmp_path / "3.json").write_text(json.dumps([{"factor_name": "k", "factor_expression": "$z"}]))
    (tmp_path / "4.json").write_text(json.dumps({"factor_name": "one", "factor_expression": "$w"}))
    got = {r["factor_name"]: r["factor_expression"] for r in files.read_libraries(spark, [f"{tmp_path}/{i}.json" for i in (1, 2, 3, 4)]).collect()}
    assert got == {"n1": "RANK( $x )", "m": "$y", "k": "$z", "one": "$w"}


def test_run_logs_traces_and_aliases(spark, tmp_path):
    log = {"run_id": "r", "loops": [{"loop_round": 1, "factors": [{"factor_name": "a", "factor_expression": "$x", "metrics": {"IC": 0.02}, "rejected": False}], "specs": [{"factor_name": "a", "hypothesis": "h"}]}]}
    (tmp_path / "log.json").write_text(json.dumps(log))
    r = files.read_run_logs(spark, f"{tmp_path}/log.json").first()
    assert (r["factor_name"], r["hypothesis"], r["metrics"]["IC"]) == ("a", "h", 0.02)
    (tmp_path / "alias.json").write_text('{"btc": "btcusdt"}')
    assert tuple(files.read_aliases(spark, f"{tmp_path}/alias.json").first()) == ("BTC", "BTCUSDT")


def test_what_an_agent_proposed_before(spark):
    def record(spec, agent="designer"):
        return json.dumps({"agent_name": agent, "output_snapshot": {"shared_updates": {"experiment_spec": spec}}})

    traces = [
        record({"factors": [{"factor_name": " a ", "expression": " $x "}, {"factor_name": "", "name": "b"}, 7, {"expression": "$lone"}], "task_plan": {"steps": 3}}),
        record({"c": {"description": "d", "more": {"deep": [1]}}, "d": {"expression": "$y"}, "e": "text", "f": {"other": 1}, "factors": "none"}),
        record({"factors": {"expression": "$odd"}}),
        record({"factors": [{"factor_name": "z", "expression": "$z"}]}, "coder"),
        record([1]), '{"agent_name": "designer", "output_snapshot": 5}', '{"agent_name": "designer"}', "no json", None,
        record({"g": {"expression": "$x"}}),
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(traces)], "i int, value string")
    assert sorted(r[0] for r in files.proposed_names(df, "designer").collect()) == ["a", "b", "c", "d", "factors", "g"]
    got = {r["expression"]: (r["record"], r["n"]) for r in files.proposed_expressions(df, "designer", order="i").collect()}
    assert got == {"$x": (0, 2), "$lone": (0, 1), "$y": (1, 1), "$odd": (2, 1)}
    assert files.proposed_names(df.filter("false"), "designer").count() == 0


def test_populations_are_flat_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("evaluated", 'a "b", \n c', {"z": 1, "a": 2}, 0.5), ("failed", None, None, None), ("evaluated", "", {}, 1.0)], "status string, name string, params map<string,int>, fitness double")
    schema = "status string, name string, params_json string, fitness double"
    files.write_population(df, f"{tmp_path}/p")
    got = sorted(map(tuple, files.read_population(spark, f"{tmp_path}/p", schema).collect()), key=str)
    assert got == sorted([("evaluated", 'a "b", \n c', '{"a":2,"z":1}', 0.5), ("failed", None, None, None), ("evaluated", "", "{}", 1.0)], key=str)
    files.write_population(df, f"{tmp_path}/q", evaluated=True)
    assert files.read_population(spark, f"{tmp_path}/q", schema).count() == 2
    files.write_population(df.filter("false"), f"{tmp_path}/r")
    assert [tuple(r) for r in files.read_population(spark, f"{tmp_path}/r", "status string").collect()] == [("empty",)]


def test_loop_logs_with_metrics_by_run_round_and_name(spark, tmp_path):
    def loop(index, *updates):
        return json.dumps({"loop_index": index, "records": [{"output_snapshot": {"shared_updates": u}} for u in updates]})

    (tmp_path / "run1").mkdir()
    (tmp_path / "run2").mkdir()
    spec = {"experiment_spec": {"factors": [{"factor_name": "a", "expression": "$old"}, {"factor_name": "b", "expression": "$b", "code": "def f(): ..."}]}}
    report = {"backtest_report": {"per_factor_metrics": {"a": {"IC": 0.01}, "b": {"IC": -0.02, "ICIR": 1}, "weak": {"IC": 0.001}, "none": {}, "bad": {"IC": 0.5}}, "failed_details": [{"name": "bad"}]}}
    (tmp_path / "run1" / "loop_1.json").write_text(loop(1, {"hypothesis": "first"}, spec, {"experiment_spec": {"factors": [{"factor_name": "a", "expression": "$a"}]}, "hypothesis": "last"}, report, report))
    (tmp_path / "run2" / "loop_1.json").write_text(loop(1, {"backtest_report": {"per_factor_metrics": {"a": {"IC": 0.3}, "c": {"IC": 0.3}}}, "failed_details": [{"name": "c"}]}))
    (tmp_path / "run2" / "loop_2.json").write_text("not json")
    got = sorted((r["run_id"], r["loop_round"], r["intra_loop_index"], r["factor_name"], r["factor_file"], r["factor_expression"], r["hypothesis"], r["metrics"]["IC"]) for r in files.read_loop_logs(spark, str(tmp_path)).collect())
    assert got == [("run1", 1, 0, "a", "a.py", "$a", "last", "0.01"), ("run1", 1, 1, "b", "run1_L1_I1_b.py", "$b", "last", "-0.02"), ("run2", 1, 0, "a", "a.py", "Unknown", "No hypothesis found", "0.3")]


def test_code_at_any_depth(spark):
    docs = [
        ("r", "f", '{"loop_index": 3, "unknown": [[{"x": {"factor_name": "a", "code": "old"}}]], "records": [{"output_snapshot": {"shared_updates": {"backtest_report": {"per_factor_metrics": {"a": {"IC": 0.1}, "b": {"IC": 0.1}, "c": {"IC": 0.1}, "d": {"IC": 0.1}}}}}, "later": {"name": "b", "code": "y"}}], "z": {"name": "a", "code": "new", "inner": {"factor_name": "c", "code": ""}}}'),
        ("r", "g", "{broken"), ("r", "h", None), ("s", "f", "[" * 5000 + "]" * 5000),
    ]
    df = spark.createDataFrame(docs, "run_id string, file string, value string")
    assert {r["file"]: r["c"] for r in df.filter("run_id = 'r'").select("file", files.codes_in("value").alias("c")).collect()} == {"f": {"a": "new", "b": "y", "c": ""}, "g": {}, "h": {}}
    assert sorted((r["factor_name"], r["factor_file"]) for r in files.loop_logs(df).collect()) == [("a", "r_L3_I0_a.py"), ("b", "r_L3_I1_b.py"), ("c", "c.py"), ("d", "d.py")]


def test_aliases_in_yaml(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("# names\nbtc: btcusdt\n'eth 2' : \"ethusdt\"  # second\nempty:\n")
    assert sorted(map(tuple, files.read_aliases(spark, f"{tmp_path}/a.yaml").collect())) == [("BTC", "BTCUSDT"), ("ETH 2", "ETHUSDT")]
    (tmp_path / "b.yaml").write_text("a#1: x#y # rest\nb:c: d:e\n\"q: z\":  'w # in'\nnone: # nothing\n- item\n")
    assert sorted(map(tuple, files.read_aliases(spark, f"{tmp_path}/b.yaml").collect())) == [("A#1", "X#Y"), ("B:C", "D:E"), ("Q: Z", "W # IN")]


def test_csv_has_the_types_of_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text('timestamp,symbol,confidence,chunk_id,evidence\n2024-01-01,A,0.5,3,"[""x"",""y""]"\n2024-01-02,B,,,\n')
    found = files.read_market_text(spark, f"{tmp_path}/a.csv")
    kinds = dict(found.dtypes)
    assert (kinds["confidence"], kinds["chunk_id"], kinds["evidence"]) == ("double", "int", "array<string>")
    assert sorted((r["symbol"], r["confidence"], r["chunk_id"], r["evidence"]) for r in found.collect()) == [("A", 0.5, 3, ["x", "y"]), ("B", None, None, None)]


def test_panel_and_table_sinks(spark, sf, tmp_path):
    from factorloom.plans.panel_queries import daily

    df = daily(spark, sf)
    files.write_panel(df, str(tmp_path / "p"))
    assert spark.read.parquet(f"{tmp_path}/p/panel").count() == df.count()
    assert spark.read.json(f"{tmp_path}/p/schema").first()["n_symbols"] == df.select("symbol").distinct().count()
    about = "\n".join(r["value"] for r in spark.read.text(f"{tmp_path}/p/description").collect())
    assert about.startswith("# Panel") and f"- n_rows: {df.count()}" in about
    files.write_table(df.select("symbol", F.create_map(F.lit("a"), "close").alias("m")), f"{tmp_path}/t", "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/t").count() == df.count()


def test_text_stream_replaces_by_source(spark, tmp_path):
    incoming, store = tmp_path / "in", tmp_path / "store"
    incoming.mkdir()
    row = {"timestamp": "2024-01-01", "symbol": "A", "chunk_id": 0}
    (incoming / "1.json").write_text("\n".join(json.dumps(row | {"source_file": f, "title": "old"}) for f in ("f1", "f2")))
    jobs.ingest_text(spark, str(incoming), str(store), f"{tmp_path}/cp").awaitTermination()
    assert jobs.stored_text(spark, str(store)).count() == 2
    (incoming / "2.json").write_text(json.dumps(row | {"source_file": "f1", "title": "new"}))
    jobs.ingest_text(spark, str(incoming), str(store), f"{tmp_path}/cp").awaitTermination()
    assert sorted((r["source_file"], r["title"]) for r in jobs.stored_text(spark, str(store)).collect()) == [("f1", "new"), ("f2", "old")]
    folders = lambda: sorted(str(p.relative_to(store / "data"))[:2] for p in store.glob("data/*/part=*"))
    assert folders().count("1-") == 1  # only the part of the source that came again is written anew
    (incoming / "3.json").write_text(json.dumps(row | {"source_file": "f1", "title": "newest"}))
    jobs.ingest_text(spark, str(incoming), str(store), f"{tmp_path}/cp").awaitTermination()
    assert sorted((r["source_file"], r["title"]) for r in jobs.stored_text(spark, str(store)).collect()) == [("f1", "newest"), ("f2", "old")]
    assert sorted((r["source_file"], r["title"]) for r in jobs.stored_text(spark, str(store), 2).collect()) == [("f1", "new"), ("f2", "old")]
    assert len(folders()) == 4 and jobs.vacuum(spark, str(store)) == 1  # the first version of f1's part
    assert sorted((r["source_file"], r["title"]) for r in jobs.stored_text(spark, str(store), 2).collect()) == [("f1", "new"), ("f2", "old")]
    files.write_market_text(jobs.stored_text(spark, str(store)), f"{tmp_path}/out")
    assert files.read_market_text(spark, f"{tmp_path}/out", "jsonl").count() == 2


def test_commits_are_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    from factorloom.sources.files import TEXT_SCHEMA

    store, publish = str(tmp_path / "store"), jobs._publish
    batch = lambda title, *sources: spark.createDataFrame([("2024-01-01", "A", s, title, 0) for s in sources], "timestamp string, symbol string, source_file string, title string, chunk_id int").select(*(F.col(f.name) if f.name in ("timestamp", "symbol", "source_file", "title", "chunk_id") else F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], TEXT_SCHEMA).schema))
    rows = lambda df: sorted((r["source_file"], r["title"]) for r in df.collect())
    assert jobs.commit_text(spark, store, batch("one", "a", "b"), 0) and not jobs.commit_text(spark, store, batch("again", "a"), 0)
    pinned = jobs.stored_text(spark, store)

    def crash(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(jobs, "_publish", crash)
    with pytest.raises(RuntimeError):
        jobs.commit_text(spark, store, batch("two", "a", "c"), 1)
    assert rows(jobs.stored_text(spark, store)) == [("a", "one"), ("b", "one")]

    def beaten(spark, store, version, entry):
        monkeypatch.setattr(jobs, "_publish", publish)
        assert jobs.commit_text(spark, store, batch("first", "b", "d"), 1)
        return publish(spark, store, version, entry)

    monkeypatch.setattr(jobs, "_publish", beaten)
    assert jobs.commit_text(spark, store, batch("two", "a", "c"), 2)
    assert rows(jobs.stored_text(spark, store)) == [("a", "two"), ("b", "first"), ("c", "two"), ("d", "first")]
    assert rows(pinned) == [("a", "one"), ("b", "one")]  # a reader keeps its version
    assert jobs.vacuum(spark, store, 1) > 0 and rows(jobs.stored_text(spark, store)) == [("a", "two"), ("b", "first"), ("c", "two"), ("d", "first")]
    assert not jobs.commit_text(spark, store, batch("late", "a"), 2) and rows(jobs.stored_text(spark, f"{store}-none")) == []


def test_summaries(spark):
    doc = {"primary_assets": ["BTC"], "evidence": ["e"], "events": [{"symbol": "", "body": "up", "confidence": 7}, {"symbol": "ETH", "body": ""}, {"symbol": "zzz", "body": "x", "asset_role": "Backtest_Example", "timestamp": "2024-02-03"}]}
    docs = spark.createDataFrame([("f", "title", "2024-01-01", json.dumps(doc))], "source_file string, title string, timestamp string, summary_json string").withColumn("timestamp", F.to_timestamp("timestamp"))
    names = spark.createDataFrame([("BTCUSDT",)], "symbol string")
    got = sorted((r["event_no"], r["symbol"], r["confidence"], r["emitted"], str(r["timestamp"])[:10]) for r in text.summary_events(docs, text.default_aliases(names), names).collect())
    assert got == [(0, "BTCUSDT", 1.0, True, "2024-01-01"), (2, "*", 0.6, False, "2024-02-03")]


def test_written_tables_leave_no_shuffle_files(spark):
    import time

    from factorloom.sources.files import SHUFFLES_GO

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before, setting = shuffles(), spark.conf.get(SHUFFLES_GO, None)
    df = files.written(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "sums")
    until = time.time() + 10
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    assert df.count() == 7 and spark.conf.get(SHUFFLES_GO, None) == setting
