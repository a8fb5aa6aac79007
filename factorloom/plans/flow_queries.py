"""Queries on sources, sinks, logs and merges: tables are written in the format in question and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.stats import rounded
from factorloom.operators import diagnostics, evaluate, library, model, panel, text
from factorloom.plans.panel_queries import FACTORS, IC_SQL, LAG_SQL, P1, P2, RANGES, daily, long, r6, scored, sql_rank, sql_stats, table, weekly
from factorloom.plans.text_queries import BARE, COLUMNS, EVENTS_SQL, FILES_SQL, FORM, L1, MERGE_SQL, R1, REJECTED, SIMILAR, code_files, factors, failures, records
from factorloom.sources import files
from factorloom.streaming import jobs

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        def run(spark, sf_dir: str) -> DataFrame:
            return rounded(f(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return run

    return keep


def folder(spark, label: str) -> str:
    return f"{files.run_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query(f"WITH {P1} SELECT datetime, symbol, {r6('open', 'high', 'low', 'close', 'volume', 'vwap', 'returns_1d')} FROM panel")
def panel_scan(spark, sf_dir):
    """A panel written by month and read again, with the keys under their other names."""
    path, other = folder(spark, "panel"), folder(spark, "renamed")
    files.write_panel(daily(spark, sf_dir), path)
    panel.read_panel(spark, f"{path}/panel", strict=True).drop("month").withColumnsRenamed({"datetime": "date", "symbol": "instrument"}).write.parquet(other)
    return panel.read_panel(spark, other)


@query(f"WITH {P2}, n AS (SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols FROM panel) SELECT 'missing_index_level:symbol' AS warning UNION ALL SELECT 'empty_panel' FROM n WHERE rows >= 0 UNION ALL SELECT 'fine:' || symbols FROM n")
def panel_checks(spark, sf_dir):
    """Warnings of a panel without a key, of an empty one, and of a good one, whose assets are counted."""
    df = weekly(spark, sf_dir)
    found = [*panel.warnings(df.drop("symbol")), *panel.warnings(df.filter("false"))]
    fine = panel.universe(df).agg(F.concat(F.lit("fine:"), F.count("*").cast("string")).alias("warning"))
    return spark.createDataFrame([(w,) for w in [*found, *panel.warnings(df)]], "warning string").union(fine)


@query(f"WITH {P2} SELECT DISTINCT datetime FROM panel WHERE datetime NOT BETWEEN '1993-01-01' AND '1996-12-31'")
def panel_outside_window(spark, sf_dir):
    df = weekly(spark, sf_dir)
    return panel.complement(df.select("datetime").distinct(), panel.in_window(df, "1993-01-01", "1996-12-31"))


@query(f"WITH {P2} SELECT datetime, symbol, round((a + b) / 2, 6) AS signal FROM (SELECT datetime, symbol, {sql_rank('close')} AS a, {sql_rank('volume')} AS b FROM panel)")
def signal_fallback(spark, sf_dir):
    df = weekly(spark, sf_dir)
    names = library.resolve_signal_columns("RANK(Close) + vol * nothing", df.columns, {"vol": "volume"})
    return library.fallback_signal(df, names).select("datetime", "symbol", "signal")


@query(f"WITH {R1} SELECT doc_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, symbol, source_file, chunk_id::INT AS chunk_id, sha256(coalesce((SELECT text FROM documents d WHERE d.doc_id = rec.doc_id), '')) AS body_sha256 FROM rec")
def market_text_scan(spark, sf_dir):
    """Market text written as JSON lines and read back."""
    path = folder(spark, "text")
    r = records(spark, sf_dir).withColumns({"timestamp": F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), "url": F.col("doc_id").cast("string"), "symbol": F.upper("symbol")})
    files.write_market_text(r.drop("doc_id"), path)
    found = files.read_market_text(spark, path, "jsonl")
    return found.select(F.col("url").cast("long").alias("doc_id"), "timestamp", "symbol", "source_file", "chunk_id", F.sha2(F.coalesce("body", F.lit("")), 256).alias("body_sha256"))


def event_log(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    path, i = folder(spark, "log"), F.col("event_id")
    line = F.when(i % 7 == 3, F.concat(F.lit('{"name": '), i.cast("string"))).when(i % 11 == 5, "").otherwise(F.to_json(F.struct(F.col("event_type").alias("name"), "value")))
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return files.read_events(spark, path, "name string, value double")


@query(f"WITH {L1}, {FILES_SQL}, n AS (SELECT 'records' AS \"check\", count(*) AS n FROM lib UNION ALL SELECT 'orphan_files', count(*) FROM code WHERE file NOT IN (SELECT file FROM known WHERE file IS NOT NULL) UNION ALL SELECT 'log_lines', count(*) FROM events WHERE event_id % 7 = 3 OR event_id % 11 <> 5 UNION ALL SELECT 'log_lines_valid', count(*) FROM events WHERE event_id % 7 <> 3 AND event_id % 11 <> 5) SELECT * FROM n")
def library_audit_with_logs(spark, sf_dir):
    out = library.audit(factors(spark, sf_dir), code_files(spark, sf_dir), event_log(spark, sf_dir)[1])
    return out.filter(~F.col("check").isin("distinct_expressions", "duplicate_expressions", "duplicate_names")).select("check", "n")


@query("SELECT event_type AS name, count(*) AS n, round(sum(value), 4) AS total, (SELECT count(*) FROM events WHERE event_id % 7 = 3) AS bad_lines FROM events WHERE event_id % 7 <> 3 AND event_id % 11 <> 5 GROUP BY 1")
def event_log_scan(spark, sf_dir):
    """A log with lines that can't be read, which are counted, and blank ones, which aren't."""
    events, counts = event_log(spark, sf_dir)
    bad = counts.agg(F.sum("bad_lines").alias("bad_lines"))
    return events.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).crossJoin(bad)


@query(f"WITH {P2} SELECT datetime, symbol, round(close, 6) AS score, round(returns_1d, 6) AS label FROM panel WHERE volume > 5 AND returns_1d IS NOT NULL AND close IS NOT NULL")
def predictions_scan(spark, sf_dir):
    """Scores and labels from two sinks, joined on their keys."""
    df, a, b = weekly(spark, sf_dir), folder(spark, "scores"), folder(spark, "labels")
    files.write_table(df.filter("volume > 5").select("datetime", "symbol", F.col("close").alias("score")), a, "parquet")
    files.write_table(df.select(F.col("datetime").alias("date"), F.col("symbol").alias("instrument"), F.col("returns_1d").alias("label")), b, "parquet")
    return files.read_predictions(spark, a, b).select("datetime", "symbol", "score", "label")


@query(f"WITH {MERGE_SQL.removeprefix('WITH ')} SELECT doc_id, source_file FROM k WHERE n = 1")
def text_ingest_stream(spark, sf_dir):
    """Stored and new records arrive one after the other in a folder that a stream reads."""
    incoming, store, state = (folder(spark, x) for x in ("incoming", "store", "state"))
    r = records(spark, sf_dir).withColumns({"timestamp": F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), "symbol": F.upper("symbol"), "source": F.col("doc_id").cast("string")})
    new = r.filter("doc_id % 4 = 0").withColumn("source_file", F.when(F.col("doc_id") % 41 < 30, F.col("source_file")).otherwise(""))
    for part in (r.filter("doc_id % 4 != 0"), new):
        part.drop("doc_id").write.mode("append").json(incoming)
        jobs.ingest_text(spark, incoming, store, state).awaitTermination()
    return jobs.stored_text(spark, store).select(F.col("source").cast("long").alias("doc_id"), "source_file")


@query("WITH a AS (SELECT 'f' || (doc_id % 50) AS f, count(*) AS n FROM documents WHERE doc_id % 3 <> 1 GROUP BY 1), b AS (SELECT 'f' || (doc_id % 70) AS f, count(*) AS n FROM documents WHERE doc_id % 3 = 1 GROUP BY 1) SELECT coalesce(b.f, a.f) AS source_file, coalesce(b.n, a.n) AS records FROM a FULL JOIN b ON a.f = b.f")
def text_manifest_merge(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    a, b = (d.filter(own).select(F.concat(F.lit("f"), (i % m).cast("string")).alias("source_file")) for own, m in ((i % 3 != 1, 50), (i % 3 == 1, 70)))
    return text.merge_manifests(text.manifest(a, a), text.manifest(b, b)).select("source_file", "records")


@query(f"WITH {L1}, own AS (SELECT lower(factor_name) AS k, max(lpad(idx::VARCHAR, 8, '0')) AS v FROM lib WHERE idx % 2 = 0 GROUP BY 1), rd AS (SELECT loop_round, max(lpad(idx::VARCHAR, 8, '0')) AS v FROM lib WHERE loop_round < 3 GROUP BY 1) SELECT idx AS intra_loop_index, coalesce(own.v, rd.v) AS v FROM lib LEFT JOIN own ON own.k = lower(factor_name) LEFT JOIN rd ON rd.loop_round = lib.loop_round")
def library_metrics_join(spark, sf_dir):
    f = factors(spark, sf_dir).drop("metrics")
    m = f.withColumn("metrics", F.create_map(F.lit("v"), F.lpad(F.col("intra_loop_index").cast("string"), 8, "0")))
    out = library.join_metrics(f, m.filter("intra_loop_index % 2 = 0").withColumn("factor_name", F.upper("factor_name")), m.filter("loop_round < 3"))
    return out.select("intra_loop_index", F.col("metrics")["v"].alias("v"))


GATE_SQL = f"""WITH {L1}, {SIMILAR}, g AS (SELECT CASE WHEN abs(ic) < 0.003 OR abs(icir) < 0.005 OR coalesce(nullif(turnover, 0), 1) > 0.5 OR coalesce(coverage, 0) < 0.8 OR {REJECTED} IS NOT NULL OR lower(factor_name) IN (SELECT lower(factor_name) FROM lib WHERE idx % 7 >= 3) OR {FORM} IN (SELECT fa FROM j WHERE similarity >= 0.9) THEN 0 ELSE 1 END AS ok FROM lib WHERE idx % 7 < 3)"""


@query(f"{GATE_SQL} SELECT sum(ok)::BIGINT AS accepted, (count(*) - sum(ok))::BIGINT AS rejected, round(avg(ok), 6) AS acceptance_rate FROM g")
def library_gate_counts(spark, sf_dir):
    f = factors(spark, sf_dir)
    return library.gate_summary(library.quality_gate(f.filter("intra_loop_index % 7 < 3"), f.filter("intra_loop_index % 7 >= 3"), COLUMNS))


@query(f"WITH {L1} SELECT idx::VARCHAR AS trajectory_id, round(ic, 6) AS metric FROM lib ORDER BY ic DESC, idx::VARCHAR LIMIT 5")
def search_trajectories(spark, sf_dir):
    return library.best_trajectories(factors(spark, sf_dir).withColumn("trajectory_id", F.col("intra_loop_index").cast("string"))).select("trajectory_id", "metric")


@query(f"WITH {L1} SELECT row_number() OVER (ORDER BY run_id, loop_round, idx) AS place, factor_name FROM lib")
def library_discovery(spark, sf_dir):
    """Factors in the order of their discovery; the place is the number of those before."""
    from pyspark.sql import Window

    log = library.discovery_log(factors(spark, sf_dir))
    keys = ["run_id", "loop_round", "intra_loop_index"]
    before = log.groupBy("run_id", "loop_round").agg(F.count("*").alias("n"))  # a few rounds of a few runs
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("run_id", "loop_round").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = log.withColumn("k", F.row_number().over(Window.partitionBy("run_id", "loop_round").orderBy(keys[2]))).join(before, ["run_id", "loop_round"])
    return out.select((F.col("before") + F.col("k")).alias("place"), "factor_name")


@query(f"WITH {L1}, good AS (SELECT *, row_number() OVER (PARTITION BY run_id, loop_round, lower(factor_name) ORDER BY idx) AS a FROM lib WHERE idx % 2 = 1 AND idx % 7 <> 1 AND abs(ic) >= 0.003), u AS (SELECT *, row_number() OVER (PARTITION BY {BARE} ORDER BY factor_name) AS b FROM good WHERE a = 1 AND {BARE} NOT IN (SELECT {BARE} FROM lib WHERE idx % 2 = 0)) SELECT factor_name, {BARE} AS expression FROM u WHERE b = 1")
def library_rebuild(spark, sf_dir):
    f = factors(spark, sf_dir)
    logs = f.filter("intra_loop_index % 2 = 1").withColumn("rejected", F.col("intra_loop_index") % 7 == 1)
    return library.rebuild(logs, f.filter("intra_loop_index % 2 = 0")).select("factor_name", files.bare("factor_expression").alias("expression"))


_EVOLVED = "CASE WHEN generation > 0 THEN 'evolution' ELSE source END"


@query(f"""WITH {L1}, {EVENTS_SQL}, t AS (SELECT * FROM ev ORDER BY ts DESC, name LIMIT 30), x AS (SELECT *, {_EVOLVED} AS came FROM lib)
SELECT * FROM (SELECT 'top' AS kind, factor_name AS name, round(sharpe, 6) AS value FROM lib ORDER BY abs(sharpe) DESC, factor_name LIMIT 10) UNION ALL SELECT * FROM (SELECT 'evolved', factor_name, round(ic * 2, 6) FROM x WHERE came = 'evolution' ORDER BY abs(ic * 2) DESC, factor_name LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'reason', coalesce(reason, 'unknown') AS v, count(*)::DOUBLE FROM t GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 8) UNION ALL SELECT * FROM (SELECT 'name', name, count(*)::DOUBLE FROM t GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 12)
UNION ALL SELECT * FROM (SELECT 'expression', expression, n::DOUBLE FROM (SELECT expression, count(*) AS n, min(ts) AS at, arg_min(name, ts) AS m FROM t GROUP BY 1 ORDER BY 3, 4, 1 LIMIT 5))
UNION ALL SELECT 'records', 'all', count(*)::DOUBLE FROM lib UNION ALL SELECT 'expressions', 'all', count(DISTINCT {BARE})::DOUBLE FROM lib""")
def knowledge_snapshot(spark, sf_dir):
    """All four tables; evolved factors are those of later generations, their rank IC twice their IC."""
    f = factors(spark, sf_dir).withColumns({"source": F.when(F.col("generation") > 0, "evolution").otherwise(F.col("source")), "metrics": F.map_concat("metrics", F.create_map(F.lit("Rank IC"), (F.col("metrics")["IC"].cast("double") * 2).cast("string")))})
    found = library.knowledge_snapshot(f, failures(spark, sf_dir))
    counts, named = found["counts"], lambda d, kind: d.select(F.lit(kind).alias("kind"), F.col("factor_name").alias("name"), "value")
    out = named(found["top_factors"], "top").union(named(found["top_evolved"], "evolved")).union(found["failures"].select("kind", "value", F.col("n").cast("double")))
    return out.union(counts.select(F.lit("records"), F.lit("all"), F.col("records").cast("double"))).union(counts.select(F.lit("expressions"), F.lit("all"), F.col("distinct_expressions").cast("double")))


def traces(spark, sf_dir) -> DataFrame:
    """Trace records of agents, one a factor: every third as a field of the experiment, the others in its list (some by ``name``, some
    without expression); every fifth is another agent's."""
    i, form, update = F.col("intra_loop_index"), F.col("factor_expression"), lambda spec: F.concat(F.lit('"output_snapshot":{"shared_updates":{"experiment_spec":'), spec, F.lit("}}}"))
    item = F.to_json(F.struct(F.when(i % 2 == 0, F.col("factor_name")).alias("factor_name"), F.when(i % 2 == 1, F.col("factor_name")).alias("name"), F.when(i % 7 > 0, F.concat(F.lit(" "), form)).alias("expression")))
    listed = F.concat(F.lit('{"task_plan":{"steps":[1,{}]},"factors":['), item, F.lit(",5,{}]}"))
    keyed = F.to_json(F.create_map("factor_name", F.struct(form.alias("expression"), F.lit("so").alias("description"))))
    value = F.concat(F.lit('{"agent_name":"'), F.when(i % 5 == 0, "coder").otherwise("designer"), F.lit('",'), update(F.when(i % 3 == 0, keyed).otherwise(listed)), F.lit("}"))
    return factors(spark, sf_dir).select(i.alias("record"), value.alias("value"))


@query(f"WITH {L1} SELECT DISTINCT factor_name FROM lib WHERE idx % 5 <> 0")
def trace_names(spark, sf_dir):
    """Names that an agent proposed in earlier rounds, from trace records written and read again."""
    path = folder(spark, "traces")
    traces(spark, sf_dir).select("value").write.text(path)
    return files.proposed_names(spark.read.text(path), "designer")


@query(f"WITH {L1} SELECT trim(factor_expression) AS expression, min(idx) AS record, count(*) AS n FROM lib WHERE idx % 5 <> 0 AND (idx % 3 = 0 OR idx % 7 > 0) GROUP BY 1")
def trace_expressions(spark, sf_dir):
    """Expressions that an agent proposed in earlier rounds, with the first record of each."""
    return files.proposed_expressions(traces(spark, sf_dir), "designer", order="record")


@query("SELECT upper(c_name) AS alias, 'N' || c_nationkey AS symbol, 'yaml' AS kind FROM customer UNION ALL SELECT upper(s_name), 'N' || s_nationkey, 'json' FROM supplier")
def alias_maps(spark, sf_dir):
    """Aliases from YAML lines (with quotes and comments) and from JSON objects, several files of each."""
    yaml, js = f"{folder(spark, 'aliases')}.yaml", f"{folder(spark, 'aliases')}.json"
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    quote = F.when(k % 3 == 0, '"').when(k % 3 == 1, "'").otherwise("")
    c.select(F.concat(quote, F.lower("c_name"), quote, F.lit(": "), quote, F.lit("n"), F.col("c_nationkey").cast("string"), quote, F.when(k % 2 == 0, "  # known").otherwise("")).alias("value")).write.text(yaml)
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("s_name", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))))).alias("value"))
    s.select("value", "s_nationkey").repartition("s_nationkey").write.partitionBy("s_nationkey").text(js)
    return files.read_aliases(spark, yaml).withColumn("kind", F.lit("yaml")).union(files.read_aliases(spark, js).withColumn("kind", F.lit("json")))


@query(f"WITH {L1} SELECT 'csv' AS kind, factor_name AS name, status, round(fitness, 6) AS fitness, '{{\"generation\":\"' || generation || '\",\"phase\":\"' || phase || '\"}}' AS params_json FROM lib WHERE status = 'evaluated' UNION ALL SELECT 'json', factor_name, status, round(fitness, 6), NULL FROM lib UNION ALL SELECT 'parquet', factor_name, status, round(fitness, 6), NULL FROM lib")
def search_history_sinks(spark, sf_dir):
    """A search's history: evaluated rows as a flat csv with their parameters as JSON, all rows as JSON lines and Parquet, read again."""
    params = F.create_map(F.lit("phase"), F.col("phase"), F.lit("generation"), F.col("generation").cast("string"))
    h = factors(spark, sf_dir).select(F.col("factor_name").alias("name"), "status", "fitness", params.alias("params"))
    a, b, c = (folder(spark, x) for x in ("population", "history", "history"))
    files.write_population(h, a, evaluated=True)
    files.write_table(h, b, "json")
    files.write_table(h, c, "parquet")
    out = files.read_population(spark, a, "name string, status string, fitness double, params_json string").select(F.lit("csv").alias("kind"), "name", "status", "fitness", "params_json")
    for kind, df in (("json", spark.read.schema("name string, status string, fitness double").json(b)), ("parquet", spark.read.parquet(c))):
        out = out.union(df.select(F.lit(kind), "name", "status", "fitness", F.lit(None).cast("string")))
    return out


_LOOP = "idx // 7 % 5"


@query(f"""WITH {L1}, k AS (SELECT *, {_LOOP} AS loop, row_number() OVER (PARTITION BY run_id, {_LOOP}, factor_name ORDER BY idx) AS nth, row_number() OVER (PARTITION BY run_id, {_LOOP} ORDER BY idx) - 1 AS place FROM lib)
SELECT run_id, loop AS loop_round, place::INT AS intra_loop_index, factor_name, CASE WHEN idx % 3 = 0 THEN run_id || '_L' || loop || '_I' || place || '_' ELSE '' END || factor_name || '.py' AS factor_file, factor_expression, 'idea ' || loop AS hypothesis, round(ic, 6) AS ic
FROM (SELECT *, count(*) OVER (PARTITION BY run_id, loop, factor_name) AS twins FROM k) WHERE twins = 1 AND abs(ic) >= 0.003 AND idx % 11 <> 0""")
def loop_log_scan(spark, sf_dir):
    """Loop logs of one file a run and round, with code at various depths among fields that nobody knows. Names
    that a round has twice are left out of both, since a report holds a name once."""
    f = factors(spark, sf_dir).withColumn("loop", (F.floor(F.col("intra_loop_index") / 7) % 5).cast("int"))
    own = Window.partitionBy("run_id", "loop")
    f = f.withColumns({"place": F.row_number().over(own.orderBy("intra_loop_index")) - 1, "twins": F.count("*").over(Window.partitionBy("run_id", "loop", "factor_name")), "unit": F.col("metrics")["IC"]})
    text_of = lambda c: F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)
    name, i = text_of(F.col("factor_name")), F.col("intra_loop_index")
    spec = F.concat(F.lit('{"factor_name":'), name, F.lit(',"expression":'), text_of(F.col("factor_expression")), F.lit(',"odd":[[1,{}],null]}'))
    code = F.concat(F.when(i % 2 == 0, F.lit('{"deep":[{"er":[0,{"factor_name":')).otherwise('{"deep":[{"er":[0,{"name":'), name, F.lit(',"code":"x = 1"}]}]}'))
    metric = F.concat(name, F.lit(':{"IC":'), F.col("unit").cast("string"), F.lit("}"))
    listed = lambda c, keep=None: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("place", c.alias("t"))) if keep is not None else F.struct("place", c.alias("t")))), lambda s: s["t"]), ",")
    docs = f.groupBy("run_id", "loop").agg(listed(spec).alias("specs"), listed(code, i % 3 == 0).alias("codes"), listed(metric).alias("metrics"), listed(F.concat(F.lit('{"name":'), name, F.lit("}")), (i % 11 == 0) | (F.col("twins") > 1)).alias("failed"))
    body = F.concat(F.lit('{"loop_index":'), F.col("loop").cast("string"), F.lit(',"records":[{"output_snapshot":{"shared_updates":{"hypothesis":"idea '), F.col("loop").cast("string"), F.lit('","experiment_spec":{"factors":['), F.col("specs"), F.lit("]}}},\"trace\":["), F.col("codes"), F.lit(']},{"output_snapshot":{"shared_updates":{"backtest_report":{"per_factor_metrics":{'), F.col("metrics"), F.lit('},"failed_details":['), F.col("failed"), F.lit("]}}}}]}"))
    found = files.loop_logs(docs.select("run_id", F.col("loop").cast("string").alias("file"), body.alias("value")))
    return found.withColumn("ic", F.col("metrics")["IC"].cast("double")).drop("metrics")


@query("""WITH r AS (SELECT p_size AS round, p_size % 3 <> 1 AS accepted, avg(p_retailprice) AS price, count(*)::DOUBLE AS parts FROM part GROUP BY 1, 2), l AS (SELECT * FROM r ORDER BY round DESC LIMIT 1), b AS (SELECT * FROM r WHERE accepted AND round < (SELECT round FROM l) ORDER BY round DESC LIMIT 1),
m AS (SELECT 'price' AS metric, l.price AS current, b.price AS best FROM l, b UNION ALL SELECT 'parts', l.parts, b.parts FROM l, b) SELECT metric, round(current, 6) AS current, round(best, 6) AS best, round(current - best, 6) AS change, CASE WHEN current > best THEN 'current' ELSE 'best' END AS larger FROM m""")
def rounds_compare(spark, sf_dir):
    rounds = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("round")).agg(F.avg("p_retailprice").alias("price"), F.count("*").cast("double").alias("parts")).withColumn("accepted", F.col("round") % 3 != 1)
    return evaluate.compare_rounds(rounds, ["price", "parts"])


@query("""WITH g AS (SELECT p_brand AS brand, count(*) AS total, count(CASE WHEN p_size > 20 THEN 1 END) AS generated, count(CASE WHEN p_size < 5 THEN 1 END) AS failed FROM part GROUP BY 1 UNION ALL SELECT 'none', 0, 0, 0),
s AS (SELECT *, generated / nullif(total, 0)::DOUBLE AS c, failed / nullif(total, 0)::DOUBLE AS f FROM g)
SELECT brand, CASE WHEN total > 0 THEN greatest(-1, round(0.9 * c - 0.2 * f, 3)) ELSE 0 END AS sharpe, coalesce(round(0.18 + 0.27 * (1 - c), 3), 1) AS turnover, coalesce(round(0.1 + 0.25 * f, 3), 1) AS drawdown, coalesce(round(c, 3), 0) AS coverage FROM s""")
def default_metrics(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("total"), F.count_if(F.col("p_size") > 20).alias("generated"), F.count_if(F.col("p_size") < 5).alias("failed"))
    none = counts.limit(1).select(F.lit("none").alias("brand"), *(F.lit(0).cast("long").alias(c) for c in ("total", "generated", "failed")))
    return evaluate.default_metrics(counts.unionByName(none)).select("brand", "sharpe", "turnover", "drawdown", "coverage")


@query("SELECT p_partkey, p_brand || '/' || p_type AS name FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 'name' FROM part")
def markdown_names(spark, sf_dir):
    """Names in tables of pages, plain and linked."""
    i, name = F.col("p_partkey"), F.concat_ws("/", "p_brand", "p_type")
    row = F.when(i % 3 == 1, F.concat(F.lit("| ["), name, F.lit("](x.md) | 1 |"))).when(i % 3 == 2, F.concat(F.lit("| "), name, F.lit(" | 2 |"))).otherwise("no table")
    pages = table(spark, sf_dir, "part").select(i, F.concat_ws("\n", F.lit("| name | ic |"), F.lit("|---|:--|"), row).alias("text"))
    return library.markdown_names(pages, keep=["p_partkey"])


@query("SELECT p_partkey, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), ' ') AS words FROM (SELECT p_partkey, list_concat(string_split(p_name, ' '), string_split(lower(p_type), ' ')) AS x FROM part)")
def ordered_words(spark, sf_dir):
    """The words of two texts, each once, in order."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(library.ordered_union(F.split("p_name", " "), F.split(F.lower("p_type"), " ")), " ").alias("words"))


_GROUPS = f"""gb AS (SELECT *, row_number() OVER (PARTITION BY factor, datetime ORDER BY value DESC, symbol) AS rn, count(*) OVER (PARTITION BY factor, datetime) // 5 AS z FROM long WHERE value IS NOT NULL),
gr AS (SELECT factor, datetime, {', '.join(f'avg(CASE WHEN z > 0 AND (rn - 1) // z = {i} THEN target END) AS g{i}' for i in range(5))} FROM gb GROUP BY 1, 2)"""


@query(f"""WITH {LAG_SQL}, {IC_SQL[IC_SQL.index('ranked AS'):]}, {_GROUPS}, ra AS (SELECT factor, datetime, {sql_rank('value', 'factor, datetime')} AS a, {sql_rank('old', 'factor, datetime')} AS b FROM o), ac AS (SELECT factor, datetime, covar_samp(CASE WHEN b IS NOT NULL THEN a END, CASE WHEN a IS NOT NULL THEN b END) / nullif(stddev_samp(CASE WHEN b IS NOT NULL THEN a END) * stddev_samp(CASE WHEN a IS NOT NULL THEN b END), 0) AS c FROM ra GROUP BY 1, 2),
i AS (SELECT factor, {sql_stats('ic', 'ic', True)} FROM ics WHERE ic IS NOT NULL GROUP BY 1), an AS (SELECT factor, round(avg(g0 - g4) * 252, 6) AS annual_return FROM gr WHERE coalesce(g0, g1, g2, g3, g4) IS NOT NULL GROUP BY 1), am AS (SELECT factor, round(avg(c), 6) AS autocorrelation FROM ac GROUP BY 1)
SELECT factor, ic_mean, ic_dates, annual_return, autocorrelation FROM i JOIN an USING (factor) JOIN am USING (factor) WHERE factor = 'reversal'""")
def diagnostic_summary(spark, sf_dir):
    tables = diagnostics.diagnostic_tables(scored(spark, sf_dir), "reversal", "returns_1d")
    return tables["summary"].select("factor", "ic_mean", "ic_dates", "annual_return", "autocorrelation")


@query(None)
def library_backtest(spark, sf_dir):
    """A small library screened, fitted and judged on the last years."""
    rows = [("r", 0, i, n, e) for i, (n, e) in enumerate({**FACTORS, "broken": "RANK($nothing)", "size": "RANK($amount)"}.items())]
    lib = spark.createDataFrame(rows, "run_id string, loop_round int, intra_loop_index int, factor_name string, factor_expression string")
    return model.library_backtest(weekly(spark, sf_dir), lib, RANGES, min_factors=1, min_ic=0.0, min_icir=0.0)["analysis"]


@query(None)
def model_importances(spark, sf_dir):
    frame, features = model.feature_matrix(scored(spark, sf_dir), list(FACTORS), "returns_1d")
    return model.importances(model.train_boosted(panel.segments(frame, RANGES), features, "returns_1d"), features, spark)


@query(f"WITH {IC_SQL} SELECT factor, count(*) AS n FROM ics GROUP BY 1")
def ic_days(spark, sf_dir):
    return evaluate.daily_metrics(long(spark, sf_dir)).filter("pairs >= 2").groupBy("factor").agg(F.count("*").alias("n"))
