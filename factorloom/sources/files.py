"""Files as tables: market text, reports, factor libraries, run logs; and sinks."""

from __future__ import annotations

import json
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructType

from factorloom.functions.stats import strip

TEXT_SCHEMA = "timestamp string, symbol string, source string, title string, body string, url string, source_file string, event_type string, confidence double, chunk_id int, direction string, asset_role string, primary_assets array<string>, ignored_mentions array<struct<mention:string,reason:string>>, evidence array<string>"
RECORD_SCHEMA = "run_id string, hypothesis string, loop_round int, intra_loop_index int, factor_name string, factor_expression string, factor_file string, metrics map<string,string>, generation int, parent_1 string, parent_2 string, source string, fitness double"
REPORT_GLOB = "*.{txt,md,markdown,html,htm}"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of all intermediate tables of this application."""
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Removes the intermediate tables of this application. Results that weren't written elsewhere can't be read any more."""
    removed(spark, run_dir(spark))


def removed(spark: SparkSession, path: str) -> None:
    """Removes a table (or folder) that nothing reads any more."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


#: With this setting, Spark deletes a query's shuffle files at its end; otherwise they stay until the driver happens to collect garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` as by ``written``, and the path, for ``removed``."""
    spark = df.sparkSession
    path, before = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}", spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that later steps don't compute it again. The shuffle files of its making go."""
    return kept(df, label)[0]


def read_market_text(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Text records from .jsonl, .json (one array) or .csv."""
    kind = kind or path.rpartition(".")[2].lower()
    if kind == "jsonl":
        return spark.read.schema(TEXT_SCHEMA).json(path)
    if kind == "json":
        return spark.read.schema(TEXT_SCHEMA).option("multiLine", True).json(path)
    if kind == "csv":
        text = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        kinds = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(TEXT_SCHEMA)}
        return text.select(*(F.from_json(c, kinds[c]).alias(c) if kinds.get(c, "").startswith("array") else F.col(c).try_cast(kinds.get(c, "string")).alias(c) for c in text.columns))
    raise ValueError(f"unsupported_text_format:.{kind}")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, modified, text) of all reports below a folder."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=REPORT_GLOB)
    return files.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


def read_events(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(events, counts) of a JSONL log: lines that can't be read are left out and counted by file; blank lines are neither."""
    lines = spark.read.text(path).select(F.col("value"), F.input_file_name().alias("file")).filter(F.trim("value") != "")
    parsed = lines.withColumns({"ok": F.try_parse_json("value").isNotNull() & F.rtrim("value").endswith("}"), "e": F.from_json("value", schema)})
    events = parsed.filter("ok and e is not null").select("e.*")
    counts = parsed.groupBy("file").agg(F.count_if("ok").alias("events"), F.count_if(~F.col("ok")).alias("bad_lines"))
    return events, counts


def bare(expression: Column | str) -> Column:
    """An expression without white space, by which expressions are held to be the same."""
    return F.regexp_replace(expression, r"\s+", "")


def records_of(documents: DataFrame, text: str = "value") -> DataFrame:
    """Factor records of JSON documents in any of four layouts: {records: []}, {factors: {id: record}}, [records], one record.

    Adds ``factor_key`` (the id in the map layout) and ``position`` in the document. Names may also be called name,
    expressions expression, as older files do.
    """
    one = f"struct<{', '.join(f'{n}:{t}' for n, t in (x.split(' ', 1) for x in RECORD_SCHEMA.split(', ')))}, name:string, expression:string>"
    head = F.substring(F.ltrim(F.col(text)), 1, 1)
    whole = F.from_json(text, f"records array<{one}>, factors map<string,{one}>")
    listed = F.from_json(text, f"array<{one}>")
    single = F.from_json(text, one)
    entry = lambda k, r: F.struct(k.alias("factor_key"), r.alias("record"))
    none = F.lit(None).cast("string")
    found = F.when(head == "[", F.transform(listed, lambda r: entry(none, r)))
    found = found.when(whole["records"].isNotNull(), F.transform(whole["records"], lambda r: entry(none, r)))
    found = found.when(whole["factors"].isNotNull(), F.transform(F.map_entries(whole["factors"]), lambda e: entry(e["key"], e["value"])))
    found = found.otherwise(F.array(entry(none, single)))
    rows = documents.select(*(c for c in documents.columns if c != text), F.posexplode(found).alias("position", "e"))
    names = [x.split(" ")[0] for x in RECORD_SCHEMA.split(", ")]
    rest = [F.col(f"e.record.{n}").alias(n) for n in names if n not in ("factor_name", "factor_expression")]
    name, expression = F.coalesce("e.record.factor_name", "e.record.name", "e.factor_key"), F.coalesce("e.record.factor_expression", "e.record.expression")
    out = rows.select(*(c for c in rows.columns if c not in ("e", "position")), "position", F.col("e.factor_key").alias("factor_key"), name.alias("factor_name"), expression.alias("factor_expression"), *rest)
    return out.filter("factor_expression is not null")


def read_libraries(spark: SparkSession, paths: list[str], unique: bool = True) -> DataFrame:
    """Factor records of JSON files; of equal expressions (without spaces) the first file's first record stays."""
    parts = [spark.read.text(p, wholetext=True).select("value", F.lit(i).alias("priority"), F.input_file_name().alias("library")) for i, p in enumerate(paths)]
    docs = parts[0]
    for p in parts[1:]:
        docs = docs.unionByName(p)
    records = records_of(docs)
    return first_of(records, bare("factor_expression"), ["priority", "library", "position"]) if unique else records


def first_of(df: DataFrame, key: Column, order: list[str | Column]) -> DataFrame:
    """One row of each key: the first in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Factors of loop logs {run_id, loops: [{loop_round, factors: [{factor_name, factor_expression, metrics, rejected}], specs: [{factor_name, hypothesis}]}]}."""
    factor = "struct<factor_name:string,factor_expression:string,metrics:map<string,double>,rejected:boolean>"
    schema = f"run_id string, loops array<struct<loop_round:int, factors:array<{factor}>, specs:array<struct<factor_name:string,hypothesis:string>>>>"
    runs = spark.read.schema(schema).option("multiLine", True).json(path)
    loops = runs.select("run_id", F.explode("loops").alias("l"))
    factors = loops.select("run_id", "l.loop_round", F.posexplode("l.factors").alias("intra_loop_index", "f")).select("run_id", "loop_round", "intra_loop_index", "f.*")
    specs = loops.select("run_id", "l.loop_round", F.explode("l.specs").alias("s")).select("run_id", "loop_round", "s.*").dropDuplicates(["run_id", "loop_round", "factor_name"])
    return factors.join(specs, ["run_id", "loop_round", "factor_name"], "left")


_DETAIL = "array<struct<name:string>>"
LOOP_SCHEMA = (
    "loop_index int, records array<struct<output_snapshot:struct<shared_updates:struct<hypothesis:string, experiment_spec:struct<factors:array<struct<factor_name:string,expression:string>>>, "
    f"backtest_report:struct<per_factor_metrics:map<string,map<string,string>>, failed_details:{_DETAIL}>, failed_details:{_DETAIL}>>>>"
)


@F.pandas_udf(MapType(StringType(), StringType()))
def codes_in(document: pd.Series) -> pd.Series:
    """Code by factor name, from all objects at any depth that have a name (factor_name, else name) and code; of several for one
    name the last in the document counts."""

    def one(text: str | None) -> dict[str, str]:
        try:
            waiting, found = [json.loads(text)], {}
        except (TypeError, ValueError, RecursionError):
            return {}
        while waiting:
            x = waiting.pop()
            if isinstance(x, dict):
                name = x.get("factor_name") if "factor_name" in x and "code" in x else x.get("name")
                if "code" in x and ("factor_name" in x or "name" in x) and isinstance(name, str):
                    found[name] = x["code"] if isinstance(x["code"], str) else json.dumps(x["code"]) if x["code"] else ""
                waiting += reversed(list(x.values()))
            elif isinstance(x, list):
                waiting += reversed(x)
        return found

    return document.map(one)


def read_loop_logs(spark: SparkSession, path: str, min_ic: float = 0.003) -> DataFrame:
    """``loop_logs`` of a folder of runs (run/loop_*.json)."""
    file = F.col("_metadata.file_path")
    docs = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="loop_*.json")
    return loop_logs(docs.select(F.element_at(F.split(file, "/"), -2).alias("run_id"), file.alias("file"), "value"), min_ic)


def loop_logs(docs: DataFrame, min_ic: float = 0.003) -> DataFrame:
    """Factors of rounds, given as (run_id, file, value: the round's log as JSON), with the metrics of their backtest reports.

    A factor counts once for each run, round and name, at its place in its report, unless the report lists it as failed or its
    IC is too small (or missing). Hypothesis and expressions are the last that the round names. A factor's code may stand
    anywhere in the log (see ``codes_in``); where there is some, its file has the standard name. What isn't JSON goes.
    """
    docs = docs.select("run_id", "file", F.from_json("value", LOOP_SCHEMA).alias("d"), codes_in("value").alias("codes")).filter("d is not null")
    updates = F.transform("d.records", lambda r: r["output_snapshot"]["shared_updates"])
    docs = docs.select("run_id", "file", "codes", F.coalesce("d.loop_index", F.lit(0)).alias("loop_round"), F.filter(updates, lambda u: u.isNotNull()).alias("u"))
    said = F.filter(F.transform("u", lambda u: u["hypothesis"]), lambda h: h.isNotNull())
    specs = F.flatten(F.filter(F.transform("u", lambda u: u["experiment_spec"]["factors"]), lambda x: x.isNotNull()))
    docs = docs.withColumns({"hypothesis": F.coalesce(F.try_element_at(said, F.lit(-1)), F.lit("No hypothesis found")), "specs": specs})
    reports = docs.select("run_id", "file", "codes", "loop_round", "hypothesis", "specs", F.posexplode("u").alias("record_no", "u"))
    bad = F.transform(F.coalesce(F.when(F.size("u.backtest_report.failed_details") > 0, F.col("u.backtest_report.failed_details")), F.col("u.failed_details"), F.array().cast(_DETAIL)), lambda x: x["name"])
    rows = reports.withColumn("bad", bad).select("run_id", "file", "codes", "loop_round", "hypothesis", "specs", "record_no", "bad", F.posexplode(F.map_entries("u.backtest_report.per_factor_metrics")).alias("intra_loop_index", "e"))
    rows = rows.select("*", F.col("e.key").alias("factor_name"), F.col("e.value").alias("metrics"))
    rows = rows.filter(~F.coalesce(F.array_contains("bad", F.col("factor_name")), F.lit(False)) & (F.abs(F.coalesce(F.col("metrics")["IC"].try_cast("double"), F.lit(0.0))) >= min_ic))
    rows = first_of(rows, F.struct("run_id", "loop_round", "factor_name"), ["file", "record_no", "intra_loop_index"])
    own = F.try_element_at(F.filter("specs", lambda x: x["factor_name"] == F.col("factor_name")), F.lit(-1))
    standard = F.concat("run_id", F.lit("_L"), F.col("loop_round").cast("string"), F.lit("_I"), F.col("intra_loop_index").cast("string"), F.lit("_"), "factor_name", F.lit(".py"))
    named = F.when(F.coalesce(F.try_element_at("codes", F.col("factor_name")), F.lit("")) != "", standard).otherwise(F.concat("factor_name", F.lit(".py")))
    return rows.select("run_id", "loop_round", "intra_loop_index", "factor_name", named.alias("factor_file"), F.coalesce(own["expression"], F.lit("Unknown")).alias("factor_expression"), "hypothesis", "metrics")


def proposals(traces: DataFrame, agent: str, text: str = "value", order: str | None = None) -> DataFrame:
    """(record, layout, place, factor_name, expression, described): what an agent's trace records (JSON) proposed, in both layouts of an experiment.

    ``list``: the entries of its ``factors``, by factor_name, else name. ``key``: any of its fields that is an object; it is
    ``described`` if it has a description, formulation or expression. Names of a list and expressions are stripped; those without are null.
    ``order`` is the column that records are told apart and ordered by (their text, if not given). What isn't of this form is skipped.
    """
    one = "struct<factor_name:string,name:string,expression:string>"
    record = F.from_json(text, "agent_name string, output_snapshot struct<shared_updates:struct<experiment_spec:map<string,string>>>")
    spec = traces.select(F.col(order or text).alias("record"), record.alias("r")).filter(F.col("r.agent_name") == agent).select("record", F.col("r.output_snapshot.shared_updates.experiment_spec").alias("spec"))
    said = lambda c: F.when(strip(c) != "", strip(c))
    fields = spec.select("record", F.posexplode("spec").alias("place", "key", "body"))
    listed = fields.filter("key = 'factors'").select("record", F.posexplode(F.from_json("body", "array<string>")).alias("place", "item")).withColumn("f", F.from_json("item", one))
    listed = listed.select("record", F.lit("list").alias("layout"), "place", said(F.when(F.col("f.factor_name") != "", F.col("f.factor_name")).otherwise(F.col("f.name"))).alias("factor_name"), said(F.col("f.expression")).alias("expression"), F.lit(True).alias("described"))
    inner = F.from_json("body", "map<string,string>")
    keyed = fields.filter(F.ltrim("body").startswith("{")).withColumn("f", inner).filter("f is not null")
    described = F.arrays_overlap(F.map_keys("f"), F.array(F.lit("description"), F.lit("formulation"), F.lit("expression")))
    return listed.union(keyed.select("record", F.lit("key"), "place", "key", said(F.try_element_at("f", F.lit("expression"))), described))


def proposed_names(traces: DataFrame, agent: str, text: str = "value") -> DataFrame:
    """(factor_name): the distinct names that an agent proposed before."""
    return proposals(traces, agent, text).filter("described and factor_name is not null").select("factor_name").distinct()


def proposed_expressions(traces: DataFrame, agent: str, text: str = "value", order: str | None = None) -> DataFrame:
    """(expression, record, n): the distinct expressions that an agent proposed before, the record that did so first, and how often."""
    found = proposals(traces, agent, text, order).filter("expression is not null")
    return found.groupBy("expression").agg(F.min("record").alias("record"), F.count("*").alias("n"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, symbol) of a JSON object or of a flat YAML mapping (.yaml, .yml), both upper-cased; empty ones go."""
    if path.lower().endswith((".yaml", ".yml")):
        line = r"""^\s*(?:"([^"]*)"|'([^']*)'|([^\s#"'].*?))\s*:(?:\s+(?:"([^"]*)"|'([^']*)'|([^\s#"'].*?)))\s*(?:\s#.*)?$"""
        part = lambda *groups: F.concat(*(F.regexp_extract("value", line, g) for g in groups))
        pairs = spark.read.text(path).select(part(1, 2, 3).alias("alias"), part(4, 5, 6).alias("symbol"))
    else:
        pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("alias", "symbol"))
    return pairs.filter((F.trim("alias") != "") & (F.trim("symbol") != "")).select(F.upper("alias").alias("alias"), F.upper("symbol").alias("symbol"))


def write_panel(df: DataFrame, path: str) -> None:
    """Parquet by month and in the order of date and asset within a file; beside it one row that describes it, and the same
    as text in Markdown."""
    from factorloom.operators.panel import summary

    out = df.withColumn("month", F.date_format("datetime", "yyyy-MM"))
    out.repartitionByRange("month", "datetime").sortWithinPartitions("datetime", "symbol").write.mode("overwrite").partitionBy("month").parquet(f"{path}/panel")
    about = summary(df)
    about.write.mode("overwrite").json(f"{path}/schema")
    line = lambda c: F.concat(F.lit(f"- {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("")))
    about.select(F.concat_ws("\n", F.lit("# Panel"), F.lit(""), *(line(c) for c in about.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/description")


def write_market_text(new: DataFrame, path: str, stored: DataFrame | None = None) -> None:
    """JSONL; with ``stored`` records of re-read sources replaced (see ``text.merge_records``)."""
    from factorloom.operators.text import merge_records

    out = new if stored is None else merge_records(stored, new)[0]
    out.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_table(df: DataFrame, path: str, kind: str) -> None:
    """Predictions, importances, metrics and search histories as csv, json or parquet; nested columns as JSON in csv."""
    if kind == "csv":
        df = df.select(*(F.to_json(c).alias(c) if t.startswith(("struct", "map", "array")) else F.col(c) for c, t in df.dtypes))
        df.write.mode("overwrite").option("header", True).csv(path)
    elif kind in ("json", "parquet"):
        getattr(df.write.mode("overwrite"), kind)(path)
    else:
        raise ValueError(f"kind {kind!r}")


def write_population(history: DataFrame, path: str, evaluated: bool = False) -> None:
    """A search's history as one flat csv: maps and other nested columns as JSON with sorted keys, in ``<column>_json``; ``evaluated``:
    only rows of that status. Without rows there is one whose status is ``empty``."""
    rows = history.filter(F.col("status") == "evaluated") if evaluated else history
    if rows.isEmpty():
        rows = history.sparkSession.createDataFrame([("empty",)], "status string")
    flat = []
    for c, t in rows.dtypes:
        ordered = F.map_from_entries(F.array_sort(F.map_entries(c))) if t.startswith("map") else F.col(f"`{c}`")
        flat.append(F.to_json(ordered).alias(f"{c}_json") if t.startswith(("struct", "map", "array")) else F.col(f"`{c}`"))
    rows.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).option("nullValue", "\\N").csv(path)


def read_population(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_population`` wrote, with types; JSON stays text."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", "\\N").csv(path)


def read_predictions(spark: SparkSession, scores: str, labels: str, label: str = "label") -> DataFrame:
    """Scores joined with their labels; rows with either missing go."""
    from factorloom.operators.panel import normalise

    a, b = normalise(spark.read.parquet(scores)), normalise(spark.read.parquet(labels))
    return a.join(b.select("datetime", "symbol", F.col(label).alias("label")), ["datetime", "symbol"]).dropna(subset=["score", "label"])
