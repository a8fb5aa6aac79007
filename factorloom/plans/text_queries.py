"""Queries on market text, reports and factor libraries, which are derived from documents, pages and part."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.stats import rounded
from factorloom.operators import library, text
from factorloom.plans.panel_queries import P1, daily, table
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


#: Words of the supplied prose, by the same five kinds as the default lexicon.
WORDS = {"positive": ["the", "les", "und"], "negative": ["of", "der", "que"], "risk": ["there", "von"], "policy": ["not", "pour"], "liquidity": ["of the", "with"]}


def records(spark, sf_dir) -> DataFrame:
    """Market text of the documents: one every six minutes, every tenth for the whole market, some of unknown symbols."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    symbol = F.when(i % 10 == 0, "*").when(i % 17 == 0, "nobody").otherwise((i % 150).cast("string"))
    return d.select(i, F.timestamp_seconds(F.lit(1704060000) + i * 360).alias("timestamp"), symbol.alias("symbol"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("body"), F.concat(F.lit("doc"), (i % 41).cast("string")).alias("source_file"), F.lit(None).cast("string").alias("url"), (i % 3).cast("int").alias("chunk_id"))


R1 = """rec AS (SELECT doc_id, TIMESTAMP '2023-12-31 22:00:00' + INTERVAL 6 MINUTE * doc_id AS ts, CASE WHEN doc_id % 10 = 0 THEN '*' WHEN doc_id % 17 = 0 THEN 'NOBODY' ELSE (doc_id % 150)::VARCHAR END AS symbol,
  lower(left(text, 60) || ' ' || text) AS t, left(text, 60) AS title, 'doc' || (doc_id % 41) AS source_file, doc_id % 3 AS chunk_id FROM documents)"""


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" if " " in w else f"regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_]){w}([^\\p{{L}}\\p{{N}}_]|$)')" for w in words) + ")"


def _count(words) -> str:
    return " + ".join(f"{_any([w])}::INT" for w in words)


F1 = f"""{P1}, {R1}, f AS (SELECT doc_id, ts, symbol, 1.0 AS news_count, (({_count(WORDS['positive'])}) - ({_count(WORDS['negative'])}))::DOUBLE / greatest(1, {_count(WORDS['positive'])} + {_count(WORDS['negative'])}) AS news_sentiment_score,
  {_any(WORDS['risk'])}::DOUBLE AS risk_event_count, {_any(WORDS['policy'])}::DOUBLE AS policy_event_flag, {_any(WORDS['liquidity'])}::DOUBLE AS liquidity_event_score FROM rec),
c AS (SELECT DISTINCT datetime FROM panel), s AS (SELECT DISTINCT symbol FROM panel), a AS (SELECT f.*, c.datetime FROM f ASOF JOIN c ON f.ts >= c.datetime),
x AS (SELECT a.* REPLACE (s.symbol AS symbol) FROM a JOIN s ON a.symbol = '*' OR a.symbol = s.symbol),
tf AS (SELECT datetime, symbol, {', '.join(f'sum({c}) AS {c}' for c in text.FEATURES)} FROM x GROUP BY 1, 2)"""
_R = ", ".join(f"round({c}, 6) AS {c}" for c in text.FEATURES)


@query(f"WITH {P1}, {R1}, c AS (SELECT DISTINCT datetime FROM panel) SELECT rec.doc_id, c.datetime FROM rec ASOF JOIN c ON rec.ts >= c.datetime")
def text_asof_bars(spark, sf_dir):
    return text.align_to_bars(records(spark, sf_dir).select("doc_id", "timestamp"), daily(spark, sf_dir).select("datetime")).select("doc_id", "datetime")


@query(f"WITH {P1}, {R1} SELECT DISTINCT rec.symbol FROM rec WHERE symbol <> '*' AND symbol NOT IN (SELECT symbol FROM panel)")
def text_unknown_symbols(spark, sf_dir):
    found = records(spark, sf_dir).withColumn("symbol", F.upper("symbol"))
    return text.unknown_symbols(found, daily(spark, sf_dir))


@query(f"WITH {F1} SELECT datetime, symbol, {_R} FROM tf")
def text_features(spark, sf_dir):
    return text.text_features(records(spark, sf_dir), daily(spark, sf_dir), WORDS)


@query(f"WITH {F1} SELECT panel.datetime, panel.symbol, round(close, 6) AS close, {', '.join(f'round(coalesce({c}, 0), 6) AS {c}' for c in text.FEATURES)} FROM panel LEFT JOIN tf ON tf.datetime = panel.datetime AND tf.symbol = panel.symbol")
def text_unified_panel(spark, sf_dir):
    return text.unified_panel(daily(spark, sf_dir), records(spark, sf_dir), WORDS).select("datetime", "symbol", "close", *text.FEATURES)


@query(None)
def report_records(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    reports = pages.select(F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".html")).alias("source_file"), F.timestamp_seconds(F.lit(1704067200) + F.col("page_id")).alias("modified"), F.col("html").alias("text"))
    names = spark.createDataFrame([("LES",), ("THE",), ("UNDUSDT",), ("QUE",)], "symbol string")
    return text.report_records(reports, names)


#: White space of any kind, as SQL's regular expressions name it.
SQL_BLANK = r"[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, '^{SQL_BLANK}+|{SQL_BLANK}+$', '', 'g')), lambda x: x <> '') AS k FROM documents)
SELECT doc_id, len(k) AS n_lines, sha256(array_to_string(k, chr(10))) AS tidy_sha256 FROM l""")
def text_tidy_lines(spark, sf_dir):
    tidy = text.tidy_lines(F.coalesce("text", F.lit("")))
    n_lines = F.when(tidy == "", 0).otherwise(F.size(F.split(tidy, "\n")))
    return table(spark, sf_dir, "documents").select("doc_id", n_lines.cast("bigint").alias("n_lines"), F.sha2(tidy, 256).alias("tidy_sha256"))


@query(None)
def text_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.chunks_of(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")), 500, None)).alias("chunk_id", "chunk"))
    return d.select("doc_id", "chunk_id", F.length("chunk").alias("n_chars"))


MERGE_SQL = f"""WITH {R1}, st AS (SELECT *, 0 AS o FROM rec WHERE doc_id % 4 <> 0 AND doc_id % 41 NOT IN (SELECT doc_id % 41 FROM documents WHERE doc_id % 4 = 0 AND doc_id % 41 < 30)), nw AS (SELECT *, 1 AS o FROM rec WHERE doc_id % 4 = 0 AND doc_id % 41 < 30 UNION ALL SELECT * REPLACE ('' AS source_file), 1 FROM rec WHERE doc_id % 4 = 0 AND doc_id % 41 >= 30),
b AS (SELECT * FROM st UNION ALL SELECT * FROM nw), k AS (SELECT *, row_number() OVER (PARTITION BY source_file, chunk_id, ts, symbol, title ORDER BY o) AS n FROM b)"""


def merged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A quarter of the records merged into the rest: those of most sources replace what is stored of them, others name none."""
    r = records(spark, sf_dir)
    new = r.filter("doc_id % 4 = 0").withColumn("source_file", F.when(F.col("doc_id") % 41 < 30, F.col("source_file")).otherwise(""))
    return text.merge_records(r.filter("doc_id % 4 != 0"), new)


@query(f"{MERGE_SQL} SELECT doc_id, source_file FROM k WHERE n = 1")
def text_replace_by_source(spark, sf_dir):
    return merged(spark, sf_dir)[0].select("doc_id", "source_file")


@query(f"{MERGE_SQL} SELECT count(CASE WHEN n = 1 THEN 1 END) AS records, count(CASE WHEN n = 1 AND o = 1 THEN 1 END) AS \"new\", count(CASE WHEN n > 1 THEN 1 END) AS duplicates FROM k")
def text_merge_counts(spark, sf_dir):
    return merged(spark, sf_dir)[1]


@query("SELECT source_file, count(*) AS records, 'ingested' AS status, NULL::VARCHAR AS reason FROM (SELECT 'doc' || (doc_id % 41) AS source_file FROM documents) GROUP BY 1")
def text_manifest(spark, sf_dir):
    r = records(spark, sf_dir)
    return text.manifest(r, r).select("source_file", "records", "status", "reason")


@query("""WITH n AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'sup-' || (doc_id % 30) WHEN 1 THEN 'SUP' || (doc_id % 30) || 'USDT' WHEN 2 THEN '' WHEN 3 THEN 'sup.' || (doc_id % 60) ELSE 'other' END AS raw FROM documents),
u AS (SELECT doc_id, raw, replace(replace(replace(replace(upper(raw), '-', ''), '.', ''), '_', ''), 'USDT', '') AS base FROM n)
SELECT doc_id, CASE WHEN raw = '' THEN NULL WHEN base IN (SELECT 'SUP' || s_suppkey FROM supplier WHERE s_suppkey < 40) THEN base || 'USDT' ELSE '*' END AS symbol FROM u""")
def symbol_mapping(spark, sf_dir):
    i = F.col("doc_id")
    raw = F.when(i % 5 == 0, F.concat(F.lit("sup-"), (i % 30).cast("string"))).when(i % 5 == 1, F.concat(F.lit("SUP"), (i % 30).cast("string"), F.lit("USDT"))).when(i % 5 == 2, "").when(i % 5 == 3, F.concat(F.lit("sup."), (i % 60).cast("string"))).otherwise("other")
    symbols = table(spark, sf_dir, "supplier").filter("s_suppkey < 40").select(F.concat(F.lit("SUP"), F.col("s_suppkey").cast("string"), F.lit("USDT")).alias("symbol"))
    return text.map_symbols(table(spark, sf_dir, "documents").select(i, raw.alias("raw")), text.default_aliases(symbols), symbols).select("doc_id", "symbol")


@query(f"""WITH {P1}, {R1}, u AS (SELECT DISTINCT symbol FROM panel), e AS (SELECT *, (SELECT body FROM (SELECT doc_id AS d, left(regexp_replace(coalesce(text, ''), '^{SQL_BLANK}+|{SQL_BLANK}+$', '', 'g'), 4000) AS body FROM documents) x WHERE x.d = rec.doc_id) AS body, CASE doc_id % 6 WHEN 0 THEN 'backtest_example' WHEN 1 THEN 'Illustration' WHEN 2 THEN 'example' END AS role FROM rec),
m AS (SELECT *, CASE WHEN symbol IN (SELECT symbol FROM u) THEN symbol ELSE '*' END AS mapped FROM e WHERE body <> '')
SELECT doc_id, source_file, mapped AS symbol, coalesce(role, CASE WHEN mapped = '*' THEN 'market_wide_or_non_panel_primary' ELSE 'panel_primary' END) AS asset_role, sha256(body) AS body_sha256, CASE WHEN doc_id % 4 = 0 THEN 0.6 ELSE round(least(1.0, doc_id / 500.0), 4) END AS confidence, ts AS "timestamp", coalesce(lower(role) NOT IN ('backtest_example', 'illustration'), true) AS emitted FROM m""")
def document_summaries(spark, sf_dir):
    d, i = records(spark, sf_dir), F.col("doc_id")
    role = F.when(i % 6 == 0, "backtest_example").when(i % 6 == 1, "Illustration").when(i % 6 == 2, "example")
    event = F.struct(F.col("symbol"), role.alias("asset_role"), F.col("title"), F.col("body"), F.when(i % 4 != 0, i / 500).alias("confidence"))
    docs = d.select(F.concat_ws(":", "source_file", "doc_id").alias("source_file"), "title", "timestamp", F.to_json(F.struct(F.array(event).alias("events"))).alias("summary_json"))
    symbols = daily(spark, sf_dir).select("symbol").distinct()
    found = text.summary_events(docs, text.default_aliases(symbols), symbols)
    return found.select(F.substring_index("source_file", ":", -1).cast("long").alias("doc_id"), F.substring_index("source_file", ":", 1).alias("source_file"), "symbol", "asset_role", F.sha2("body", 256).alias("body_sha256"), "confidence", "timestamp", "emitted")


@query("SELECT event_id, regexp_extract(props, '\"k\": (\\d+)', 1)::DOUBLE AS k, (event_id::VARCHAR || props) AS \"key\", left(md5(props), 16) AS factor_id, left(sha1(props), 16) AS document_id FROM events")
def map_and_hash_scalars(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    numbers = library.numeric_metrics(F.from_json("props", "map<string,string>"))
    return e.select("event_id", F.coalesce(numbers["K"], numbers["k"]).alias("k"), F.concat(F.col("event_id").cast("string"), "props").alias("key"), library.factor_id(F.col("props")).alias("factor_id"), library.document_id(F.col("props")).alias("document_id"))


#: Expressions of the library, by the part's number: plain, nested, deep, malformed, unknown, cancelling; {n} is a window of the part.
KINDS = [
    "TS_MEAN($close, {n})", "RANK( TS_STD($volume,{n}) )", "EMA($close, {n})", "$close / DELAY($missing, {n})", "ZSCORE($close) * TS_MAX($high, {n})", "RANK(TS_STD($volume, {n}))", "ZSCORE(ZSCORE($close)) + {n}", "($close - $close + {n}) * $volume",
    "TS_MEAN($close / $close, {n})", "RANK(TS_MEAN(DELTA(ABS($close - $open), {n}), 5)) + TS_MAX(TS_MIN($low, {n}), 3) * SIGN($volume) - $vwap", "RANK(TS_MEAN($close, {n})", "IIF($close > $open, {n}, 0)", "{n} + 2 * 3",
]
#: Kinds in which a window is the part's.
WINDOWED = "(0, 1, 4, 5, 8, 9)"
METRICS = {"IC": "(i % 21 - 10) / 1000", "ICIR": "(i % 11 - 5) / 50", "Sharpe": "(i % 301 - 150) / 50", "turnover": "(i % 13) / 20", "coverage": "(60 + i % 45) / 100"}


def factors(spark, sf_dir) -> DataFrame:
    """A factor library of the parts: names, expressions with windows of the part, metrics of its number; some lack some."""
    i = F.col("p_partkey")
    n = F.when(i % 5 == 0, 1).otherwise(F.col("p_size") * 3).cast("string")
    expression = F.replace(F.element_at(F.array(*(F.lit(k) for k in KINDS)), (i % len(KINDS) + 1).cast("int")), F.lit("{n}"), n)
    value = {k: F.expr(v.replace("i", "p_partkey")).cast("string") for k, v in METRICS.items()}
    value["turnover"] = F.when(i % 17 != 0, value["turnover"])
    value["coverage"] = F.when(i % 19 != 0, value["coverage"])
    metrics = F.create_map(*(x for k, v in value.items() for x in (F.lit(k), v)))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("run"), (i % 9).cast("string")).alias("run_id"), (i % 5).cast("int").alias("loop_round"), i.cast("int").alias("intra_loop_index"), F.concat(F.col("p_name"), F.lit(" "), (i % 40).cast("string")).alias("factor_name"), expression.alias("factor_expression"),
        F.when(i % 3 == 0, F.concat(F.lit("f"), i.cast("string"), F.lit(".py"))).alias("factor_file"), metrics.alias("metrics"), F.col("p_brand").alias("hypothesis"), F.col("p_type").alias("source"), ((i % 97) / 10).alias("fitness"), (i % 4).cast("int").alias("generation"),
        F.when(i % 7 == 0, "failed").when(i % 7 == 1, "rejected").otherwise("evaluated").alias("status"), F.when(i % 2 == 0, "expression").otherwise("subset").alias("phase"),
    )


_KIND_LIST = ", ".join(f"'{k}'" for k in KINDS)
L1 = f"""lib AS (SELECT *, replace([{_KIND_LIST}][kind + 1], '{{n}}', n::VARCHAR) AS factor_expression FROM (SELECT 'run' || (p_partkey % 9) AS run_id, (p_partkey % 5)::INT AS loop_round, p_partkey::INT AS idx, p_name || ' ' || (p_partkey % 40) AS factor_name, (p_partkey % {len(KINDS)})::INT AS kind,
  CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE p_size * 3 END AS n, CASE WHEN p_partkey % 3 = 0 THEN 'f' || p_partkey || '.py' END AS factor_file, (p_partkey % 21 - 10) / 1000.0 AS ic, (p_partkey % 11 - 5) / 50.0 AS icir, (p_partkey % 301 - 150) / 50.0 AS sharpe,
  CASE WHEN p_partkey % 17 <> 0 THEN (p_partkey % 13) / 20.0 END AS turnover, CASE WHEN p_partkey % 19 <> 0 THEN (60 + p_partkey % 45) / 100.0 END AS coverage, p_brand AS hypothesis, p_type AS source,
  (p_partkey % 97) / 10.0 AS fitness, (p_partkey % 4)::INT AS generation, CASE p_partkey % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'rejected' ELSE 'evaluated' END AS status, CASE WHEN p_partkey % 2 = 0 THEN 'expression' ELSE 'subset' END AS phase FROM part))"""
REJECTED = f"CASE WHEN kind = 2 THEN 'unsupported_function:EMA' WHEN kind = 3 THEN 'unknown_column:missing' WHEN kind = 11 THEN 'condition' WHEN kind IN {WINDOWED} AND n < 2 THEN 'window_too_small' WHEN kind IN {WINDOWED} AND n > 120 THEN 'window_too_large' END"
#: The name of a record's code file, in SQL.
FILE = "run_id || '_' || loop_round || '_' || idx || '_' || lower(left(trim(regexp_replace(factor_expression, '[^\\p{L}\\p{N}]+', '_', 'g'), '_'), 80)) || '.py'"
BARE = "regexp_replace(factor_expression, '\\s+', '', 'g')"
COLUMNS = ["open", "high", "low", "close", "volume", "vwap"]


@query(f"WITH {L1} SELECT idx AS intra_loop_index, {REJECTED} AS rejected FROM lib")
def library_rule_check(spark, sf_dir):
    return library.rule_check(factors(spark, sf_dir), COLUMNS).select("intra_loop_index", "rejected")


@query(f"WITH {L1} SELECT idx AS intra_loop_index, factor_name FROM lib WHERE {REJECTED} IS NULL")
def library_purge(spark, sf_dir):
    return library.purge(factors(spark, sf_dir), COLUMNS).select("intra_loop_index", "factor_name")


@query(f"WITH {L1} SELECT idx AS intra_loop_index, CASE kind WHEN 2 THEN 'unknown_function:EMA' WHEN 3 THEN 'unknown_column:$missing' WHEN 6 THEN 'recursive_normalization' WHEN 7 THEN 'degenerate_self_operation' WHEN 8 THEN 'degenerate_self_operation' WHEN 9 THEN 'expression_too_many_nodes' WHEN 10 THEN 'syntax_error' WHEN 11 THEN 'unknown_function:IIF' END AS invalid FROM lib")
def library_candidate_check(spark, sf_dir):
    return library.candidate_check(factors(spark, sf_dir), COLUMNS).select("intra_loop_index", "invalid")


@query(f"WITH {L1} SELECT idx AS intra_loop_index, CASE kind WHEN 2 THEN 'unknown_function' WHEN 3 THEN 'unknown_variable' WHEN 10 THEN 'unbalanced_parentheses' WHEN 11 THEN 'unknown_function' WHEN 12 THEN 'no_variable' END AS lexical FROM lib")
def library_lexical_check(spark, sf_dir):
    return library.lexical_check(factors(spark, sf_dir), COLUMNS).select("intra_loop_index", "lexical")


@query(f"WITH {L1} SELECT idx AS intra_loop_index, CASE WHEN kind IN (0, 1, 3, 4, 5, 8, 9, 10) THEN replace(factor_expression, n || ')', greatest(2, least(120, n)) || ')') ELSE factor_expression END AS repaired FROM lib")
def library_repair(spark, sf_dir):
    return library.spread(factors(spark, sf_dir)).select("intra_loop_index", library.repair_windows("factor_expression").alias("repaired"))


#: Of each kind: nodes, depth, numbers, and whether its shape is acceptable (null where it can't be read).
SHAPES = [(3, 2, 1, True), (4, 3, 1, True), (3, 2, 1, True), (5, 3, 1, True), (6, 3, 1, True), (4, 3, 1, True), (5, 4, 1, True), (7, 4, 1, True), (5, 3, 1, True), (20, 8, 4, True), (None, None, None, False), (6, 3, 2, True), (5, 3, 3, False)]
_SHAPE_SQL = ", ".join(f"({k}, {', '.join('NULL' if v is None else str(v).lower() for v in row)})" for k, row in enumerate(SHAPES))


@query(f"WITH {L1}, sh(k, nodes, depth, numbers, fine) AS (VALUES {_SHAPE_SQL}) SELECT idx AS intra_loop_index, nodes, depth, numbers, coalesce(fine, false) AS acceptable FROM lib JOIN sh ON k = kind")
def library_shapes(spark, sf_dir):
    return library.acceptable_shape(factors(spark, sf_dir)).select("intra_loop_index", "shape.nodes", "shape.depth", "shape.numbers", "acceptable")


@query(f"WITH {L1}, e AS (SELECT {BARE} AS expression, factor_name FROM lib) SELECT expression, factor_name, count(*) OVER (PARTITION BY expression) AS n FROM e QUALIFY n > 1")
def library_duplicates(spark, sf_dir):
    return library.duplicate_expressions(factors(spark, sf_dir)).select("expression", "factor_name", "n")


@query(f"WITH {L1}, e AS (SELECT regexp_replace(factor_name, '\\s+\\d+$', '') AS base_name, factor_name FROM lib) SELECT base_name, factor_name, count(*) OVER (PARTITION BY base_name) AS n FROM e QUALIFY n > 1")
def library_name_groups(spark, sf_dir):
    return library.duplicate_names(factors(spark, sf_dir)).select("base_name", "factor_name", "n")


@query(f"WITH {L1} SELECT count(*) AS records, count(DISTINCT {BARE}) AS distinct_expressions FROM lib")
def library_summary(spark, sf_dir):
    return library.library_summary(factors(spark, sf_dir))


@query(f"WITH {L1}, k AS (SELECT *, row_number() OVER (PARTITION BY {BARE} ORDER BY idx % 2, factor_name) AS k FROM lib) SELECT {BARE} AS expression, factor_name FROM k WHERE k = 1")
def library_union(spark, sf_dir):
    f = factors(spark, sf_dir)
    out = library.union_libraries(f.filter("intra_loop_index % 2 = 0"), f.filter("intra_loop_index % 2 = 1"))
    return out.select(files.bare("factor_expression").alias("expression"), "factor_name")


@query(f"WITH {L1}, n AS (SELECT *, row_number() OVER (PARTITION BY {BARE} ORDER BY factor_name) AS k FROM lib WHERE idx % 2 = 1) SELECT {BARE} AS expression, factor_name FROM n WHERE k = 1 AND {BARE} NOT IN (SELECT {BARE} FROM lib WHERE idx % 2 = 0)")
def library_accept_unseen(spark, sf_dir):
    f = factors(spark, sf_dir)
    return library.accept_unseen(f.filter("intra_loop_index % 2 = 1"), f.filter("intra_loop_index % 2 = 0")).select(files.bare("factor_expression").alias("expression"), "factor_name")


FORM = f"regexp_replace(upper({BARE}), '\\b\\d+(\\.\\d+)?(E[+-]?\\d+)?\\b', 'N', 'g')"
_GRAMS = "unnest(CASE WHEN length(f) < 3 THEN [f] ELSE list_transform(range(1, length(f) - 1), lambda i: substring(f, i, 3)) END)"
SIMILAR = f"""a AS (SELECT {FORM} AS f FROM lib WHERE idx % 7 < 3), b AS (SELECT {FORM} AS f FROM lib WHERE idx % 7 >= 3), ga AS (SELECT DISTINCT f, {_GRAMS} AS g FROM (SELECT DISTINCT f FROM a)), gb AS (SELECT DISTINCT f, {_GRAMS} AS g FROM (SELECT DISTINCT f FROM b)),
na AS (SELECT f, count(*) AS n FROM ga GROUP BY 1), nb AS (SELECT f, count(*) AS n FROM gb GROUP BY 1), s AS (SELECT ga.f AS fa, gb.f AS fb, count(*) AS k FROM ga JOIN gb ON ga.g = gb.g GROUP BY 1, 2),
j AS (SELECT fa, fb, k / (na.n + nb.n - k)::DOUBLE AS similarity FROM s JOIN na ON na.f = fa JOIN nb ON nb.f = fb)"""


@query(f"WITH {L1}, {SIMILAR} SELECT fa AS new_form, fb AS old_form, round(similarity, 6) AS similarity, (SELECT count(*) FROM a WHERE a.f = fa) AS n_new, (SELECT count(*) FROM b WHERE b.f = fb) AS n_old FROM j WHERE similarity >= 0.5")
def library_similar(spark, sf_dir):
    f = factors(spark, sf_dir)
    return library.similar_expressions(f.filter("intra_loop_index % 7 < 3"), f.filter("intra_loop_index % 7 >= 3"), 0.5)


@query(None)
def library_common_subtrees(spark, sf_dir):
    f = factors(spark, sf_dir)
    return library.largest_common_subtree(f.filter("intra_loop_index % 2 = 1"), f.filter("intra_loop_index % 2 = 0"))


@query(f"""WITH {L1}, {SIMILAR}, g AS (SELECT idx AS intra_loop_index, CASE WHEN abs(ic) < 0.003 THEN 'ic' WHEN abs(icir) < 0.005 THEN 'icir' WHEN coalesce(nullif(turnover, 0), 1) > 0.5 THEN 'turnover' WHEN coalesce(coverage, 0) < 0.8 THEN 'coverage' WHEN {REJECTED} IS NOT NULL THEN 'rules'
  WHEN lower(factor_name) IN (SELECT lower(factor_name) FROM lib WHERE idx % 7 >= 3) THEN 'name' WHEN {FORM} IN (SELECT fa FROM j WHERE similarity >= 0.9) THEN 'similarity' END AS gate FROM lib WHERE idx % 7 < 3) SELECT *, gate IS NULL AS passed FROM g""")
def library_quality_gate(spark, sf_dir):
    f = factors(spark, sf_dir)
    return library.quality_gate(f.filter("intra_loop_index % 7 < 3"), f.filter("intra_loop_index % 7 >= 3"), COLUMNS).select("intra_loop_index", "gate", "passed")


@query(f"WITH {L1} SELECT hypothesis, count(*) AS n, bool_or(sharpe > 2) AS has_strong FROM lib GROUP BY 1")
def library_hypotheses(spark, sf_dir):
    return library.by_hypothesis(factors(spark, sf_dir)).select("hypothesis", "n", "has_strong")


@query(f"WITH {L1} SELECT factor_name, round(sharpe, 6) AS value FROM lib ORDER BY abs(sharpe) DESC, factor_name LIMIT 10")
def library_top_factors(spark, sf_dir):
    return library.top_factors(factors(spark, sf_dir))


@query(f"WITH {L1}, k AS (SELECT *, row_number() OVER (PARTITION BY {BARE} ORDER BY fitness DESC, factor_name) AS k FROM lib) SELECT factor_name, round(fitness, 6) AS fitness FROM k WHERE k = 1 ORDER BY fitness DESC, factor_name LIMIT 50")
def library_candidate_pool(spark, sf_dir):
    return library.candidate_pool(factors(spark, sf_dir)).select("factor_name", "fitness")


@query(f"WITH {L1} SELECT phase, status, count(*) AS n FROM lib GROUP BY 1, 2")
def search_counts(spark, sf_dir):
    return library.search_summary(factors(spark, sf_dir).withColumnRenamed("factor_name", "name"))[0]


@query(f"WITH {L1} SELECT phase, generation, round(max(fitness), 6) AS fitness, max_by(factor_name, {{'a': fitness, 'b': factor_name}}) AS name FROM lib GROUP BY 1, 2")
def search_best(spark, sf_dir):
    return library.search_summary(factors(spark, sf_dir).withColumnRenamed("factor_name", "name"))[1]


@query(f"WITH {L1} SELECT phase, count(*) AS n FROM lib GROUP BY 1")
def phase_counts(spark, sf_dir):
    return library.phase_counts(factors(spark, sf_dir))


#: Code files: what records name or are expected to have, of two in three, and some that nobody expects.
FILES_SQL = f"code AS (SELECT factor_file AS file FROM lib WHERE idx % 2 = 0 AND factor_file IS NOT NULL UNION SELECT {FILE} FROM lib WHERE idx % 3 <> 1 UNION SELECT upper({FILE}) FROM lib WHERE idx % 8 = 1), known AS (SELECT factor_file AS file FROM lib UNION SELECT {FILE} FROM lib)"


def code_files(spark, sf_dir) -> DataFrame:
    f = factors(spark, sf_dir).withColumn("made", F.expr("concat(run_id, '_', loop_round, '_', intra_loop_index, '_', lower(left(trim(BOTH '_' FROM regexp_replace(factor_expression, '[^a-zA-Z0-9]+', '_')), 80)), '.py')"))
    some = f.filter("intra_loop_index % 2 = 0 and factor_file is not null").select(F.col("factor_file").alias("file"))
    return some.union(f.filter("intra_loop_index % 3 != 1").select("made")).union(f.filter("intra_loop_index % 8 = 1").select(F.upper("made"))).distinct()


@query(f"WITH {L1}, {FILES_SQL} SELECT file FROM code WHERE file NOT IN (SELECT file FROM known WHERE file IS NOT NULL)")
def library_orphans(spark, sf_dir):
    return library.orphans(code_files(spark, sf_dir), factors(spark, sf_dir))


RECOVERY_SQL = f"""{L1}, {FILES_SQL}, act AS (SELECT idx, CASE WHEN idx % 11 = 5 THEN 'unparseable_record' WHEN {FILE} NOT IN (SELECT file FROM code) THEN 'code_missing' WHEN idx % 4 = 0 THEN 'recovered' WHEN factor_file IS NULL THEN 'updated_existing' ELSE 'already_present' END AS action FROM lib)"""


def recovered(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Three quarters of the library are stored; all of it is legacy, some without a run."""
    f = factors(spark, sf_dir)
    legacy = f.withColumn("run_id", F.when(F.col("intra_loop_index") % 11 == 5, "").otherwise(F.col("run_id")))
    return library.recover(f.filter("intra_loop_index % 4 != 0"), legacy, code_files(spark, sf_dir))


@query(f"WITH {RECOVERY_SQL} SELECT action, count(*) AS n FROM act GROUP BY 1")
def library_recovery(spark, sf_dir):
    return recovered(spark, sf_dir)[1]


@query(f"WITH {RECOVERY_SQL} SELECT idx AS intra_loop_index, factor_name, CASE WHEN action IN ('recovered', 'updated_existing') THEN {FILE} ELSE factor_file END AS factor_file, CASE WHEN action = 'recovered' THEN 'legacy_old_json_recovery' ELSE source END AS source FROM lib JOIN act USING (idx) WHERE idx % 4 <> 0 OR action = 'recovered'")
def library_recovered(spark, sf_dir):
    return recovered(spark, sf_dir)[0].select("intra_loop_index", "factor_name", "factor_file", "source")


EVENTS_SQL = "ev AS (SELECT event_type || (event_id % 50) AS name, 'run' || (user_id % 3) AS run_id, ts, CASE WHEN event_id % 4 > 0 THEN 'r' || (event_id % 11) END AS reason, props AS expression, event_id % 3 AS src FROM events)"


def failures(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(F.concat("event_type", (i % 50).cast("string")).alias("name"), F.concat(F.lit("run"), (F.col("user_id") % 3).cast("string")).alias("run_id"), F.col("ts").alias("timestamp"), F.when(i % 4 > 0, F.concat(F.lit("r"), (i % 11).cast("string"))).alias("reason"), F.col("props").alias("expression"), i)


@query(f"WITH {EVENTS_SQL} SELECT name, run_id, max(ts) AS \"timestamp\", arg_max(reason, ts) FILTER (WHERE reason IS NOT NULL) AS reason, arg_max(expression, ts) AS expression FROM ev GROUP BY 1, 2")
def failure_upsert(spark, sf_dir):
    f = failures(spark, sf_dir)
    return library.upsert_failures(*(f.filter(F.col("event_id") % 3 == k) for k in range(3)))


@query(f"""WITH {EVENTS_SQL}, t AS (SELECT * FROM ev ORDER BY ts DESC, name LIMIT 30) SELECT * FROM (SELECT 'reason' AS kind, coalesce(reason, 'unknown') AS value, count(*) AS n FROM t GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 8)
UNION ALL SELECT * FROM (SELECT 'name', name, count(*) FROM t GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 12) UNION ALL SELECT 'expression', expression, n FROM (SELECT expression, count(*) AS n, min(ts) AS at, arg_min(name, ts) AS m FROM t GROUP BY 1 ORDER BY 3, 4, 1 LIMIT 5)""")
def failure_summary(spark, sf_dir):
    return library.failure_summary(failures(spark, sf_dir))


@query(f"WITH {EVENTS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC, reason DESC) AS n FROM ev) SELECT name, ts AS \"timestamp\", reason FROM k WHERE n = 1 ORDER BY ts DESC, name LIMIT 50")
def recent_rejected(spark, sf_dir):
    return library.recent_rejected(failures(spark, sf_dir)).select("name", "timestamp", "reason")


@query(f"""WITH {EVENTS_SQL}, done AS (SELECT DISTINCT name, run_id FROM ev WHERE src = 0), p AS (SELECT *, row_number() OVER (PARTITION BY name, run_id ORDER BY ts, expression) AS n FROM ev WHERE src > 0),
u AS (SELECT name, run_id, max(ts) AS "timestamp", arg_max(reason, ts) FILTER (WHERE reason IS NOT NULL) AS reason, arg_max(expression, ts) AS expression, 'low_metric' AS "type" FROM ev WHERE src = 0 GROUP BY 1, 2)
SELECT * FROM u UNION ALL SELECT name, run_id, ts, coalesce(reason, 'Proposed but results pending or rejected.'), expression, 'unsuccessful_attempt' FROM p ANTI JOIN done USING (name, run_id) WHERE n = 1""")
def failure_proposals(spark, sf_dir):
    f = failures(spark, sf_dir)
    logs = f.filter("event_id % 3 = 0").withColumn("type", F.lit("low_metric"))
    return library.upsert_failures(logs, proposals=f.filter("event_id % 3 > 0"))


@query(f"WITH {L1}, {FILES_SQL} SELECT 'records' AS \"check\", count(*) AS n FROM lib UNION ALL SELECT 'distinct_expressions', count(DISTINCT {BARE}) FROM lib UNION ALL SELECT 'duplicate_expressions', count(*) FROM (SELECT 1 FROM lib GROUP BY {BARE} HAVING count(*) > 1) UNION ALL SELECT 'duplicate_names', count(*) FROM (SELECT 1 FROM lib GROUP BY regexp_replace(factor_name, '\\s+\\d+$', '') HAVING count(*) > 1) UNION ALL SELECT 'orphan_files', count(*) FROM code WHERE file NOT IN (SELECT file FROM known WHERE file IS NOT NULL)")
def library_audit(spark, sf_dir):
    return library.audit(factors(spark, sf_dir), code_files(spark, sf_dir)).select("check", "n")


#: Records of one written library document.
PER_FILE = 500


@query(f"WITH {L1} SELECT run_id || '-' || (idx // {PER_FILE}) AS library, factor_name, factor_expression FROM lib UNION ALL SELECT DISTINCT 'old_' || run_id || '-' || (idx // {PER_FILE}), factor_name, max_by(factor_expression, idx) OVER (PARTITION BY run_id, idx // {PER_FILE}, factor_name) FROM lib")
def library_layouts(spark, sf_dir):
    """Records written as JSON documents of bounded size, in two layouts, and read back."""
    f = factors(spark, sf_dir).withColumn("library", F.concat_ws("-", "run_id", F.floor(F.col("intra_loop_index") / PER_FILE).cast("string")))
    listed = f.groupBy("library").agg(F.to_json(F.struct(F.collect_list(F.struct("factor_name", "factor_expression", "metrics")).alias("records"))).alias("value"))
    last = f.groupBy("library", "factor_name").agg(F.max_by("factor_expression", "intra_loop_index").alias("expression"))
    mapped = last.groupBy(F.concat(F.lit("old_"), "library").alias("library")).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("factor_name", F.struct("expression")))).alias("factors"))).alias("value"))
    return files.records_of(listed.union(mapped)).select("library", "factor_name", "factor_expression")


@query(f"""WITH {L1}, listed AS (SELECT factor_name AS name, min(idx // 50) AS place FROM lib WHERE idx % 50 = 7 GROUP BY 1), pen AS (SELECT factor_name AS name, min(idx // 50) AS place FROM lib WHERE idx % 50 = 7 AND (idx // 50) % 2 = 0 GROUP BY 1),
w AS (SELECT *, list_distinct(regexp_extract_all(lower(factor_name || ' ' || factor_expression), '[a-z_]{{3,}}')) AS ws FROM lib)
SELECT factor_name, factor_expression, (coalesce(100 - least(listed.place, 50), 0) - coalesce(50 - least(pen.place, 25), 0) + 3 * least(8, list_contains(ws, 'close')::INT + list_contains(ws, 'volume')::INT + list_contains(ws, 'rank')::INT)
  + 2 * contains(lower(factor_name), 'evo')::INT + regexp_matches(lower(factor_name), 'funding|vwap|volume')::INT + regexp_matches(lower(factor_name), 'reversal|momentum')::INT)::INT AS memory_score FROM w LEFT JOIN listed ON listed.name = trim(factor_name) LEFT JOIN pen ON pen.name = trim(factor_name)""")
def seed_ranking(spark, sf_dir):
    f = factors(spark, sf_dir)
    listed = f.filter("intra_loop_index % 50 = 7").select(F.col("factor_name").alias("name"), F.floor(F.col("intra_loop_index") / 50).cast("int").alias("place"))
    words = spark.createDataFrame([("close",), ("volume",), ("rank",)], "word string")
    return library.rank_seeds(f, listed, listed.filter("place % 2 = 0"), words).select("factor_name", "factor_expression", "memory_score")


@query(f"WITH {P1} SELECT datetime, symbol, {', '.join(f'round({c}, 6) AS {c}' for c in ('open', 'high', 'low', 'close', 'volume', 'vwap'))} FROM panel WHERE datetime <= (SELECT max(datetime) - INTERVAL 2 DAY FROM panel)")
def stream_daily_bars(spark, sf_dir):
    """Bars of the events read as a stream; days that later events may still change aren't out yet."""
    out = f"{files.shared_dir(spark)}/bars-{uuid.uuid4().hex}"
    source = f"{sf_dir}/events.parquet"
    ticks = spark.readStream.schema(spark.read.parquet(source).schema).parquet(_folder(source))
    ticks = ticks.withColumn("ts", F.col("ts").cast("timestamp"))
    bars = jobs.daily_bars_stream(ticks, "ts", "user_id", "value", "event_id")
    run = bars.writeStream.format("parquet").option("path", f"{out}/bars").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    last = spark.read.parquet(source).agg(F.date_trunc("day", F.max("ts")).alias("d"))
    found = spark.read.parquet(f"{out}/bars")
    return found.join(last, found["datetime"] <= last["d"] - F.expr("INTERVAL 2 DAYS")).drop("d")


def _folder(path: str) -> str:
    """A stream reads folders or glob paths: a table that is one file is named by a pattern that only it fits."""
    return path[:-1] + "[t]"
