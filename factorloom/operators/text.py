"""Market text and reports: records, alignment with bars, features, and merging by source."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from factorloom.functions.stats import ASSET, TIME, strip
from factorloom.sources.files import written

#: Words of the default lexicons.
LEXICON = {
    "positive": ["adoption", "bullish", "growth", "inflow", "partnership", "positive", "rally", "surge", "upgrade"],
    "negative": ["bearish", "decline", "exploit", "hack", "lawsuit", "liquidation", "negative", "outflow", "risk", "selloff"],
    "risk": ["hack", "exploit", "lawsuit", "liquidation", "risk", "security", "default"],
    "policy": ["ban", "etf", "policy", "regulation", "sec", "approval", "law"],
    "liquidity": ["funding", "inflow", "liquidity", "open interest", "outflow", "volume"],
}
FEATURES = ["news_count", "news_sentiment_score", "risk_event_count", "policy_event_flag", "liquidity_event_score"]
#: Endings of a quote currency (the first that fits is taken off), and roles of mentions that make no event.
QUOTES = ["USDT", "USD", "USDC", "BUSD"]
#: Fixed value: what a pair with a quote currency looks like.
QUOTED_PAIR = r"(?U)\b[A-Z]{2,12}(?:USDT|USD|USDC|BUSD)\b"
SILENT_ROLES = ["backtest_example", "illustration", "incidental_reference"]
TITLE_CHARS, BODY_CHARS, CHUNK_CHARS, CHUNKS = 240, 4000, 2500, 12
#: Marks that don't begin a title.
MARKS = "#*-"
#: Fixed value: what ``html.unescape`` looks at.
ENTITY = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Parts of the symbols that a record of the whole market is sent to.
PARTS = 64


def _escaped(word: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in word)


def has_word(text: Column, word: str) -> Column:
    """A whole word; a phrase with a space counts wherever it stands."""
    return F.contains(text, F.lit(word)) if " " in word else text.rlike(f"(?U)\\b{_escaped(word)}\\b")


def tokens(text: Column) -> Column:
    """The distinct words of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0)))


def word_hits(text: Column, words: list[str], found: Column) -> Column:
    """How many of the words and phrases occur; ``found`` are the text's own words (see ``tokens``), taken once for all lists."""
    single = [w for w in dict.fromkeys(words) if re.fullmatch(r"\w+", w)]
    hits = F.size(F.array_intersect(found, F.array(*(F.lit(w) for w in single)))) if single else F.lit(0)
    return reduce(lambda a, w: a + has_word(text, w).cast("int"), [w for w in dict.fromkeys(words) if w not in single], hits)


def sentiment(text: Column, lexicon: dict[str, list[str]] = LEXICON, found: Column | None = None) -> Column:
    """(positive - negative) / (positive + negative) over distinct words that occur; 0 without any."""
    found = tokens(text) if found is None else found
    pos, neg = (word_hits(text, lexicon[k], found) for k in ("positive", "negative"))
    return (pos - neg) / F.greatest(F.lit(1), pos + neg)


def parse_time(x: Column) -> Column:
    """A time stamp of text, in UTC; null where it can't be read."""
    return F.coalesce(F.try_to_timestamp(x), F.try_to_timestamp(x, F.lit("yyyy/M/d")), F.try_to_timestamp(x, F.lit("yyyyMMdd")))


def align_to_bars(records: DataFrame, calendar: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """Adds the latest bar at or before each record's time; records before the first bar, or without a time, go.

    Bars and records are sorted together over all tasks by time (records of one time may go to several); each task hands the
    last bar on from row to row while its rows stream by, and the last bars of the tasks before it, one small table, fill its
    beginning. So neither the number of bars nor that of records at one time matters.
    """
    rows = records.withColumns({"_at": F.col(timestamp).cast("timestamp"), "_kind": F.lit(1), "_bar": F.lit(None).cast("timestamp")}).filter("_at IS NOT NULL")
    bars = calendar.select(F.col(TIME).cast("timestamp").alias("_at"), F.lit(0).alias("_kind"), F.col(TIME).cast("timestamp").alias("_bar")).filter("_at IS NOT NULL").distinct()
    both = rows.unionByName(bars, allowMissingColumns=True).withColumn("_salt", F.when(F.col("_kind") == 1, F.rand(7)).otherwise(0.0))
    order = ["_at", "_kind", "_salt"]
    both = both.repartitionByRange(*order).sortWithinPartitions(*order).drop("_salt")
    at = both.columns.index("_bar")
    names = [*both.columns, "_task"]

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last = TaskContext.get().partitionId(), None
        for batch in batches:
            column = batch.column(at)
            if last is not None and len(column):
                column = pa.concat_arrays([pa.array([last], column.type), column])
                column = pc.fill_null_forward(column).slice(1)
            else:
                column = pc.fill_null_forward(column)
            last = column[-1].as_py() if len(column) else last
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], column, *batch.columns[at + 1 :], pa.array([task] * len(batch), pa.int32())], names=names)

    schema = StructType([*both.schema.fields, StructField("_task", IntegerType())])
    filled = written(both.mapInArrow(carried, schema), "aligned")
    before = F.max("_bar").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))  # one row a task
    ends = filled.groupBy("_task").agg(F.max("_bar").alias("_bar")).select("_task", before.alias("_before"))
    out = filled.filter("_kind = 1").join(ends, "_task", "left").withColumn(TIME, F.coalesce("_bar", "_before"))
    return out.filter(F.col(TIME).isNotNull()).drop("_at", "_kind", "_bar", "_task", "_before")


def fan_out(records: DataFrame, symbols: DataFrame) -> DataFrame:
    """Records of known symbols, and those of the whole market (``*``) once for every symbol of the panel."""
    own = symbols.select(F.upper(ASSET).alias(ASSET)).distinct()
    exact = records.join(own, ASSET, "left_semi")
    # each record goes to every part of the symbols and meets those of the part: no row holds all symbols
    wide = records.filter(F.col(ASSET) == "*").drop(ASSET).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    parts = own.withColumn("_part", F.pmod(F.xxhash64(ASSET), F.lit(PARTS)).cast("int"))
    return exact.unionByName(wide.join(parts, "_part").drop("_part"))


def unknown_symbols(records: DataFrame, symbols: DataFrame) -> DataFrame:
    return records.filter(F.col(ASSET) != "*").select(ASSET).distinct().join(symbols.select(F.upper(ASSET).alias(ASSET)).distinct(), ASSET, "left_anti")


def text_features(records: DataFrame, panel: DataFrame, lexicon: dict[str, list[str]] = LEXICON) -> DataFrame:
    """Sums of five features by bar and symbol.

    Features are computed on the records, before those of the whole market are copied to all symbols.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))))
    when = F.col("timestamp") if records.schema["timestamp"].dataType.simpleString() == "timestamp" else parse_time(F.col("timestamp"))
    rows = records.select(when.alias("timestamp"), F.upper(ASSET).alias(ASSET), text.alias("t")).filter(F.col(ASSET).isNotNull())
    t, own = F.col("t"), F.col("w")
    rows = rows.withColumn("w", tokens(t))
    flag = lambda k: (word_hits(t, lexicon[k], own) > 0).cast("double")
    rows = rows.select("timestamp", ASSET, F.lit(1.0).alias(FEATURES[0]), sentiment(t, lexicon, own).alias(FEATURES[1]), flag("risk").alias(FEATURES[2]), flag("policy").alias(FEATURES[3]), flag("liquidity").alias(FEATURES[4]))
    rows = align_to_bars(rows, panel.select(TIME).distinct()).groupBy(TIME, ASSET).agg(*(F.sum(c).alias(c) for c in FEATURES))
    return fan_out(rows, panel.select(ASSET).distinct()).groupBy(TIME, ASSET).agg(*(F.sum(c).alias(c) for c in FEATURES))


def unified_panel(panel: DataFrame, records: DataFrame, lexicon: dict[str, list[str]] = LEXICON) -> DataFrame:
    """The panel with its text features, 0 where there is no text."""
    found = text_features(records, panel, lexicon).withColumnRenamed(ASSET, "_s")
    joined = panel.join(found, (panel[TIME] == found[TIME]) & (F.upper(panel[ASSET]) == found["_s"]), "left").drop(found[TIME]).drop("_s")
    return joined.fillna(0.0, FEATURES)


def without_tags(markup: Column) -> Column:
    """HTML without scripts, styles, comments and tags; block tags break lines. Entities stay."""
    x = F.regexp_replace(markup, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?i)<(br|/p|/div|/h[1-6]|/li|/tr|/title)\b[^>]*>", "\n")
    return F.regexp_replace(x, r"(?s)<[^>]+>", " ")


def entities(text: Column) -> Column:
    """What may be an entity, in the order of the text."""
    return F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))


def resolved(text: Column, characters: Column) -> Column:
    """The text with ``characters`` in place of its entities; blanks in a row become one."""
    whole = F.array_join(F.zip_with(F.split(text, ENTITY, -1), characters, lambda part, c: F.concat(part, F.coalesce(c, F.lit("")))), "")
    return F.regexp_replace(F.when(F.size(characters) > 0, whole).otherwise(text), r"[ \t\xa0]+", " ")


def html_to_text(markup: Column) -> Column:
    """Text of HTML: scripts, styles, comments and tags go, block tags break lines, entities are resolved."""
    x = without_tags(markup)
    return resolved(x, characters_of(entities(x)))


@F.arrow_udf(ArrayType(StringType()))
def characters_of(found: pa.Array) -> pa.Array:
    """Named and numeric entities as characters. Python gets the entities alone, no texts, and resolves each different one of a batch once."""
    flat = found.flatten().dictionary_encode()
    plain = pa.array([html.unescape(e) for e in flat.dictionary.to_pylist()], pa.string())
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(found), 0))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
    return pa.ListArray.from_arrays(offsets, plain.take(flat.indices), mask=found.is_null())


def tidy_lines(text: Column) -> Column:
    """Lines without white space at their ends; blank lines go."""
    lines = F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")
    return F.array_join(F.filter(F.transform(lines, strip), lambda x: x != ""), "\n")


def title_of(text: Column, fallback: Column) -> Column:
    """The first line that isn't empty without its leading marks."""
    bare = lambda x: strip(F.ltrim(strip(x), F.lit(MARKS + " \t")))
    lines = F.filter(F.transform(F.split(text, "\n"), bare), lambda x: x != "")
    return F.coalesce(F.substring(F.get(lines, F.lit(0)), 1, TITLE_CHARS), fallback)


def body_of(text: Column, title: Column) -> Column:
    body = strip(text)
    body = F.when(F.startswith(body, title), strip(F.substring(body, F.length(title) + 1, F.length(body)))).otherwise(body)
    return F.when(body == "", title).otherwise(F.substring(body, 1, BODY_CHARS))


def date_of(text: Column, file: Column, modified: Column) -> Column:
    """First date in the text (year, month, day between - or /, with a time of day where one follows), else the first of eight
    digits, else that in the file's name, else when the file was changed. A date that doesn't exist gives way to the next kind."""
    number = lambda x, pattern, i: F.regexp_extract(x, pattern, i).try_cast("int")
    spelled = r"(?<!\w)(20[0-9]{2})[/-]([0-9]{1,2})[/-]([0-9]{1,2})(?:[T ]([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?)?(?!\w)"
    zero = lambda c: F.coalesce(c, F.lit(0))
    full = F.try_make_timestamp(*(number(text, spelled, i) for i in (1, 2, 3)), *(zero(number(text, spelled, i)) for i in (4, 5)), zero(number(text, spelled, 6)).cast("decimal(8,6)"))
    digits = lambda x, pattern: F.try_make_timestamp(*(F.substring(F.regexp_extract(x, pattern, 1), a, n).try_cast("int") for a, n in ((1, 4), (5, 2), (7, 2))), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"))
    return F.coalesce(full, digits(text, r"(?<!\w)(20[0-9]{6})(?!\w)"), digits(F.element_at(F.split(file, "/"), -1), r"(20[0-9]{6})"), modified)


def base_symbol(symbol: Column) -> Column:
    """A symbol without its quote currency: the first of ``QUOTES`` that it ends in, and that isn't all of it."""
    out = F.lit(None).cast("string")
    for q in reversed(QUOTES):
        out = F.when(F.endswith(symbol, F.lit(q)) & (F.length(symbol) > len(q)), F.left(symbol, F.length(symbol) - len(q))).otherwise(out)
    return F.coalesce(out, symbol)


def chunks_of(text: Column, most: int = CHUNK_CHARS, count: int | None = CHUNKS) -> Column:
    """Paragraphs packed into chunks of at most ``most`` characters; longer paragraphs are cut; the first ``count`` chunks,
    or all of them (None)."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda x: x != "")
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / most).cast("int")), lambda i: F.substring(p, i * most + 1, F.lit(most)))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, p: Column) -> Column:
        joined = F.when(state["open"] == "", p).otherwise(F.concat(state["open"], F.lit("\n\n"), p))
        flushed = F.when(state["open"] == "", state["done"]).otherwise(F.array_append(state["done"], state["open"]))
        pieces = cut(p)
        overflow = F.struct(F.concat(flushed, F.slice(pieces, F.lit(1), F.size(pieces) - 1)).alias("done"), F.element_at(pieces, -1).alias("open"))
        return F.when(F.length(joined) <= most, F.struct(state["done"].alias("done"), joined.alias("open"))).otherwise(overflow)

    packed = F.aggregate(parts, start, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))
    return packed if count is None else F.slice(packed, 1, count)


def detect_symbols(reports: DataFrame, symbols: DataFrame, text: str = "text", key: str = "source_file") -> DataFrame:
    """One row for each report and symbol that occurs, itself or its base, as a whole word in its first 80 lines and 8000
    characters; ``*`` where none does.

    The words of these heads are joined with the table of names, so no report is tried against every symbol. Without any symbol
    to look for, pairs with a quote currency are found by their pattern.
    """
    if symbols.isEmpty():
        top = F.upper(F.substring(F.array_join(F.slice(F.split(F.col(text), "\n"), 1, 80), "\n"), 1, 8000))
        pairs = F.array_sort(F.array_distinct(F.regexp_extract_all(top, F.lit(QUOTED_PAIR), F.lit(0))))
        return reports.withColumn(ASSET, F.explode(F.when(F.size(pairs) > 0, pairs).otherwise(F.array(F.lit("*")))))
    names = symbols.select(F.upper(ASSET).alias(ASSET)).distinct()
    names = names.select(ASSET, F.explode(F.array(F.col(ASSET), base_symbol(F.col(ASSET)))).alias("name")).distinct()
    size = F.size(F.regexp_extract_all("name", F.lit(r"\w+"), F.lit(0)))
    head = F.upper(F.substring(F.array_join(F.slice(F.split(F.col(text), "\n"), 1, 80), "\n"), 1, 8000))
    tokens = reports.select(key, F.explode(F.array_distinct(F.regexp_extract_all(head, F.lit(r"\w+"), F.lit(0)))).alias("name"))
    # a name of several words is looked up by its first one, then confirmed in the head
    names = names.withColumns({"first": F.regexp_extract("name", r"\w+", 0), "n": size})
    found = tokens.withColumnRenamed("name", "first").join(names, "first")
    plain = found.filter("n = 1 and name = first").select(key, ASSET)
    more = found.filter("n > 1 or name != first").join(reports.select(key, head.alias("_h")), key)
    more = more.filter(F.expr("_h rlike concat('\\\\b\\\\Q', name, '\\\\E\\\\b')")).select(key, ASSET)
    hits = plain.union(more).distinct()
    return reports.join(hits, key, "left").withColumn(ASSET, F.coalesce(ASSET, F.lit("*")))


def report_records(reports: DataFrame, symbols: DataFrame, source: str = "report") -> DataFrame:
    """Text records of reports (source_file, modified, text): one for each symbol found, by rules alone.

    Confidence is 0.72 where a symbol was found and 0.48 for the whole market. Tidy texts are written once to the shared folder, as they are
    read for the words of their heads, for the heads and for the records.
    """
    markup = F.lower(F.col("source_file")).rlike(r"\.html?$") | F.col("text").rlike(r"(?i)<html\b")
    # step by step, so that tags are taken out once
    tidy = reports.withColumn("_markup", markup).withColumn("text", F.when(F.col("_markup"), without_tags(F.col("text"))).otherwise(F.col("text")))
    tidy = tidy.withColumn("_characters", characters_of(F.when(F.col("_markup"), entities(F.col("text")))))
    tidy = tidy.withColumn("text", tidy_lines(F.when(F.col("_markup"), resolved(F.col("text"), F.col("_characters"))).otherwise(F.col("text")))).drop("_markup", "_characters")
    named = F.initcap(F.regexp_replace(F.regexp_replace(F.element_at(F.split("source_file", "/"), -1), r"\.\w+$", ""), "[_-]", " "))
    tidy = tidy.withColumn("title", title_of(F.col("text"), named))
    tidy = tidy.withColumns({"body": body_of(F.col("text"), F.col("title")), "timestamp": date_of(F.col("text"), F.col("source_file"), F.col("modified"))})
    out = detect_symbols(written(tidy, "reports"), symbols)
    number = F.row_number().over(Window.partitionBy("source_file").orderBy(ASSET)) - 1
    return out.select("timestamp", ASSET, F.lit(source).alias("source"), "title", "body", F.col("source_file").alias("url"), "source_file", F.lit("report_event").alias("event_type"), F.when(F.col(ASSET) == "*", 0.48).otherwise(0.72).alias("confidence"), number.cast("int").alias("chunk_id"))


def map_symbols(df: DataFrame, aliases: DataFrame, symbols: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``symbol``: the raw name itself if the panel has it, else by alias: as it is, without - _ ., without its quote
    currency; else ``*``. Empty names stay null."""
    up = F.upper(F.trim(F.col(raw)))
    out = df.withColumn("_r", F.when(up != "", up))
    own = symbols.select(F.upper(ASSET).alias("_r"), F.upper(ASSET).alias("_own")).distinct()
    out = out.join(own, "_r", "left")
    look = aliases.select(F.upper("alias").alias("_a"), F.upper(F.col(ASSET)).alias("_v")).dropDuplicates(["_a"])
    tries = {"_t1": F.col("_r"), "_t2": F.regexp_replace("_r", r"[-_.]", ""), "_t3": base_symbol(F.col("_r"))}
    out = out.withColumns(tries)
    for t in tries:
        out = out.join(look.select(F.col("_a").alias(t), F.col("_v").alias(f"{t}v")), t, "left")
    found = F.when(F.col("_r").isNotNull(), F.coalesce(F.col("_own"), F.col("_t1v"), F.col("_t2v"), F.col("_t3v"), F.lit("*")))
    return out.withColumn(ASSET, found).drop("_r", "_own", *tries, *(f"{t}v" for t in tries))


def default_aliases(symbols: DataFrame) -> DataFrame:
    """Alias table of a panel: each symbol, its base, its base without marks, and the parts around a dot."""
    own = symbols.select(F.upper(ASSET).alias(ASSET)).distinct()
    s = F.col(ASSET)
    names = F.array(s, base_symbol(s), F.regexp_replace(base_symbol(s), r"[-_.]", ""), F.substring_index(s, ".", 1), F.regexp_extract(s, r"\.(.+)$", 1))
    pairs = own.select(ASSET, F.posexplode(names).alias("n", "alias")).filter("alias != ''")
    return pairs.groupBy("alias").agg(F.min_by(ASSET, F.struct("n", ASSET)).alias(ASSET))


def record_key() -> Column:
    """What makes two records the same: source, chunk, time, symbol and title."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws("|", F.coalesce("source_file", "url", F.lit("")), F.coalesce(F.col("chunk_id").cast("string"), F.lit("0")), text("timestamp"), F.upper(text(ASSET)), text("title"))


def merge_records(stored: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, counts): stored records of sources that were read again go, the new ones follow, equal keys count once.

    Of equal keys the stored record stays. Merging the same records again changes nothing.
    """
    again = new.filter(F.trim(F.coalesce("source_file", F.lit(""))) != "").select("source_file").distinct()
    kept = stored.join(again, "source_file", "left_anti")
    both = kept.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in ("body", "confidence") if c in both.columns]
    both = both.withColumn("_n", F.row_number().over(Window.partitionBy(record_key()).orderBy("_o", *rest)))
    counts = both.agg(F.count_if(F.col("_n") == 1).alias("records"), F.count_if((F.col("_n") == 1) & (F.col("_o") == 1)).alias("new"), F.count_if(F.col("_n") > 1).alias("duplicates"))
    return both.filter("_n = 1").drop("_n", "_o"), counts


#: Schema of a document summary as JSON.
SUMMARY_SCHEMA = "document_title string, document_date string, summary string, primary_assets array<string>, events array<struct<symbol:string,asset_role:string,title:string,body:string,event_type:string,direction:string,confidence:double,timestamp:string,panel_symbols:array<string>,mentioned_assets:array<string>,evidence:array<string>>>, ignored_mentions array<struct<mention:string,reason:string>>, evidence array<string>"


def summary_events(docs: DataFrame, aliases: DataFrame, symbols: DataFrame, summary: str = "summary_json", key: str = "source_file") -> DataFrame:
    """Events of document summaries (key, title, timestamp, summary as JSON), one row each.

    The symbol is that of the first of the event's symbol, its panel symbols, its other assets and the document's main
    assets that isn't empty. Events without body go; an event without title has the file's; titles, bodies and confidence are bounded; ``emitted`` is false for
    mere examples.
    """
    d = docs.withColumn("_s", F.from_json(summary, SUMMARY_SCHEMA))
    e = d.select(key, F.col("title").alias("_title"), F.col("timestamp").alias("_ts"), F.col("_s.document_date").alias("_date"), F.col("_s.primary_assets").alias("_main"), F.col("_s.evidence").alias("_ev"), F.posexplode("_s.events").alias("event_no", "e"))
    empty = F.array().cast("array<string>")
    wanted = F.concat(F.array("e.symbol"), F.coalesce("e.panel_symbols", empty), F.coalesce("e.mentioned_assets", empty), F.coalesce("_main", empty))
    first = F.get(F.filter(wanted, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), F.lit(0))
    e = map_symbols(e.withColumn("_raw", first), aliases, symbols, "_raw").withColumn(ASSET, F.coalesce(ASSET, F.lit("*")))
    or_else = lambda c, other: F.coalesce(F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))), other)
    role = or_else("e.asset_role", F.when(F.col(ASSET) == "*", "market_wide_or_non_panel_primary").otherwise("panel_primary"))
    when = F.coalesce(parse_time(F.col("e.timestamp")), parse_time(F.col("_date")), F.col("_ts"))
    body = F.trim(F.coalesce("e.body", F.lit("")))
    confidence = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("e.confidence", F.lit(0.6)))), 4)
    out = e.filter(body != "").select(key, "event_no", ASSET, role.alias("asset_role"), F.substring(or_else("e.title", F.trim("_title")), 1, TITLE_CHARS).alias("title"), F.substring(body, 1, BODY_CHARS).alias("body"), or_else("e.event_type", F.lit("report_event")).alias("event_type"), or_else("e.direction", F.lit("neutral")).alias("direction"), confidence.alias("confidence"), F.when(F.size("e.evidence") > 0, F.col("e.evidence")).otherwise(F.col("_ev")).alias("evidence"), when.alias("timestamp"))
    return out.withColumn("emitted", ~F.lower("asset_role").isin(SILENT_ROLES))


def manifest(files: DataFrame, records: DataFrame) -> DataFrame:
    """One row a file: ingested or skipped, its number of records and the reason."""
    n = records.groupBy("source_file").agg(F.count("*").alias("records"))
    out = files.select("source_file").distinct().join(n, "source_file", "left").withColumn("records", F.coalesce("records", F.lit(0)))
    return out.withColumns({"status": F.when(F.col("records") > 0, "ingested").otherwise("skipped"), "reason": F.when(F.col("records") == 0, "no_records")})


def merge_manifests(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The later summary of each file."""
    both = stored.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy("source_file").orderBy(F.desc("_o"), "status"))).filter("_n = 1").drop("_n", "_o")
