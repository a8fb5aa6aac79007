"""Incremental jobs: market text with replacement by source, and daily bars of ticks."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factorloom.functions.stats import ASSET, TIME
from factorloom.operators.text import merge_records
from factorloom.sources.files import TEXT_SCHEMA


#: Parts of a stored text table; a batch rewrites only those that its sources lie in.
PARTS = 64


def _part() -> Column:
    """The part of a record, by what its key names as its source."""
    return F.pmod(F.xxhash64(F.coalesce("source_file", "url", F.lit(""))), F.lit(PARTS)).cast("int")


def ingest_text(spark: SparkSession, incoming: str, store: str, checkpoint: str) -> StreamingQuery:
    """Merges JSONL records that arrive in a folder into a stored table, replacing those of sources that come again, a
    ``commit_text`` for each batch."""

    def merge(batch: DataFrame, number: int) -> None:
        commit_text(batch.sparkSession, store, batch, number)

    records = spark.readStream.schema(TEXT_SCHEMA).json(incoming)
    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def commit_text(spark: SparkSession, store: str, batch: DataFrame, number: int) -> bool:
    """Merges a numbered batch; false if it, or a later one, is already there.

    Only the parts that the batch's records lie in are written, into a folder of their own. Then a log entry that lists the folders
    of all parts appears under the next number, whole or not at all. So readers see the table before or after the batch,
    a failure in between changes nothing, and a batch that is run again is taken once. Where another writer took
    that number first, the merge is done again on what they wrote. Nothing is removed: see ``vacuum``.
    """
    batch = batch.withColumn("part", _part())
    touched = [r["part"] for r in batch.select("part").distinct().collect()]  # PARTS at most
    while True:
        version, entry = _entry(spark, store)
        if entry["batch"] >= number:
            return False
        folder = f"{store}/data/{number}-{uuid.uuid4().hex}"
        old = _read(spark, [entry["parts"][str(k)] for k in touched if str(k) in entry["parts"]])
        merged, _ = merge_records(old, batch.drop("part"))
        merged.withColumn("part", _part()).repartition("part").write.partitionBy("part").parquet(folder)
        made = {n.removeprefix("part="): f"{folder}/{n}" for n in _names(spark, folder) if n.startswith("part=")}
        parts = {k: v for k, v in entry["parts"].items() if int(k) not in touched} | made
        if _publish(spark, store, version + 1, {"batch": number, "parts": parts}):
            return True
        _delete(spark, folder)


def _fs(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _fs(spark, folder)
    return [str(s.getPath().getName()) for s in fs.listStatus(path)] if fs.exists(path) else []


def _delete(spark: SparkSession, folder: str) -> None:
    fs, path = _fs(spark, folder)
    fs.delete(path, True)


def _log(store: str, version: int) -> str:
    return f"{store}/log/{version:012d}.json"


def _numbers(spark: SparkSession, store: str) -> list[int]:
    return sorted(int(n[:-5]) for n in _names(spark, f"{store}/log") if n.endswith(".json") and n[:-5].isdigit())


def _publish(spark: SparkSession, store: str, version: int, entry: dict) -> bool:
    """Writes a log entry aside and gives it its number; false if the number is taken."""
    aside = f"{store}/log/.{uuid.uuid4().hex}"
    fs, path = _fs(spark, aside)
    out = fs.create(path, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    jvm = spark._jvm
    _, target = _fs(spark, _log(store, version))
    never = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # no overwriting
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(path, target, never)
    except Py4JJavaError as e:
        _delete(spark, aside)
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    return True


def _entry(spark: SparkSession, store: str, before: int | None = None) -> tuple[int, dict]:
    """(version, entry): the last log entry (of a batch before ``before``); without any, version -1 and an empty table."""
    for version in reversed(_numbers(spark, store)):
        fs, path = _fs(spark, _log(store, version))
        stream = fs.open(path)
        entry = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        if before is None or entry["batch"] < before:
            return version, entry
    return -1, {"batch": -1, "parts": {}}


def _read(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.schema(TEXT_SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], TEXT_SCHEMA)


def stored_text(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """The table after its last batch (before a batch's number). What is returned stays at that version, whatever is committed
    later, until ``vacuum`` removes it."""
    return _read(spark, list(_entry(spark, store, before)[1]["parts"].values()))


def vacuum(spark: SparkSession, store: str, keep: int = 2) -> int:
    """Removes what none of the last ``keep`` versions needs: older entries, then folders of data. For times at which nobody
    reads or writes older versions. Returns how many folders went."""
    numbers = _numbers(spark, store)
    for n in numbers[: max(0, len(numbers) - max(1, keep))]:
        _delete(spark, _log(store, n))
    needed, gone = set(), 0
    for n in numbers[-max(1, keep) :]:
        fs, path = _fs(spark, _log(store, n))
        stream = fs.open(path)
        needed |= {p.partition("/data/")[2] for p in json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["parts"].values()}
        stream.close()
    for folder in _names(spark, f"{store}/data"):
        for part in _names(spark, f"{store}/data/{folder}"):
            if part.startswith("part=") and f"{folder}/{part}" not in needed:
                _delete(spark, f"{store}/data/{folder}/{part}")
                gone += 1
    return gone


def daily_bars_stream(ticks: DataFrame, time: str, asset: str, value: str, tie: str, late: str = "1 day") -> DataFrame:
    """Open, high, low, close, volume and vwap of each day and asset, once no tick of it can come any more.

    State: one row for each open day and asset; ticks that come later than ``late`` are dropped.
    """
    order = F.struct(time, tie)
    bars = ticks.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), F.col(asset).cast("string").alias(ASSET))
    out = bars.agg(F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.count(value).cast("double").alias("volume"), F.avg(value).alias("vwap"))
    return out.select(F.col("w.start").alias(TIME), *(c for c in out.columns if c != "w"))
