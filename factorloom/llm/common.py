"""Shared helpers: the shared folder, written intermediate tables, column checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what ``spark.checkpoint.dir`` names. Only a local session without that setting gets a
    temporary folder, which is then recorded in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of all intermediate tables of this application."""
    return f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Removes the intermediate tables of this application. Results that weren't written elsewhere can't be read any more."""
    for table in spark.catalog.listTables():
        if table.name.startswith(f"sets_{spark.sparkContext.applicationId.replace('-', '_')}".lower()):
            spark.sql(f"DROP TABLE IF EXISTS `{table.name}`")
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps don't compute it again."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot if it has more rows than this, and than this part of all rows.
HOT, HOT_SHARE = 1000, 10_000


def hot_from(rows: int) -> int:
    """From how many rows on a key is hot; of ``rows`` rows in all, fewer than ``HOT_SHARE`` keys can have more."""
    return max(HOT, rows // HOT_SHARE)


def join_spread(many: DataFrame, one: DataFrame, key: str, size: str, most: int) -> DataFrame:
    """``many`` joined with ``one``, which has one row for each key and in ``size`` the number of the key's rows in ``many``.

    Keys with more than ``most`` rows (see ``hot_from``: a bounded number of them) are joined by broadcast, so that their rows
    stay where they are; the others are shuffled.
    """
    hot = one.filter(F.col(size) > most)
    cold = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(one.filter(F.col(size) <= most), key)
    return cold.unionByName(many.join(F.broadcast(hot), key))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def need(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    name, taken = base, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def n_words(text):
    """Number of words of a string column (null: 0), as an expression of the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ddl(df: DataFrame, keep: Iterable[str], more: str) -> str:
    """Schema text: the kept columns of ``df`` with their own types, then ``more``."""
    return ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), more])
