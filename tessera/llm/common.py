"""What several operators share: words, tables on the shelf, Arrow limits."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, and what counts as a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Most rows and bytes in an Arrow batch: whole texts travel in them, and a batch of very long texts must fit a worker.
ARROW_ROWS, ARROW_BYTES = 1000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.coalesce(F.array_remove(F.split(text, SPACE + "+"), ""), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD + "+")), F.lit(0)).cast("long")


def shelf_root(spark: SparkSession) -> str:
    """The folder that all executors share. Only a session of one machine may go without one: it gets a local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "tessera-shelf")
    return root.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


#: Whether the files of a query's shuffles go when it ends; else they wait for the driver to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shelve(df: DataFrame, shuffles_go: bool = False) -> DataFrame:
    """Writes a table to the shared folder and reads it back.

    This cuts the lineage without tying the data to an executor, keeps columns
    prunable and gives the planner a true size. Whole texts stand there, so it is packed tightly. The files go when the driver ends,
    or earlier by ``unshelve``. With ``shuffles_go``, what was shuffled for it goes as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shelf_root(spark)}/shelf-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, "false")
    try:
        if shuffles_go:
            spark.conf.set(SHUFFLES_GO, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if shuffles_go:
            spark.conf.set(SHUFFLES_GO, before)
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._shelf = path
    return out


def unshelve(*tables: DataFrame) -> None:
    """Deletes what ``shelve`` has written, once all that reads it is written itself."""
    for df in tables:
        files, at = _file_system(df.sparkSession, df._shelf)
        files.delete(at, True)
        files.cancelDeleteOnExit(at)


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of an Arrow batch for operators that ship whole texts.

    All operators set the same bounds, and only lower them, so the cost of one
    doesn't depend on which ran before. The settings are read when a query starts,
    after the caller has its DataFrame, so they stay.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = _bytes(spark.conf.get(key))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def _bytes(setting: str) -> int:
    """A size as Spark writes it, such as 64MB; -1 where there is none."""
    found = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)(i?b)?", setting.strip().lower())
    return int(found[1]) << 10 * " kmgtp".index(found[2] or " ") if found else -1
