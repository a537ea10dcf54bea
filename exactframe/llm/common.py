"""Shared pieces: table reading, shared storage for cut lineage, and text primitives in Spark expressions."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expression of a word, and of what separates words.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: The separators themselves.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else what the context has.

    Only a local session, where one machine is everything, gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if at:
        return at
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    warnings.warn("spark.checkpoint.dir is not set: intermediate tables go to a temporary folder of this machine", stacklevel=2)
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="exactframe-"))
    return sc.getCheckpointDir()


#: For each open ``scratch``, what was stored in it.
_SCRATCH: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """At its end all tables are deleted that were stored inside it, but the last one, its result."""
    mine: list[DataFrame] = []
    _SCRATCH.append(mine)
    try:
        yield
    finally:
        _SCRATCH.remove(mine)
        for df in mine[:-1]:
            discard(df)


def stored(df: DataFrame, label: str = "t") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lost executors cost a reread, no recomputation."""
    spark = df.sparkSession
    path = posixpath.join(shared_dir(spark), f"exactframe-{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    if _SCRATCH:
        _SCRATCH[-1].append(back)
    return back


def discard(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote, once nothing reads it any more."""
    spark, path = df.sparkSession, df.stored_at
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame) -> str:
    """A prefix that no column of ``df`` has, for columns of an operator's own."""
    prefix = "x_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = f"x{prefix}"
    return prefix


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside lambda functions."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text; none for null. Blanks at its ends are cut first, so splitting leaves no empty word."""
    return let(F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, GAP)))


def n_words(text: Column) -> Column:
    """How many words: places where a word begins."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
