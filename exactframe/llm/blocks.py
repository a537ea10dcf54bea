"""Comparing the members of a bucket block by block, however large the bucket is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paired_blocks(members: DataFrame, key: str, size: int, crowd: str | None = None) -> DataFrame:
    """``members`` (with a column ``id``) of keys that have several, each dealt to a block of about ``size`` of its key and
    repeated for each task (key, i, j) that compares block i with block j; ``block`` is the row's own.

    ``crowd``: a column that is null, or names a group whose members need not be compared with each other: they get blocks
    of their own, which are compared with all others, so a row of a large crowd is repeated as often as there are other blocks.
    """
    by = [key] if crowd is None else [key, crowd]
    shared = members.groupBy(*by).agg(F.count("*").alias("of")).withColumn("blocks", F.ceil(F.col("of") / size).cast("int"))
    if crowd is None:
        shared = shared.filter("of > 1").select(key, F.lit(0).alias("first"), "blocks", F.col("blocks").alias("all"))
        dealt = members.join(shared, key)
        own = F.lit(False)
    else:
        whole = Window.partitionBy(key)
        before = whole.orderBy(F.col(crowd).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        shared = shared.select(key, F.col(crowd).alias("of crowd"), F.coalesce(F.sum("blocks").over(before), F.lit(0)).alias("first"), "blocks", F.sum("blocks").over(whole).alias("all"), F.sum("of").over(whole).alias("rows"))
        shared = shared.filter("rows > 1").drop("rows").withColumnRenamed(key, "of key")
        dealt = members.join(shared, (F.col(key) == F.col("of key")) & F.col(crowd).eqNullSafe(F.col("of crowd"))).drop("of key", "of crowd")
        own = F.col(crowd).isNotNull() & (F.col("other") >= F.col("first")) & (F.col("other") < F.col("first") + F.col("blocks"))
    dealt = dealt.withColumn("block", (F.col("first") + F.pmod(F.xxhash64("id"), "blocks")).cast("int"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("all") - 1).cast("int")))).filter(~own)
    return each.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("first", "blocks", "all", "other")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n things of which a[k] and b[k] are linked: the least thing that each can reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def runs(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each value of ``by``; the batches are sorted by it."""
    held: list[pa.RecordBatch] = []
    value = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in by]
        cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols], axis=0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            now = tuple(c[lo] for c in cols)
            if held and now != value:
                yield pa.Table.from_batches(held)
                held = []
            value = now
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)
