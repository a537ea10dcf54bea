"""Operator 6, mixing sources to target weights, by Spark expressions only.

The words of every source lie in one line, cut into blocks of fixed length. All slots of the output together hold each
source as often as its target says; a pseudorandom permutation deals them out, so that a shard of fixed size gets
multinomial counts of the sources, given that the totals are right (a multivariate hypergeometric draw). A source's slots
are numbered; each run of as many slots as the source has blocks is one pass over it, in the order of a pseudorandom
permutation of that pass; slots and blocks are joined by index. No pass after ``max_passes`` is made, so no word is
taken more often. Everything follows from a seed and the rows, so reruns and lost tasks agree.

Counts drawn for each shard by itself would add up to the targets only on average, and stray far from them on small
inputs; the permutation draws them all at once.

Defined results: null and empty texts have size 0 and take no part; a null source is a source of its own, the last;
null ids are values like others; repeated rows are separate rows, and as they have equal ids and texts it is not
defined which of them gets which of their places; an empty table, or one without words, gives nothing taken; only the
named columns are read, and the output has names of its own.

Windows without a partition run over the table of sources alone, one row each; everything else is dealt by source and
number, in runs of ``shard_slots``, so a source of any size is spread over tasks.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, let, n_words, stored, unused, words

ROUNDS = 24


class Mix(NamedTuple):
    """``rows``: (doc_id, hash, source, size, start, source_size, target, source_key): ``start`` is unique in a source among rows with words.
    ``sources``: their totals and targets. ``slots``: (shard, slot, source_key, pass, block). ``pieces``: (source_key, block, start, from_word, n_words)."""

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame

    def taken(self) -> DataFrame:
        """(source_key, start, pass, shard, slot, from_word, n_words): the words of a row that a slot takes."""
        # what the slots' plan seems to weigh is far less than what they do: never let it be broadcast
        return self.slots.hint("merge").join(self.pieces.hint("merge"), ["source_key", "block"])


def uniform(*parts) -> Column:
    """From 0 to 1, from a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def permuted(x: Column, n: Column, *key) -> Column:
    """Place of x in a pseudorandom permutation of 0 .. n-1: the swap-or-not shuffle of Hoang, Morris and Rogaway (CRYPTO 2012)."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("k"), r, *key), n) - x, n)
        swap = F.xxhash64(F.lit("b"), F.greatest(x, other), r, *key) % 2 == 0
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, step)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_passes: int) -> DataFrame:
    """``sizes``: (source_key, source_size), keys in order. Adds weight and target.

    Weights repeat in the order of the keys and share the total. A target stops at ``max_passes`` times its source;
    the excess is shared anew by weight. Sorted by the share at which they stop, sources stop until the share that
    is left for the others is below the next one's.
    """
    place = F.row_number().over(Window.orderBy("source_key")) - 1
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    w = sizes.withColumn("weight", F.get(cycle, place % len(weights)))
    w = w.withColumn("stop", max_passes * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("stop", "source_key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    left = total - F.coalesce(F.sum(max_passes * F.col("source_size")).over(before), F.lit(0))
    w = w.withColumn("level", left / F.sum("weight").over(after))
    w = w.withColumn("level", F.max(F.when(F.col("stop") > F.col("level"), F.col("level"))).over(Window.partitionBy()))
    capped = (max_passes * F.col("source_size")).cast("double")
    return w.withColumn("target", F.least(capped, F.coalesce(F.col("weight") * F.col("level"), capped))).drop("stop", "level")


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    max_passes: int = 3,
    block_words: int = 64,
    shard_slots: int = 16384,
    seed: int = 17,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> Mix:
    key = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("t"))  # after all others, which begin with s
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("hash"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), key.alias("source_key"))
    rows = stored(rows, "sizes")
    # where each row begins in its source's line: sums in buckets, then over buckets, each about a root of the rows
    some = rows.filter("size > 0")
    buckets = math.isqrt(some.count()) + 1
    some = some.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(buckets)))
    inside = Window.partitionBy("source_key", "bucket").orderBy("doc_id", "hash").rowsBetween(Window.unboundedPreceding, -1)
    sums = some.groupBy("source_key", "bucket").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_key", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    placed = some.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(sums, ["source_key", "bucket"]).withColumn("start", F.col("ahead") + F.col("inside")).drop("bucket", "ahead", "inside")
    rows = placed.unionByName(rows.filter("size = 0").withColumn("start", F.lit(None).cast("long")))

    sources = source_targets(rows.groupBy("source_key").agg(F.sum("size").alias("source_size")), weights, max_passes)
    sources = sources.withColumn("n_blocks", F.ceil(F.col("source_size") / block_words))
    sources = stored(sources.withColumn("expected", F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(0.0)), "sources")
    rows = stored(rows.join(sources.select("source_key", "source_size", "target"), "source_key"), "rows")

    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    pieces = rows.filter("size > 0").select("source_key", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("block") * block_words, F.col("start"))
    end = F.least((F.col("block") + 1) * block_words, F.col("start") + F.col("size"))
    pieces = pieces.select("source_key", "block", "start", (begin - F.col("start")).alias("from_word"), (end - begin).alias("n_words"))
    return Mix(rows, sources, _slots(sources, shard_slots, max_passes, seed), pieces)


def _slots(sources: DataFrame, shard_slots: int, max_passes: int, seed: int) -> DataFrame:
    """Every slot of the output: the source's slots lie one after another in a line, which is then permuted as a whole."""
    spark = sources.sparkSession
    # whole counts that differ from what is expected by less than one, in the line and in total
    line = Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sources.withColumn("end", F.round(F.sum("expected").over(line)).cast("long")).withColumn("begin", F.coalesce(F.lag("end").over(Window.orderBy("source_key")), F.lit(0)))
    placed = stored(placed.select("source_key", "n_blocks", "begin", "end").filter("end > begin"), "line")
    total = int(placed.agg(F.coalesce(F.max("end"), F.lit(0))).first()[0])
    # one source can have most slots, so they are made in runs, spread over tasks
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("end") - F.col("begin") - 1) / shard_slots))).alias("run")
    runs = placed.select("*", run).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source_key", "run")
    first = F.col("run") * shard_slots
    last = F.least(F.col("end") - F.col("begin"), first + shard_slots) - 1
    slots = runs.select("source_key", "n_blocks", "begin", F.explode(F.sequence(first, last)).alias("slot"))
    slots = slots.filter(F.col("slot") < max_passes * F.col("n_blocks"))
    turn = F.floor(F.col("slot") / F.col("n_blocks"))
    block = permuted(F.col("slot") % F.col("n_blocks"), F.col("n_blocks"), F.lit(seed), F.col("source_key"), turn)
    place = permuted(F.col("begin") + F.col("slot"), F.lit(max(total, 1)).cast("long"), F.lit(seed), F.lit("line"), F.lit(0).cast("long"))
    # not null for the planner too, or a join would compute it a second time to test it
    known = lambda c: F.coalesce(c, F.lit(-1).cast("long"))
    return slots.select(F.floor(known(place) / shard_slots).alias("shard"), "slot", "source_key", turn.alias("pass"), known(block).alias("block"))


def taken_words(mix: Mix) -> DataFrame:
    """``mix.rows`` with ``taken``: how many of a row's words the mix takes, repeats counted."""
    got = mix.taken().groupBy("source_key", "start").agg(F.sum("n_words").alias("taken"))
    return mix.rows.join(got, ["source_key", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_texts(mix: Mix, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` as the mix takes them: a row for each pass that takes words of a row, with the words that it takes.

    Where a pass takes all words, the text is the row's own; else the words taken, with one space between.
    """
    x = unused(docs)
    key = lambda i, h: F.xxhash64(F.coalesce(i.cast("string"), F.lit("none")), h)
    copies = lambda *order: F.row_number().over(Window.partitionBy(x + "key").orderBy(*order))
    spans = F.array_sort(F.collect_list(F.struct("from_word", "n_words"))).alias(x + "spans")
    got = mix.taken().groupBy("source_key", "start", "pass").agg(F.sum("n_words").alias("n"), spans)
    keyed = mix.rows.filter("size > 0").withColumn(x + "key", key(F.col("doc_id"), F.col("hash"))).withColumn(x + "copy", copies("source_key", "start"))
    keyed = keyed.select("source_key", "start", "size", x + "key", x + "copy", F.col("doc_id").alias(x + "id"), F.col("hash").alias(x + "of"))
    got = got.join(keyed, ["source_key", "start"]).select(x + "key", x + "copy", x + "id", x + "of", x + "spans", (F.col("n") == F.col("size")).alias(x + "all"))
    # repeated rows are told apart by number; that, and the id in full, is compared where the key has brought rows
    # together, so the texts move once
    # rows without words are never taken: they would be one group of equal rows
    full = docs.filter(F.rlike(text, F.lit(WORD))).withColumn(x + "hash", F.xxhash64(text)).withColumn(x + "key", key(F.col(doc_id), F.col(x + "hash"))).withColumn(x + "number", copies(x + "hash"))
    same = F.coalesce(F.col(x + "id") == F.col(doc_id), F.col(x + "id").isNull() & F.col(doc_id).isNull())
    one = (F.col(x + "copy") <= F.col(x + "number")) & (F.col(x + "copy") >= F.col(x + "number"))
    out = got.hint("merge").join(full.hint("merge"), x + "key").filter(same & one)
    part = lambda w, s: F.slice(w, (s["from_word"] + 1).cast("int"), s["n_words"].cast("int"))
    cut = let(words(F.col(text)), lambda w: F.array_join(F.flatten(F.transform(x + "spans", lambda s: part(w, s))), " "))
    return out.withColumn(text, F.when(F.col(x + "all"), F.col(text)).otherwise(cut)).select(*docs.columns)
