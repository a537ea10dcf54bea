"""Operator 1, near duplicates by HyperMinHash.

A document's set is its distinct word shingles. Each shingle's hash picks one of ``registers`` buckets; a bucket keeps
the least remaining hash as its count of leading zeros and ten mantissa bits. Bands of registers that agree give
candidates; the share of agreeing registers, corrected for accidental collisions, gives an estimate of the
similarity that drops the hopeless ones; the rest is decided on the full sets. A bucket that no shingle of a short
text falls into borrows the register of another, found in an order that is its own (optimal densification).

Equal sets are one class from the start and are never compared. In a bucket of equal bands, everyone is first
compared with the least member only. Links found so make components; only where a bucket still holds documents of
different components are documents compared again, only across components: all that share a least member, in blocks,
first by their registers, and those for which the estimate leaves a link possible on their full sets. So the edges that
matter are complete, and groups of copies cost one comparison a member. What a block gives is the components of its own
links, at most one row a document.

Sizes: a shuffle of the texts of candidate documents, and of 16 bytes for each band and class. Nothing is collected.
The worst case is a group of very many documents that share a bucket but are less alike than the threshold: blocks are
compared two by two, so registers (and sets, where the estimate cannot tell) are repeated once for each block of it.

Defined results: a null or empty text has no shingles, size 0, and is linked with nothing; a row whose id is null is
linked with nothing, its component is null and it is kept; rows with one id and one text are one document; rows that
share an id but differ in text count as linked, and whatever links to one of them links to the id. An empty table gives an empty table. Only two columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import forest, paired_blocks, runs
from .common import stored
from .graph import components
from .shingles import HASHED, grouped, mix, shingle_sets, tidy

BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Shares a task's block of documents when what is left is compared.
BLOCK = 512
_U = np.uint64
#: For each register the order in which it looks for one to borrow from.
_BORROW = np.stack([np.random.default_rng([7, k]).permutation(REGISTERS) for k in range(REGISTERS)])


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers: (leading zeros + 1) and the mantissa bits of the least hash; all 0 for no shingles."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(shingles):
        bucket = ((mix(shingles ^ _U(0xA5A5A5A5A5A5A5A5)) >> _U(32)) * _U(REGISTERS)) >> _U(32)
        value = mix(shingles + _U(0x632BE59BD9B4E019)) >> _U(12)  # 52 bits
        both = np.sort((bucket << _U(52)) | value)  # 8 + 52 bits
        of = both >> _U(52)
        first = np.flatnonzero(np.diff(of, prepend=_U(1 << 20)))
        least = both[first] & _U((1 << 52) - 1)
        bits = np.frexp(least.astype(np.float64))[1]  # exact below 2 ** 53
        bits[least == 0] = 0
        zeros = 52 - bits
        tail = (least << (zeros + 1).astype(np.uint64)) & _U((1 << 52) - 1)  # what follows the leading one
        out[of[first].astype(np.int64)] = ((zeros + 1).astype(np.uint64) << _U(MANTISSA)) | (tail >> _U(52 - MANTISSA))
        if len(first) < REGISTERS:
            lent = _BORROW[np.arange(REGISTERS), np.argmax(out[_BORROW] > 0, axis=1)]
            out = np.where(out > 0, out, out[lent])
    return out


def expected_collisions(n: float | np.ndarray, m: float | np.ndarray) -> float | np.ndarray:
    """Registers expected to agree by accident, for sets of n and m elements (Yu and Weber, HyperMinHash, 2017)."""
    ratio = n / m
    return 0.1699 * REGISTERS / 2**MANTISSA * 4 * ratio / (1 + ratio) ** 2


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity estimated from rows of registers a, b of sets of n and m elements."""
    return np.maximum((a == b).sum(1) - expected_collisions(n, m), 0) / REGISTERS


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
        at = 0
        for group in grouped((x.as_py() for x in texts), HASHED):
            sets = shingle_sets(group)
            sums = [(int(mix(s).sum(dtype=np.uint64)) ^ len(s), int(mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64))) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(at, len(group)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([x.to_bytes(8, "big") + y.to_bytes(8, "big") for x, y in sums], pa.binary()),
                    pa.array([registers(s).astype(">u2").tobytes() for s in sets], pa.binary()),
                ],
                ["doc_id", "n", "same", "registers"],
            )
            at += len(group)
    tidy()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
        at = 0
        for group in grouped((x.as_py() for x in texts), HASHED):
            sets = [s.view(np.int64) for s in shingle_sets(group)]
            ends = np.cumsum([0, *map(len, sets)])
            flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(group)), flat], ["id", "shingles"])
            at += len(group)
    tidy()


def _likely(percent: int, deviations: float):
    """Keeps pairs (a, b, n, m, ra, rb) whose estimate, that many standard deviations up, reaches the threshold."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = percent / 100
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (_registers(batch.column(c)) for c in (4, 5))
            n, m = (batch.column(c).to_numpy() for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(_possible(a, b, n, m, t, deviations)))

    return keep


def _registers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(-1, REGISTERS)


def _possible(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, t: float, deviations: float) -> np.ndarray:
    """Whether sets of n and m elements with registers a and b may be as similar as t, by sizes and the estimate."""
    own = REGISTERS * (1 - (1 - 1 / REGISTERS) ** np.maximum(n, m))  # registers that need not borrow, about
    margin = deviations * np.sqrt(t * (1 - t) / np.maximum(own, 1))
    return (np.minimum(n, m) >= np.maximum(n, m) * (t - 1e-9)) & ((own < 48) | (estimate(a, b, n, m) + margin >= t))


def _bands(reps: DataFrame) -> DataFrame:
    """(key, id): a hash for each band of registers."""
    part = F.substring(F.col("registers"), F.col("band") * (2 * ROWS) + 1, F.lit(2 * ROWS))
    each = reps.select("id", "registers", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    return each.select(F.xxhash64("band", part).alias("key"), "id")


def _open_rows(percent: int, deviations: float):
    """Of the tasks (hub, i, j): the rows for which the estimate leaves a link with a document of another part possible."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ("hub", "i", "j")):
            i, j = run.column("i")[0].as_py(), run.column("j")[0].as_py()
            part, block, n = (run.column(c).to_numpy() for c in ("part", "block", "n"))
            regs = _registers(run.column("registers"))
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            some = np.zeros(len(part), bool)
            for k in left.tolist():
                other = right[part[right] != part[k]]
                near = other[_possible(regs[k][None, :], regs[other], n[k], n[other], percent / 100, deviations)] if len(other) else other
                if len(near):
                    some[near] = some[k] = True
            if some.any():
                yield from run.drop_columns(["n", "registers"]).filter(pa.array(some)).combine_chunks().to_batches()

    return scan


def _across(percent: int):
    """Of the tasks (hub, i, j) with rows (part, block, id, shingles): (a, b), a reaching b by links between documents of different parts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ("hub", "i", "j")):
            i, j = run.column("i")[0].as_py(), run.column("j")[0].as_py()
            ids, part, block = (run.column(c).to_numpy() for c in ("id", "part", "block"))
            sets = run.column("shingles").combine_chunks()
            sizes = np.diff(sets.offsets.to_numpy())
            flat, starts = sets.flatten().to_numpy(), np.cumsum(sizes) - sizes
            right = np.flatnonzero(block == j)
            # of each shingle on the right, in order, the documents that have it
            tokens = np.concatenate([flat[starts[k] : starts[k] + sizes[k]] for k in right]) if len(right) else flat[:0]
            owner = np.repeat(np.arange(len(right)), sizes[right])
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            a, b = [], []
            for k in np.flatnonzero(block == i).tolist():
                near = (part[right] != part[k]) & (np.minimum(sizes[right], sizes[k]) * 100 >= np.maximum(sizes[right], sizes[k]) * percent)
                if not near.any():
                    continue
                own = flat[starts[k] : starts[k] + sizes[k]]
                lo, hi = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
                n = hi - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(right))
                found = np.flatnonzero(near & (common * 100 >= (sizes[right] + sizes[k] - common) * percent))
                a.append(np.full(len(found), k))
                b.append(right[found])
            if a and sum(map(len, a)):
                least = ids[forest(len(ids), np.concatenate(a), np.concatenate(b))]
                at = np.flatnonzero(least != ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(least[at])], ["a", "b"])

    return scan


def near_duplicates(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text", deviations: float = 5.0) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``; linked: 100 x intersection >= percent x union."""
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = stored(given.mapInArrow(_sketch, "doc_id long, n long, same binary, registers binary"), "sketches")
    real = rows.filter("n > 0 and doc_id is not null")
    classes = stored(real.groupBy("same", "n").agg(F.min("doc_id").alias("id")), "classes")
    reps = real.withColumnRenamed("doc_id", "id").join(classes, ["same", "n", "id"]).select("id", "n", "registers").dropDuplicates(["id", "n", "registers"])
    reps = stored(reps, "representatives")
    bands = _bands(reps)
    several = stored(bands.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("of")).filter("of > 1").select("key", "hub", "of"), "buckets")
    members = stored(bands.join(several, "key").select("key", "hub", "of", "id"), "members")

    stars = members.filter("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    stars = stored(_estimated(stars, reps, percent, deviations), "pairs")
    # the texts are gone through once more, for all documents that can be compared here or below
    ids = stars.select(F.explode(F.array("a", "b")).alias("id")).unionByName(members.filter("of > 2 and id != hub").select("id")).distinct()
    sets = _sets_of(ids, given)
    links = stored(_confirmed(stars, sets, percent), "links")
    group = components(links)

    # what the stars left open: documents of one bucket, its least member aside, in different components
    part = F.coalesce("component", "id")
    told = members.filter("id != hub").join(group, "id", "left").select("key", "hub", "id", part.alias("part"))
    open_ = told.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low != high").select("key")
    left = stored(told.join(open_, "key").select("hub", "id", "part").distinct(), "open")
    by = ("hub", "i", "j")
    tasks = paired_blocks(left, "hub", BLOCK).join(reps, "id").select(*by, "block", "part", "id", "n", "registers")
    possible = tasks.repartition(*by).sortWithinPartitions(*by).mapInArrow(_open_rows(percent, deviations), "hub long, i int, j int, block int, part long, id long")
    tasks = stored(possible.distinct(), "possible").join(sets, "id").select(*by, "block", "part", "id", "shingles").repartition(*by).sortWithinPartitions(*by)
    more = stored(tasks.mapInArrow(_across(percent), "a long, b long").distinct(), "links")
    merged = components(links.unionByName(more))

    # equal sets and equal ids join in by their class
    of = rows.join(classes, ["same", "n"], "left").join(merged, "id", "left")
    least = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id"))
    return of.select("doc_id", F.col("n").alias("n_shingles"), least.alias("component_id"), F.coalesce(F.col("doc_id") == least, F.lit(True)).alias("kept"))


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int, deviations: float) -> DataFrame:
    """Those of the pairs (a, b) that the sizes and the estimate leave possible."""
    side = lambda i, n, r: reps.select(F.col("id").alias(i), F.col("n").alias(n), F.col("registers").alias(r))
    both = pairs.join(side("b", "m", "rb"), "b").join(side("a", "n", "ra"), "a")
    near = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    return both.filter(near).select("a", "b", "n", "m", "ra", "rb").mapInArrow(_likely(percent, deviations), "a long, b long")


def _sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, shingles) of the documents with these ids: several where rows with one id differ in text."""
    texts = docs.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").withColumn("hash", F.xxhash64("text")).dropDuplicates(["doc_id", "hash"]).select("doc_id", "text")
    return stored(texts.mapInArrow(_sets, "id long, shingles array<long>"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    side = lambda i, s: sets.select(F.col("id").alias(i), F.col("shingles").alias(s))
    both = pairs.join(side("b", "sb"), "b").join(side("a", "sa"), "a")
    common: Column = F.size(F.array_intersect("sa", "sb"))
    either = F.size("sa") + F.size("sb") - common
    return both.filter(common * 100 >= either * percent).select("a", "b")
