"""Operator 5, near duplicates among vectors: randomly rotated binary codes with stored correction factors.

Vectors are scaled to length one and rotated at random; a vector's code is the signs of its rotated coordinates, and
its correction factor is how well that code points along it. From code, factor and another vector's coordinates the
inner product is estimated without bias, with a bound on the error (after RaBitQ, SIGMOD 2024). Pairs whose bound reaches
the threshold are estimated again from 16-bit coordinates, whose rounding is bounded for certain; where that bound too
has the threshold inside, the pair is computed again from the vectors, in double precision.

Candidates are vectors that agree in all signs of one of several bands. The bands grow by one sign with each doubling
of the rows, and their number follows from the share of links at the very threshold that may be missed (``miss``); closer
pairs are missed far more rarely. Equal vectors are one class and are never compared. A bucket too large for one block is
compared block with block, in tasks of their own. A pair that agrees in several bands is counted in the first of them.

What a task gives is, for each of its vectors, how many others it is linked with, and the components of its own links:
never pairs, but for those to be computed again. In crowded buckets, vectors so near one of them (at half the angle of
the threshold) that all of them must be linked with each other form a crowd: their links are counted, and only their
pairs with others are compared, so a crowd may be of any size. A bucket of many vectors that are near but not so near
takes time by the square of its size.

Defined results: a vector that is null, empty or zero, or holds null or non-finite components, is linked with nothing,
as is a row whose id is null (its component is null and it is kept); vectors of different lengths are never linked;
repeated rows count as other vectors; an empty table gives an empty table. Only two columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import forest, paired_blocks, runs
from .common import stored
from .graph import components

CODE_SEED = 1000
#: Rows of one block of a bucket; in a bucket of more than CROWDED a crowd is looked for.
BLOCK, CROWDED = 2048, 4096
#: Vectors that share a bucket by accident, about.
CELL = 1024
#: For rounding in double precision.
TINY = 1e-9


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random rotation of ``dim`` dimensions."""
    q, r = np.linalg.qr(np.random.default_rng([dim, seed]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit_vectors(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signs packed in bytes, correction factor: inner product of a vector with its code's direction, rotated coordinates in 16 bits, their step)."""
    turned = unit @ rotation(unit.shape[1], CODE_SEED).T
    step = np.abs(turned).max(1) / 32767
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / math.sqrt(unit.shape[1]), np.rint(turned / step[:, None]).astype(np.int16), step


def estimated(code: np.ndarray, factor: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the inner products of vectors known by code and factor with vectors known by coordinates: (unbiased estimate, its standard deviation)."""
    dim = whole.shape[1]
    signs = np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1
    got = (signs @ whole.T) / (math.sqrt(dim) * factor[:, None]).astype(np.float32)
    return got, (np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(max(dim - 1, 1e-9)))[:, None]


def rounding(step: np.ndarray, dim: int) -> np.ndarray:
    """How far a vector can be from its rounded coordinates, at most; and what single precision adds to a product."""
    return step / 2 * math.sqrt(dim) + dim * 2.0**-23


def plan(n: int, cosine: float, miss: float) -> tuple[int, int]:
    """(signs in a band, bands) for n vectors: about CELL members a bucket by accident, and at most ``miss`` links at the threshold missed."""
    signs = min(30, max(4, math.ceil(math.log2(max(n, 2) / CELL))))
    agree = (1 - math.acos(cosine) / math.pi) ** signs
    return signs, math.ceil(math.log(miss) / math.log1p(-agree))


KEPT = "id long, copies long, dim int, keys binary, code binary, factor double, whole binary, step double"


def _encode(signs: int, bands: int):
    weights = (np.uint32(1) << np.arange(signs, dtype=np.uint32)).astype(np.uint32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, copies, lists = batch.columns
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                if dim not in turned:
                    turned[dim] = np.hstack([rotation(dim, k).T for k in range(-(-signs * bands // dim))])[:, : signs * bands]
                for part in np.array_split(rows, -(-len(rows) // 512)):
                    unit = unit_vectors(flat[starts[part][:, None] + np.arange(dim)])
                    code, factor, whole, step = codes(unit)
                    bits = (unit @ turned[dim] > 0).reshape(len(part), bands, signs)
                    keys = (bits * weights).sum(2, dtype=np.uint32)
                    binary = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
                    at = pa.array(part)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(at), copies.take(at), pa.array(np.full(len(part), dim), pa.int32()), binary(keys), binary(code), pa.array(factor), binary(whole), pa.array(step)],
                        ["id", "copies", "dim", "keys", "code", "factor", "whole", "step"],
                    )

    return encode


def _rows(column: pa.ChunkedArray, kind) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _linked(cosine: float, deviations: float):
    """Of the tasks (key, i, j): rows (a, b, n). With n over 0: a is linked with n others; with -1: a reaches b; with 0: compute a and b again."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            a, b, n = np.hstack(out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])

        size = 0
        for run in runs(batches, ("key", "i", "j")):
            if run.num_rows < 2:
                continue
            ids, copies, factor, step, block, band = (run.column(c).to_numpy() for c in ("id", "copies", "factor", "step", "block", "band"))
            loose, crowd = run.column("crowd").is_null().to_numpy(), run.column("crowd").fill_null(0).to_numpy()
            i, j = run.column("i")[0].as_py(), run.column("j")[0].as_py()
            code, keys = _rows(run.column("code"), np.uint8), _rows(run.column("keys"), np.uint32)
            whole = _rows(run.column("whole"), np.int16).astype(np.float32) * step[:, None].astype(np.float32)
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            near = rounding(step, whole.shape[1])
            ends, again = [], []
            for rows in np.array_split(left, -(-len(left) // 512)):
                got, sd = estimated(code[rows], factor[rows], whole[right])
                may = got + (deviations * sd + near[right][None, :]) >= cosine
                if i == j:
                    may &= rows[:, None] < right[None, :]
                a = np.flatnonzero(may.any(1))
                if not len(a):
                    continue
                better = whole[rows[a]] @ whole[right].T
                bound = near[rows[a]][:, None] + 1.01 * near[right][None, :] + TINY
                x, y = np.nonzero(may[a] & (better + bound >= cosine))
                sure = better[x, y] - bound[x, y] >= cosine
                x, y = rows[a][x], right[y]
                # a pair counts in the first band in which it agrees, and not if it is of one crowd
                mine = ((keys[x] == keys[y]).argmax(1) == band[0]) & (loose[x] | loose[y] | (crowd[x] != crowd[y]))
                ends.append(np.stack([x[mine & sure], y[mine & sure]]))
                again.append(np.stack([x[mine & ~sure], y[mine & ~sure]]))
            if ends:
                x, y = np.hstack(ends)
                count = np.bincount(x, copies[y], len(ids)) + np.bincount(y, copies[x], len(ids))
                at = np.flatnonzero(count)
                out.append(np.stack([ids[at], ids[at], count[at].astype(np.int64)]))
                least = ids[forest(len(ids), x, y)]
                at = np.flatnonzero(least != ids)
                out.append(np.stack([ids[at], least[at], np.full(len(at), -1)]))
                x, y = np.hstack(again)
                out.append(np.stack([ids[x], ids[y], np.zeros(len(x), np.int64)]))
                size += sum(o.shape[1] for o in out[-3:])
            if size > 100_000:
                yield flush()
                size = 0
        if size:
            yield flush()

    return scan


def _exact(cosine: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = ((c := batch.column(k)).flatten().to_numpy().astype(np.float64) for k in (2, 3))
            at = batch.column(2).offsets.to_numpy()
            at = (at - at[0])[:-1]
            dot, xx, yy = (np.add.reduceat(p, at) for p in (x * y, x * x, y * y))
            yield batch.select([0, 1]).filter(pa.array(dot / (np.sqrt(xx) * np.sqrt(yy)) >= cosine))

    return keep


def _beside(cosine: float):
    """(id, hub) of the rows whose vector is so near the hub's that any two such are linked, whatever is rounded."""
    half = math.cos(math.acos(cosine) / 2)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.binary_length(batch.column("whole")).to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                mine, hub = (_rows(part.column(c), np.int16).astype(np.float64) * part.column(s).to_numpy()[:, None] for c, s in (("whole", "step"), ("hub_whole", "hub_step")))
                slack = sum(rounding(part.column(s).to_numpy(), mine.shape[1]) for s in ("step", "hub_step")) * 1.01 + 1e-6
                yield part.select(["id", "hub"]).filter(pa.array((mine * hub).sum(1) - slack >= half))

    return keep


def _crowds(each: DataFrame, coded: DataFrame, cosine: float) -> DataFrame:
    """(id, crowd): a vector of a crowded bucket with the least hub that it is beside; the hub is the bucket's least vector."""
    hubs = each.groupBy("key").agg(F.count("*").alias("of"), F.min("id").alias("hub")).filter(F.col("of") > CROWDED)
    known = hubs.join(coded.select(F.col("id").alias("hub"), F.col("whole").alias("hub_whole"), F.col("step").alias("hub_step")), "hub").drop("of")
    near = each.join(known, "key").select("id", "hub", "whole", "step", "hub_whole", "hub_step").repartition("id")
    return near.mapInArrow(_beside(cosine), "id long, hub long").groupBy("id").agg(F.min("hub").alias("crowd"))


def near_vectors(vectors: DataFrame, cosine: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", miss: float = 0.01, deviations: float = 4.0) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``; linked: cosine of at least ``cosine``."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fit = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", good) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(fit, F.transform("v", lambda x: x + F.lit(0.0))))
    classes = stored(rows.filter("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "classes")
    signs, bands = plan(classes.count(), cosine, miss)
    coded = stored(classes.select("id", "copies", "v").mapInArrow(_encode(signs, bands), KEPT), "codes")
    bits = F.substring(F.col("keys"), F.col("band") * 4 + 1, F.lit(4))
    each = coded.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))).withColumn("key", F.xxhash64("dim", "band", bits))
    crowds = stored(_crowds(each, coded, cosine), "crowds")
    tasks = paired_blocks(each.join(crowds, "id", "left"), "key", BLOCK, "crowd")
    tasks = tasks.select("key", "i", "j", "block", "band", "id", "copies", "crowd", "keys", "code", "factor", "whole", "step")
    found = stored(tasks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_linked(cosine, deviations), "a long, b long, n long"), "found")

    side = lambda i, v: classes.select(F.col("id").alias(i), F.col("v").alias(v))
    again = found.filter("n = 0").select("a", "b").distinct()
    both = again.join(side("b", "vb"), "b").join(side("a", "va"), "a").filter(F.size("va") == F.size("vb")).select("a", "b", "va", "vb")
    links = stored(both.mapInArrow(_exact(cosine), "a long, b long"), "links")
    copies = classes.select(F.col("id").alias("o"), "copies")
    ends = links.select(F.col("a").alias("id"), F.col("b").alias("o")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("o")))
    members = crowds.join(classes.select("id", "copies"), "id")
    crowd = members.join(members.groupBy("crowd").agg(F.sum("copies").alias("whole")), "crowd")
    counts = ends.join(copies, "o").select("id", F.col("copies").alias("n")).unionByName(found.filter("n > 0").select(F.col("a").alias("id"), "n"))
    counts = counts.unionByName(crowd.select("id", (F.col("whole") - F.col("copies")).alias("n")))
    degree = counts.groupBy("id").agg(F.sum("n").alias("near"))
    edges = found.filter("n = -1").select("a", "b").unionByName(links)
    edges = edges.unionByName(_to_least(members))
    known = classes.join(degree, "id", "left").join(components(edges), "id", "left")
    known = known.select("v", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("c"))
    out = rows.join(known, "v", "left")
    least = F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), least.alias("component_id"), F.coalesce(F.col("vec_id") == least, F.lit(True)).alias("kept"))


def _to_least(members: DataFrame) -> DataFrame:
    """Edges that hold a crowd together: from each member to the least."""
    least = members.groupBy("crowd").agg(F.min("id").alias("b"))
    return members.join(least, "crowd").select(F.col("id").alias("a"), "b")
