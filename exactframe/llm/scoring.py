"""Operator 9, language-model scoring: marginal probability over all subword segmentations.

A text is a row of pieces of an existing vocabulary and then one end; each word begins with a space, and pieces have a
space at their start only. A word's probability is the sum, over all ways of spelling it with pieces, of the product
of their weights: a forward recursion in log space over its lattice. A text's is the product over its words and the
end, so the probabilities of all texts add up to one.

The weights start from the vocabulary's own scores and are fitted to the training words, each counted as often as it
occurs, by expectation-maximization: first to the most frequent words, as a start, then to all distinct words until the
log-probability of a word gains less than TOLERANCE. The end's weight comes from the number of training documents.

Words are counted in each task and then summed; each distinct word is scored once. The most frequent words, HEAD at
most, go to every task; the other words of a document are joined by word, so no frequent word is ever a key of that
join. To the driver come one row for each piece of the vocabulary and task of the last sum, and the HEAD words.

Defined results: a null or empty text is an end alone; a null id is not held out; repeated rows are scored each by
itself and all count in training; a word of any length counts and is scored whole; without training rows the pieces keep
their first weights and the end has a half; an empty table gives an empty table. Only two columns are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .lattice import Lattice, vocabulary

#: Most words sent to every task.
HEAD = 100_000
#: Fitting ends when a word's log-probability (natural, on average) gains less than this, or after so many steps.
TOLERANCE, STEPS = 0.01, 20
#: Tasks that fit the most frequent words.
FIRST_TASKS = 6
#: Words fitted together in a task.
CHUNK = 200_000
#: Added to each piece's expected count.
FLOOR = 0.01
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int | None, list[bytes]]]:
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
        yield i, (t.as_py() or b"").translate(_LOWER).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, times in training, documents in training: on one row with a null word)."""

    def out() -> pa.RecordBatch:
        words = [*train, *(w for w in other if w not in train)]
        counts = [*train.values(), *([0] * (len(words) - len(train)))]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["word", "c"])

    train: Counter[bytes] = Counter()
    other: set[bytes] = set()
    ends = 0
    for batch in batches:
        for i, ws in _rows(batch):
            if held_out(i):
                other.update(ws)
            else:
                train.update(ws)
                ends += 1
            if len(train) + len(other) > 500_000:
                yield out()
                train.clear()
                other.clear()
    yield out()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([ends], pa.int64())], ["word", "c"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _expect(pieces, weights):
    """(word, c) to (piece, expected count); the log-probability of the words on a row with piece -1."""

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces.value, weights)
        total, lp = np.zeros(len(weights)), 0.0
        for words in _chunks(batches):
            n, l = lattice.expected(words.column(0).to_pylist(), words.column(1).to_numpy().astype(float))
            total, lp = total + n, lp + l
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([lp, *total[at]])], ["piece", "n"])

    return expect


def _word_scores(pieces, weights):
    """(word, c) to (word, c, natural log of the word's probability)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces.value, weights)
        for words in _chunks(batches):
            lp = pa.array(lattice.log_probability(words.column(0).to_pylist()))
            yield from pa.table([words.column(0), words.column(1), lp], ["word", "c", "lp"]).to_batches(10_000)

    return score


def fit_pieces(words: DataFrame, first: DataFrame, n_words: int, ends: int, pieces, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights of the pieces, weight of the end), which add up to one. ``words``, and ``first`` among them: (word, c) in training."""
    weights, end = weights / weights.sum() / 2, 0.5
    for part, size in ((first, None), (words, n_words)):
        before = None
        for _ in range(STEPS if n_words else 0):
            # a row for each piece of the vocabulary
            got = part.mapInArrow(_expect(pieces, weights), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
            at, n = got["piece"].to_numpy(), got["n"].to_numpy()
            total = np.full(len(weights), FLOOR)
            total[at[at >= 0]] += n[at >= 0]
            size = size or first.agg(F.sum("c")).first()[0]
            share = (ends + 1) * size / n_words  # so that a part has its part of the ends
            weights, end = total / (total.sum() + share), share / (total.sum() + share)
            now = float(n[at < 0].sum()) / size
            if before is not None and now - before < TOLERANCE:
                break
            before = now
    return weights, float(end)


def _documents(head):
    """For each document a row with the sums over its frequent words, and a row for each of its other words.

    The first kind has a word that no text can have, a line break and the row's number, and so matches nothing.
    """
    names = ["row", "doc_id", "n_tokens", "n_known", "base", "score", "word", "n"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, base, lp, known = head.value["words"], head.value["base"], head.value["lp"], head.value["known"]
        at = {w: k for k, w in enumerate(words)}
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for i, ws in _rows(batch):
                got = [at.get(w, -1) for w in ws]
                ids = np.array(got, np.int64)
                rest = Counter(w for w, k in zip(ws, got, strict=True) if k < 0) if (ids < 0).any() else {}
                ids = ids[ids >= 0]
                values = (row, i, len(ws) + 1, int(known[ids].sum()), float(base[ids].sum()), float(lp[ids].sum()), b"\n%d" % row, 1)
                for column, v in zip(out, values, strict=True):
                    column.append(v)
                for w, n in rest.items():
                    for column, v in zip(out, (row, None, None, None, None, None, w, n), strict=True):
                        column.append(v)
                row += 1
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)
                    out = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    return scan


def score_documents(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; scores as log10."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counted = stored(rows.mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")
    words = counted.filter("word is not null")
    f = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    ends = counted.filter("word is null").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    n, v = f.n + ends, f.v + (ends > 0)

    pieces, weights = vocabulary(vocabulary_path)
    shared = sc.broadcast(pieces)
    train = words.filter("c > 0")
    frequent = stored(train.orderBy(F.desc("c"), "word").limit(HEAD).repartition(FIRST_TASKS), "frequent")
    weights, end = fit_pieces(train, frequent, f.n, ends, shared, weights)
    scored = stored(words.mapInArrow(_word_scores(shared, weights), "word binary, c long, lp double"), "scores")

    base_of = lambda c: np.log10((np.asarray(c, float) + 1) / (n + v + 1))
    top = scored.filter("c > 0").orderBy(F.desc("c"), "word").limit(HEAD).toPandas()
    head = sc.broadcast(
        {"words": [bytes(w) for w in top["word"]], "base": base_of(top["c"]), "lp": top["lp"].to_numpy(), "known": np.ones(len(top), np.int64)}
    )
    kinds = "row long, doc_id long, n_tokens long, n_known long, base double, score double, word binary, n long"
    parts = rows.mapInArrow(_documents(head), kinds)
    joined = parts.join(scored, "word", "left")
    rare = F.log10((F.col("c") + 1) / float(n + v + 1))
    sums = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.when(F.col("c") > 0, F.col("n")), F.lit(0))).alias("n_known"),
        F.sum(F.coalesce("base", F.col("n") * rare)).alias("base"),
        F.sum(F.coalesce("score", F.col("n") * F.col("lp"))).alias("score"),
    )
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    return sums.select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        (F.col("n_known") + int(ends > 0)).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + float(base_of(ends))).alias("base_score"),
        ((F.col("score") + float(np.log(end))) / float(np.log(10))).alias("score"),
    )
