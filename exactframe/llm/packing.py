"""Operator 7, packing: vector bin packing with the dot-product heuristic.

Every example is a vector: its tokens, one segment, its loss-bearing tokens. A sequence has a capacity in each. The
open sequence takes, of the examples that fit in all three, the one whose vector has the largest inner product with what
is left of its capacity (Panigrahy et al., 2011); where loss runs out sooner than room, that is not the longest one.

Instruction data: an example may be several parts, each with or without loss (``parts``, as ``format_chat`` gives them),
and with ``cut=False`` only examples that no sequence can hold are cut. Where examples may be cut, long ones first give
whole sequences, and what is left in a sequence that nothing fits, or that has one segment left, is filled with the start
of the longest example. The last open sequence of a task is then cut at powers of two, which need no padding.

It is one pass over the rows, without a shuffle: a task packs its own rows, ROWS of them at a time, and carries over only
the open sequence. More rows at a time pack a little tighter and take more memory; on the test tables padding is below
1 % of the tokens. What is left of a sequence is given up below ``Limits.least_cut`` tokens, 0.4 % of a sequence at most.
Sequence numbers follow from the task's number, so a task that runs again on the same rows gives the same; rows that come
in another order when they are computed again (from a shuffle) should be written first, as the pipeline does.

Defined results: a null or empty text is a document of the end mark alone; a null id stays null; repeated rows are
packed each by itself; a text may be longer than any sequence; a null list of parts, and a null part, count as empty; an
empty table gives an empty table. Only the named columns are read, and the output has names of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import grouped, tidy
from .tokens import word_tokenizer

#: Bits of a sequence number for the sequences of one task.
TASK_BITS = 40
#: Rows packed together.
ROWS = 2000


class Limits(NamedTuple):
    tokens: int = 2048
    segments: int = 32
    loss: int = 2048
    #: What is left of a sequence is filled by cutting an example only if it is as large as this.
    least_cut: int = 8


class Piece(NamedTuple):
    item: int
    start: int
    length: int


class Packer:
    """Packs items into sequences: lists of pieces. With ``cut``, items may be cut anywhere, else only those that no sequence can hold.

    An item is its tokens and, for each of its places, how many tokens before it bear loss; None where all of them do.
    """

    def __init__(self, limits: Limits, cut: bool):
        self.limits, self.cut = limits, cut
        self.room = np.array([limits.tokens, limits.segments, limits.loss], np.int64)
        self.open: list[Piece] = []
        self.left = self.room.copy()

    def _put(self, item: int, start: int, length: int, loss: int) -> None:
        self.open.append(Piece(item, start, length))
        self.left -= (length, 1, loss)

    def _close(self) -> list[Piece]:
        done, self.open, self.left = self.open, [], self.room.copy()
        return done

    @staticmethod
    def _most(cum: np.ndarray | None, start: int, tokens: int, loss: int) -> int:
        """How many tokens from ``start`` on have at most so many tokens and so much loss."""
        if cum is None:
            return min(tokens, loss)
        return min(tokens, int(np.searchsorted(cum, cum[start] + loss, "right")) - 1 - start)

    def add(self, first: int, tokens: np.ndarray, loss: list[np.ndarray | None]) -> Iterator[list[Piece]]:
        """Items numbered from ``first``: gives the sequences that are full."""
        bearing = lambda k, a, b: b - a if loss[k] is None else int(loss[k][b] - loss[k][a])
        start = np.zeros(len(tokens), np.int64)
        bears = np.array([bearing(k, 0, n) for k, n in enumerate(tokens.tolist())], np.int64)
        for k in np.flatnonzero((tokens >= self.room[0]) | (bears >= self.room[2])).tolist():
            while True:  # whole sequences of its own, each full in one respect
                at, n = int(start[k]), self._most(loss[k], int(start[k]), int(self.room[0]), int(self.room[2]))
                left = int(tokens[k]) - at
                if left <= n and (left < self.room[0] and (bears[k] < self.room[2] or not self.cut)):
                    break
                n = min(n, left)
                yield [Piece(first + k, at, n)]
                start[k] += n
                bears[k] -= bearing(k, at, at + n)
                if n == left:
                    break
        # the waiting items, sorted by tokens, so that those that fit are at the front
        item = np.flatnonzero(tokens - start > 0)
        item = item[np.argsort((tokens - start)[item], kind="stable")]
        size = (tokens - start)[item]
        bears = bears[item]
        m = len(item)
        weight = 1.0 / self.room.astype(float) ** 2
        while m:
            n = int(np.searchsorted(size[:m], self.left[0], "right")) if self.left[1] else 0
            best = -1
            if n:
                score = size[:n] * (self.left[0] * weight[0]) + bears[:n] * (self.left[2] * weight[2])  # the segment is the same for all
                score[bears[:n] > self.left[2]] = -1.0
                best = n - 1 - int(np.argmax(score[::-1]))
                best = best if score[best] >= 0 else -1
            last = self.cut and self.left[1] == 1 and n < m and (best < 0 or self.left[0] - size[best] >= self.limits.least_cut)
            if best >= 0 and not last:
                k = int(item[best])
                self._put(first + k, int(start[k]), int(size[best]), int(bears[best]))
                for a in (item, size, bears):
                    a[best : m - 1] = a[best + 1 : m]
                m -= 1
                continue
            if self.cut and self.left[0] >= self.limits.least_cut and self.left[1]:
                best = m - 1
                k, whole, bearing_ = int(item[best]), int(size[best]), int(bears[best])
                part = min(self._most(loss[k], int(start[k]), int(self.left[0]), int(self.left[2])), whole - 1)
                if part > 0:
                    took = bearing(k, int(start[k]), int(start[k]) + part)
                    self._put(first + k, int(start[k]), part, took)
                    start[k] += part
                    place = int(np.searchsorted(size[:m], whole - part))  # it moves towards the front
                    for a, v in ((item, k), (size, whole - part), (bears, bearing_ - took)):
                        a[place + 1 : m] = a[place : m - 1].copy()
                        a[place] = v
            yield self._close()

    def finish(self) -> Iterator[list[Piece]]:
        """The last sequence: as it is, or cut at powers of two."""
        if not self.open:
            return
        pieces = self._close()
        total = sum(p.length for p in pieces)
        while pieces:
            size = 1 << (total.bit_length() - 1) if self.cut else total
            out, room = [], size
            while room:
                p = pieces[0]
                n = min(room, p.length)
                out.append(Piece(p.item, p.start, n))
                room -= n
                pieces = pieces[1:] if n == p.length else [Piece(p.item, p.start + n, p.length - n), *pieces[1:]]
            total -= size
            yield out


def _rowsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ROWS rows at a time, however many a batch has."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, ROWS - n))
            n += held[-1].num_rows
            batch = batch.slice(held[-1].num_rows)
            if n == ROWS:
                yield pa.concat_batches(held)
                held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _packed(path: str, end: int, limits: Limits, cut: bool):
    mark = np.array([end], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "loss"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        sequence = TaskContext.get().partitionId() << TASK_BITS
        packer = Packer(limits, cut)
        held: dict[int, tuple[object, bytes, np.ndarray | None]] = {}  # examples of this batch, and those that the open sequence still needs
        count = 0

        def rows(done: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal sequence
            out: list[list] = [[] for _ in names]
            for pieces in done:
                at = 0
                for p in pieces:
                    doc, ids, cum = held[p.item]
                    loss = p.length if cum is None else int(cum[p.start + p.length] - cum[p.start])
                    for column, v in zip(out, (doc, p.start, p.length, ids[4 * p.start : 4 * (p.start + p.length)], len(ids) // 4, sequence, at, loss), strict=True):
                        column.append(v)
                    at += p.length
                sequence += 1
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

        for batch in _rowsets(batches):
            first = count
            docs = batch.column(0).to_pylist()
            if pa.types.is_string(batch.schema.field(1).type):
                for group in grouped(x.as_py() for x in batch.column(1).cast(pa.binary())):
                    for one in tokenizer.ids(group):
                        held[count] = (docs[count - first], one + mark, None)
                        count += 1
            else:
                for doc, parts in zip(docs, batch.column(1), strict=True):
                    given = [p for p in parts.as_py() or () if p is not None]
                    ids = tokenizer.ids([(p["text"] or "").encode() for p in given])
                    # the end is learnt as its part is
                    flags = [bool(p["loss"]) for p in given]
                    cum = np.append(0, np.cumsum(np.repeat([*flags, flags[-1] if flags else False], [*(len(x) // 4 for x in ids), 1])))
                    held[count] = (doc, b"".join(ids) + mark, cum)
                    count += 1
            sizes = np.array([len(held[k][1]) // 4 for k in range(first, count)], np.int64)
            done: list[list[Piece]] = []
            for pieces in packer.add(first, sizes, [held[k][2] for k in range(first, count)]):
                done.append(pieces)
                if len(done) == 500:
                    yield rows(done)
                    done = []
            if done:
                yield rows(done)
            need = {p.item for p in packer.open}
            held = {k: v for k, v in held.items() if k in need}
        if last := list(packer.finish()):
            yield rows(last)
        tokenizer.runs.clear()
        tidy()

    return pack


def pack_documents(
    docs: DataFrame, tokenizer: str, end: int = 1, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text", parts: str | None = None, cut: bool = True
) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids, doc_tokens, sequence_id, offset, loss); ``ids`` as little-endian unsigned 32-bit numbers.

    ``tokenizer``: path of the tokenizer's file, the same on every machine. ``text``: all its tokens bear loss. ``parts``:
    instead of it, a column of arrays of (text, loss), of which those marked do.
    """
    kinds = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, loss long"
    what = F.col(text).alias("text") if parts is None else F.transform(parts, lambda p: F.struct(p["text"].alias("text"), p["loss"].alias("loss"))).alias("parts")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), what).mapInArrow(_packed(tokenizer, end, limits, cut), kinds)
