"""Operator 4, language identification by Bayesian evidence fusion.

The posterior of a language multiplies: the likelihood of the text (byte trigrams); that of the language declared in
the markup or metadata; that of the address's suffix; and the prior of the host. The tables behind the last three come
from all rows by grouped aggregation of the text's own posteriors: what is declared in texts of each language, which
suffix they have, and what languages a host has. Host priors are smoothed hierarchically, a host towards its domain
and a domain towards all rows, and a row's own share is taken out of its host's. One more class, for text like none
of the languages, has uniform trigrams.

The trigram model alone is fitted on a sample: the SAMPLE rows of each label with the least hash of id and text
length (and rows that tie with the last of them), so a bounded number; the labels are all those that ``label`` has, as
written. Declared languages and suffixes count as written if
they are two or three letters, else as one value, so their tables have at most 18,279 values, which bounds what is
broadcast.

A row is rejected if its text has no letters, if it is like none of the languages, or if no language has half the
posterior.

Defined results: a null or empty text has no text evidence and is rejected; null in the other columns is a value like
others; repeated rows get equal results; an empty table, or one without labels, gives no language and rejects every
row; the caller's columns are kept, and those added are in one struct, whose name the caller can choose.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import stored, unused
from .html import main_text
from .urls import _attribute, host_of

#: Rows of each label, at most, that the trigram model is fitted on.
SAMPLE = 2000
#: Up to so many labels the model is a table of all bins; with more, each bin has the labels whose sample has it.
DENSE = 64
#: Trigrams are counted in so many bins.
BINS = 1 << 16
#: Trigrams that count as independent evidence at most: overlapping ones are not.
WEIGHT = 200.0
#: Rows that a smoothed prior counts as.
STRENGTH = 20.0
NONE = "und"


def bins(text: str) -> np.ndarray:
    """The bins of the byte trigrams of a text's letters, in lower case; runs of others count as one space."""
    b = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8)
    b = b[(b >= 128) | ((b >= 97) & (b <= 122)) | (b == 32)].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    return ((h ^ (h >> np.uint32(15))) & np.uint32(BINS - 1)).astype(np.int64)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for label, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at])], ["label", "bin", "n"])
        counts.clear()

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if label not in counts and len(counts) == DENSE:
                yield from rows()
            counts.setdefault(label, np.zeros(BINS, np.int64))
            np.add.at(counts[label], bins(text.as_py() or ""), 1)
    yield from rows()


class Sparse(NamedTuple):
    """The log-probabilities where there are many languages: that of a bin which a language's sample has not, and what the others have beyond it."""

    base: np.ndarray
    #: The entries of bin b are those from starts[b] to starts[b + 1].
    starts: np.ndarray
    language: np.ndarray
    more: np.ndarray

    def total(self, at: np.ndarray) -> np.ndarray:
        out = self.base * len(at)
        found, times = np.unique(at, return_counts=True)
        for lo in range(0, len(found), 1 << 12):
            b, t = found[lo : lo + (1 << 12)], times[lo : lo + (1 << 12)]
            many = self.starts[b + 1] - self.starts[b]
            k = np.repeat(self.starts[b] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            out += np.bincount(self.language[k], self.more[k] * np.repeat(t, many), len(out))
        return out


def _bounds(known: DataFrame, mark: Column, label: str) -> list[tuple[str, int]]:
    """(label, the mark up to which its rows are in the sample) of every label.

    Marks are counted by their first bits; only those of the slot where a label's count passes SAMPLE are sorted.
    """
    marks = known.select(F.col(label).alias("label"), mark.alias("mark")).withColumn("slot", F.shiftright("mark", 54))
    order = Window.partitionBy("label").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = marks.groupBy("label", "slot").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(order))
    edge = slots.filter((F.col("upto") >= SAMPLE) & (F.col("upto") - F.col("n") < SAMPLE)).select("label", "slot", (F.col("upto") - F.col("n")).alias("before"))
    names = [r[0] for r in slots.select("label").distinct().collect()]
    near = marks.join(F.broadcast(edge), ["label", "slot"]).groupBy("label", "mark", "before").agg(F.count("*").alias("n"))
    order = Window.partitionBy("label").orderBy("mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = near.withColumn("upto", F.col("before") + F.sum("n").over(order)).filter(F.col("upto") >= SAMPLE).groupBy("label").agg(F.min("mark"))
    found = dict(map(tuple, last.collect()))
    return [(n, found.get(n, (1 << 63) - 1)) for n in sorted(names)]


def fit(docs: DataFrame, label: str, text: str, key: str) -> tuple[list[str], np.ndarray | Sparse]:
    """(languages, log-probability of each bin in each language, the last column for none of them)."""
    known = docs.filter(F.col(label).isNotNull())
    mark = F.xxhash64(F.col(key).cast("string"), F.length(text))
    bounds = _bounds(known, mark, label)
    names = [n for n, _ in bounds]
    size = len(names)
    at, bin_, n = np.zeros((3, 0), np.int64)
    if names:
        upto = docs.sparkSession.createDataFrame([(n, k, m) for k, (n, m) in enumerate(bounds)], "label string, at int, upto long")
        rows = known.select(F.col(label).alias("label"), F.col(text).alias("text"), mark.alias("mark")).join(F.broadcast(upto), "label").filter("mark <= upto")
        got = rows.select("at", "text").mapInArrow(_trigrams, "label int, bin int, n long").groupBy("label", "bin").agg(F.sum("n").alias("n")).toPandas()
        at, bin_, n = (got[c].to_numpy() for c in ("label", "bin", "n"))
    whole = np.bincount(at, n, size) + 0.1 * BINS
    if size > DENSE:
        order = np.argsort(bin_, kind="stable")
        base = np.append(np.log(0.1 / whole), -np.log(BINS))
        return names, Sparse(base, np.searchsorted(bin_[order], np.arange(BINS + 1)), at[order].astype(np.int32), np.log1p(n[order] / 0.1).astype(np.float32))
    log = np.full((BINS, size + 1), -np.log(BINS))
    log[:, :size] = np.log(0.1 / whole)
    log[bin_, at] = np.log((n + 0.1) / whole[at])
    return names, log


def text_evidence(log: np.ndarray | Sparse):
    """Column function: the log-likelihoods of the languages, tempered; empty without trigrams."""
    shared = log if isinstance(log, Sparse) else log.astype(np.float32)

    @pandas_udf("array<double>")
    def evidence(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            at = bins(t) if t else ()
            if len(at):
                if isinstance(shared, Sparse):
                    total = shared.total(at)
                else:
                    total = np.zeros(shared.shape[1])
                    for lo in range(0, len(at), 1 << 16):
                        total += shared[at[lo : lo + (1 << 16)]].sum(0)
                out.append((total - total.max()) * min(1.0, WEIGHT / len(at)))
            else:
                out.append(np.zeros(0))
        return pd.Series(out)

    return evidence


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html", text: str = "text", declared: str = "declared", host: str = "host") -> DataFrame:
    """``pages`` with what ``identify`` reads of a page: its main text, the language its markup declares, its address's host.

    The declared language is the ``lang`` or ``xml:lang`` of the html element, else the Content-Language of a meta element, else null.
    """
    root = F.regexp_extract(html, r"(?is)<html\s[^>]*+>", 0)
    metas = F.regexp_extract_all(html, F.lit(r"(?is)<meta\s[^>]*+>"), F.lit(0))
    said = F.filter(metas, lambda m: F.lower(_attribute(m, "http-equiv")) == "content-language")
    value = lambda x: F.when(x != "", x)
    language = F.coalesce(value(_attribute(root, "lang")), value(_attribute(root, "xml:lang")), value(_attribute(F.get(said, F.lit(0)), "content")))
    return main_text(pages, url, html, text).withColumns({declared: language, host: host_of(F.col(url))})


def _short(value: Column) -> Column:
    """A declared language's first part or an address suffix, if it is two or three letters; else one value for all others."""
    first = F.regexp_extract(F.lower(F.coalesce(value, F.lit(""))), r"^\s*([a-z]{2,3})(?:[-_].*)?\s*$", 1)
    return F.when(first == "", F.lit("?")).otherwise(first)


def _softmax(logs: Column) -> Column:
    e = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(F.array(e), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))[0]


def identify(
    docs: DataFrame, text: str = "text", label: str = "lang", declared: str | None = "lang", host: str | None = None, key: str = "doc_id", out: str = "language", model=None
) -> DataFrame:
    """``docs`` with a struct column ``out``: lang, confidence, kept.

    ``host``: a column with a host name, or whatever plays its part. ``model``: what ``fit`` gave, else fitted here.
    """
    names, log = model or fit(docs, label, text, key)
    n = len(names) + 1
    x = unused(docs)
    nil = F.lit(None).cast("string")
    address = F.lower(F.coalesce(F.col(host) if host else nil, F.lit("")))
    read = docs.withColumn(x + "_ll", text_evidence(log)(F.col(text)))
    read = read.withColumn(x + "_p", _softmax(F.col(x + "_ll")))
    # said before the joins, so that they move no text which the caller does not ask for
    read = read.withColumn(x + "_a", F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False)))
    read = read.withColumn(x + "_d", _short(F.col(declared) if declared else nil)).withColumn(x + "_h", address)
    read = read.withColumn(x + "_t", _short(F.regexp_extract(x + "_h", r"\.([^.:]+)(?::\d*)?$", 1))).withColumn(x + "_g", F.regexp_extract(x + "_h", r"([^.]*\.?[^.]*)$", 1))

    # sums of the text's posteriors by declared language, suffix, host: one pass over the texts
    sums = [F.coalesce(F.sum(F.get(x + "_p", F.lit(k))), F.lit(0.0)).alias(f"p{k}") for k in range(n)]
    counts = stored(read.filter(F.size(x + "_p") > 0).groupBy(x + "_d", x + "_t", x + "_g", x + "_h").agg(*sums), "evidence")
    total = lambda *by: counts.groupBy(*by).agg(F.array(*(F.sum(f"p{k}") for k in range(n))).alias("s"))
    whole = total().first()[0]
    whole = np.array([x or 0.0 for x in whole])
    share = F.array(*(F.lit(float(x)) for x in (whole + 1) / (whole.sum() + n)))
    per = F.array(*(F.lit(float(x)) for x in whole))

    def likelihood(by: str) -> DataFrame:  # of a value in each language; at most 18,279 values
        smooth = F.zip_with("s", per, lambda s, w: F.log((s + 0.5) / (w + 1.0)))
        return F.broadcast(total(by).select(by, smooth.alias(x + "l" + by.removeprefix(x))))

    size = lambda s: F.aggregate(s, F.lit(0.0), lambda a, b: a + b)
    smoothed = lambda s, up: F.zip_with(s, up, lambda x, u: (x + STRENGTH * u) / (size(s) + STRENGTH))
    domains = total(x + "_g").select(x + "_g", smoothed(F.col("s"), share).alias("up"))
    hosts = total(x + "_h", x + "_g").join(domains, x + "_g").select(x + "_h", F.col("s").alias(x + "_s"), F.col("up").alias(x + "_up"))

    # written, so that its size is known: a table of few hosts is sent along by Spark, and a large one is joined by
    # a shuffle in which the rows of a frequent host can be split
    hosts = stored(hosts, "hosts")
    joined = read.join(likelihood(x + "_d"), x + "_d", "left").join(likelihood(x + "_t"), x + "_t", "left").join(hosts, x + "_h", "left")
    own = F.zip_with(x + "_s", F.col(x + "_p"), lambda s, p: F.greatest(s - p, F.lit(0.0)))
    prior = F.coalesce(smoothed(own, F.col(x + "_up")), share)
    zero = F.array_repeat(F.lit(0.0), n)
    logs = F.transform(prior, lambda p: F.log(p))
    for part in (x + "l_d", x + "l_t"):
        logs = F.zip_with(logs, F.coalesce(part, zero), lambda a, b: a + b)
    logs = F.zip_with(logs, x + "_ll", lambda a, b: a + b)
    post = F.when(F.size(x + "_ll") > 0, _softmax(logs))
    joined = joined.withColumn(x + "_post", post)
    top = F.array_max(x + "_post")
    lang = F.get(F.array(*(F.lit(x) for x in [*names, NONE])), (F.array_position(x + "_post", top) - 1).cast("int"))
    kept = F.coalesce((top >= 0.5) & (lang != NONE) & F.col(x + "_a"), F.lit(False))
    return joined.select(*(docs[c] for c in docs.columns), F.struct(lang.alias("lang"), top.alias("confidence"), kept.alias("kept")).alias(out))
