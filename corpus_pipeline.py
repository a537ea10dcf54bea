"""From raw documents to packed sequences: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exactframe.llm import common
from exactframe.llm.langid import identify
from exactframe.llm.minhash import near_duplicates
from exactframe.llm.mixing import mix_sources, mixed_texts
from exactframe.llm.packing import pack_documents
from exactframe.llm.quality import passed

BATCH, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
DOC = ("doc_id", "text", "lang", "source", "n_chars")


def modest(spark: SparkSession) -> None:
    """Texts go to Python 2,000 rows or 2 MB at a time, where the session does not say otherwise.

    Workers of several stages live on beside the JVM of one executor, and Spark's 10,000 rows of whole texts are held there
    several times over: in the JVM's buffers, in Arrow and as Python values.
    """
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, 2000)
    if spark.conf.get(BYTES) == "67108864b":
        spark.conf.set(BYTES, 2 << 20)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others keep the lines that passed.

    A null or empty text has too few words and goes. Ids, languages and sources are not looked at, so nulls in them stay;
    each of repeated rows, and each row of a shared id, is judged by itself. Columns beyond those of ``documents`` go,
    here and in every stage; an empty table gives an empty table, here and in every stage.
    """
    q = passed(docs, out="_q")
    return q.withColumn("text", F.col("_q.clean_text")).withColumn("n_chars", F.length("text").cast("long")).select(*DOC)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that is known go; the others carry the language found.

    The trigram model is fitted on the rows that declare a language; without any, no language is known and all go. A null
    language or source is a value like others; a null or empty text goes; repeated rows get the same language.
    """
    modest(spark)
    done = identify(docs, host="source", out="_l").filter("_l.kept")
    return done.withColumn("lang", F.col("_l.lang")).select(*DOC)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least id.

    Rows that share an id are one document: of those that differ the least stays, by text, then by the other columns (null
    first). Rows without an id belong to no group and all stay, as do documents with a null or empty text.
    """
    modest(spark)
    kept = near_duplicates(docs, percent=80).filter("kept").select("doc_id").distinct()
    row = F.struct("text", "lang", "source", "n_chars")
    told = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("row")).select("doc_id", "row.*").select(*DOC)
    return told.unionByName(docs.filter("doc_id is null").select(*DOC))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass over a source that takes words of a document.

    A document that is not drawn has no row, one drawn several times has several, with its id; documents without words are
    never drawn. A null source is a source of its own; null ids and repeated rows are rows like others.
    """
    mixed = mixed_texts(mix_sources(docs), docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*DOC)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row for each piece of a document.

    A null or empty text is the end mark alone; a null id stays null; each of repeated rows is packed by itself.
    """
    import public_tokenizers

    modest(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("MinHash near-dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: SQL has no tokenizer, no trigram model and no components; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again.

    What a stage has written goes when the next one's result is written, and so do the tables that its operator wrote for
    itself; what the last stage reads stays for the caller.
    """
    docs, before = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with common.scratch():
            docs = common.stored(stage(spark, docs, sf_dir), "stage")
        if before is not None:
            common.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
