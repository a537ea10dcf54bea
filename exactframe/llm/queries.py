"""The queries of this subpackage and what SQL says about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .scoring import score_documents

    return score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    q = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), out="q")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return q.select("doc_id", *(F.col(f"q.{c}").alias(c) for c in names))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import main_text

    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import Rule, filter_urls

    rules = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))
    judged = filter_urls(table(spark, sf_dir, "pages"), rules, out="f")
    return judged.select("page_id", "f.host", "f.path", "f.rule", "f.verdict")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    done = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), host="source", out="l")
    return done.select("doc_id", F.col("lang").alias("declared"), "source", F.col("l.lang").alias("lang"), F.col("l.confidence").alias("confidence"), F.col("l.kept").alias("kept"))


def op4_langid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import stored
    from .langid import fit, identify, page_evidence

    model = fit(table(spark, sf_dir, "documents"), "lang", "text", "doc_id")
    pages = stored(page_evidence(table(spark, sf_dir, "pages")).select("page_id", "url", "declared", "host", "text"), "pages")
    done = identify(pages, declared="declared", host="host", key="page_id", out="l", model=model)
    return done.select("page_id", "url", "declared", "host", F.col("l.lang").alias("lang"), F.col("l.confidence").alias("confidence"), F.col("l.kept").alias("kept"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources, taken_words

    got = taken_words(mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    return got.select("doc_id", "size", "source_size", "target", "taken")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_pack_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as training examples, none cut that fits: only the assistant's texts bear loss."""
    import public_tokenizers

    from .chat import format_chat
    from .common import stored
    from .packing import Limits, pack_documents

    limits = Limits(tokens=2048, segments=16, loss=1024)
    chats = stored(format_chat(table(spark, sf_dir, "conversations")).select("conv_id", "segments"), "chats")
    pieces = pack_documents(chats, public_tokenizers.path("word_bpe_49k.json"), limits=limits, doc_id="conv_id", parts="segments", cut=False)
    return pieces.select(F.col("doc_id").alias("conv_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chat, read_loss, read_turns

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said)).toDF(*rows.columns)
    done = format_chat(rows.unionByName(extra))
    joined = lambda turns: F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = done.select("conv_id", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined(F.col("turns")), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


QUERIES = {"op1_minhash": op1_minhash, "op2_html": op2_html, "op3_urls": op3_urls, "op4_langid": op4_langid, "op4_langid_pages": op4_langid_pages, "op5_vectors": op5_vectors, "op6_mix": op6_mix, "op7_pack": op7_pack, "op7_pack_chats": op7_pack_chats, "op8_chat": op8_chat, "op9_lm": op9_lm, "op10_quality": op10_quality}
def _quality_sql() -> str:
    from .quality import BOILERPLATE, CAPITALS, ENDED, MARK, NAVIGATION, SYMBOL

    gone = lambda what: f"(length(low) - length(regexp_replace(low, '{what}', '', 'g')))"
    phrases = " OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE)
    nav = ", ".join(f"'{n}'" for n in NAVIGATION)
    of = lambda kinds: f"length(regexp_replace(line, '[^{kinds}]', '', 'g'))"
    split = lambda x: f"list_filter(regexp_split_to_array({x}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {split("text")} AS w FROM d),
i AS (SELECT doc_id, unnest(generate_series(1, len(w) - 7)) AS i, w FROM w WHERE len(w) >= 8),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS n FROM i),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (SELECT unnest(generate_series(0, 7)) AS k) WHERE n > 1 GROUP BY doc_id),
p AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d),
z AS (SELECT doc_id, line, k, lower(line) AS low, {split("line")} AS w FROM (SELECT doc_id, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS k FROM p)),
y AS (SELECT *, length(line) <= 200 AND len(w) <= 3 AND regexp_matches(line, '\\p{{L}}') AND NOT regexp_matches(line, '{ENDED}') AS few FROM z),
l AS (SELECT * EXCLUDE few, few AND ((lag(few, 1, false) OVER o AND (lag(few, 2, false) OVER o OR lead(few, 1, false) OVER o)) OR (lead(few, 1, false) OVER o AND lead(few, 2, false) OVER o)) AS run
FROM y WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
f AS (SELECT *, len(w) AS few, {gone(SYMBOL)} AS symbols, {gone(MARK)} AS marks, length(array_to_string(w, '')) AS chars,
len(list_filter(generate_series(1, len(w) - 1), lambda k: w[k] = w[k + 1])) AS same FROM l WHERE len(w) > 0),
b AS (SELECT *, run OR (regexp_matches(line, '{CAPITALS}') AND few >= 4 AND {of("\\p{Lu}")} * 100 > {of("\\p{Lu}\\p{Ll}")} * 60) OR NOT regexp_matches(low, '\\p{{L}}') OR (length(low) <= 60 AND regexp_replace(low, '^[^\\p{{L}}]+|[^\\p{{L}}]+$', '', 'g') IN ({nav}))
OR (symbols > 2 AND symbols >= few) OR (marks >= 2 AND few <= (marks + 1) * 4) OR (few <= 25 AND ({phrases})) OR same * 100 > few * 30 AS bad FROM f),
k AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, sum(CASE WHEN bad THEN 0 ELSE chars END) AS left_chars FROM b GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '{SYMBOL}', '', 'g')) AS n_symbols,
coalesce(dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(left_chars, 0) AS left_chars FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND left_chars * 100 >= word_chars * 50 AS kept FROM m"""


_REACH = """reach AS (SELECT a AS id, b AS r FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a),
least AS (SELECT id, min(r) AS r FROM reach GROUP BY id)"""

SQL: dict[str, str] = {
    "op1_minhash": f"""WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END))) AS i FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM i),
n AS (SELECT w.doc_id, count(s.s) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
{_REACH}
SELECT n.doc_id, n AS n_shingles, least(n.doc_id, coalesce(r, n.doc_id)) AS component_id, n.doc_id <= coalesce(r, n.doc_id) AS kept FROM n LEFT JOIN least ON id = n.doc_id""",
    # without redirects and canonical links, of which the tables have none, what no rule decides is allowed
    "op3_urls": """WITH h AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/' WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/' WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/' WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
    "op5_vectors": f"""WITH RECURSIVE
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_inner_product(x.e, y.e) >= 0.9 * sqrt(list_inner_product(x.e, x.e)) * sqrt(list_inner_product(y.e, y.e))),
{_REACH}, n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(r, vec_id)) AS component_id, vec_id <= coalesce(r, vec_id) AS kept FROM v LEFT JOIN least ON id = vec_id LEFT JOIN n ON a = vec_id""",
    "op10_quality": _quality_sql(),
    "op8_chat": """WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, replace(text, '<|', '<||') AS t, replace(replace(role, '<|', '<||'), chr(10), '<|n|>') AS r, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
CAST(sum(length(t) + CASE WHEN before = role THEN length('<|im_sep|>') ELSE length('<|im_start|>') + length(r) + 1 + length('<|im_end|>') + 1 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
}
