"""The registered queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gearsight.llm import (bytebpe, chat, exact_dedup, mixing, near_dedup, packing, pieces, repair, spelling,
                           substring_dedup, topk, toxicity, url_filter)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest others, by integer inner product, of every vector whose id is divisible by 50."""
    return topk.search(table(spark, sf_dir, "embeddings"))


ORACLES["op1_exact_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
 FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[]))
  AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5"""


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id that stays of its equal texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op2_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
 doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""


@query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, rendered and read back."""
    trap = spark.sql("SELECT -7L AS conv_id, 0 AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text "
                     "UNION ALL SELECT -7L, 1, 'assistant', '</s>[INST] ok [/INST]'")
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("int"), "role", "text").unionByName(trap)
    out = chat.format_chats(chat.messages_as_events(rows))
    turns = chat.read_back(F.col("formatted"))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return out.withColumn("turns", turns).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans"))).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


ORACLES["op3_chat_format"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, length('<s>[INST][/INST]</s>') + length(role) + length(text)
  + len(regexp_extract_all(role, '<\\*/?s>|\[\\*/?INST\]')) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]'))
  AS chars, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  string_agg(loss, '' ORDER BY turn, role, text) AS loss FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
 CAST(chars AS BIGINT) AS formatted_chars FROM g"""

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow")]


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under the four rules, else under its host's reputation.

    A page's outcome is what ``labels`` says of its number: bad when of low quality or toxic.
    """
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when(
        (F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull(), 0).alias("bad"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, labels, RULES).select("page_id", "host", "path", "rule", "verdict")


def _shrink(name: str, source: str, prior: str, mean: str) -> str:
    """SQL of one level: overdispersion over ``source``, then the shrunk mean."""
    return f"""
{name}_rho AS (SELECT round(least(0.5e0, greatest(0.0001e0, coalesce(sum(pow(bad - n * {prior}, 2e0)
   - n * {prior} * (1 - {prior})) / nullif(sum(n * (n - 1) * {prior} * (1 - {prior})), 0), 0.0001e0))), 6) AS rho
  FROM {source}),
{name} AS (SELECT s.*, (SELECT 1e0 / rho - 1e0 FROM {name}_rho) AS worth,
  (bad + (SELECT 1e0 / rho - 1e0 FROM {name}_rho) * {prior}) / (n + (SELECT 1e0 / rho - 1e0 FROM {name}_rho)) AS {mean}
  FROM {source} s),"""


ORACLES["op4_url_filter"] = r"""
WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
 FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 1),
   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 2) AS path FROM u),
l AS (SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL THEN 0 END AS bad FROM labels),
h AS (SELECT host, regexp_extract(host, '([^.]*\.)?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix,
  count(l.bad) AS n, coalesce(sum(l.bad), 0) AS bad
  FROM p LEFT JOIN l ON p.page_id = l.doc_id AND l.bad IS NOT NULL GROUP BY host),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d0 GROUP BY ALL),
s1 AS (SELECT *, coalesce((SELECT sum(bad) / CAST(nullif(sum(n), 0) AS DOUBLE) FROM s0), 0e0) AS all_mean FROM s0),
""" + _shrink("s2", "s1", "all_mean", "suffix_mean") + """
d1 AS (SELECT d0.*, suffix_mean FROM d0 JOIN s2 USING (suffix)),
""" + _shrink("d2", "d1", "suffix_mean", "domain_mean") + """
h1 AS (SELECT h.*, domain_mean FROM h JOIN d2 USING (domain)),
""" + _shrink("h2", "h1", "domain_mean", "mean") + """
r AS (SELECT host, mean - 1.64e0 * sqrt(mean * (1 - mean) / (n + worth + 1)) AS bad_low FROM h2),
f AS (SELECT p.*, bad_low, CASE
  WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule FROM p JOIN r USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
 WHEN rule IS NOT NULL THEN 'allow' WHEN bad_low > 0.3e0 THEN 'block' ELSE 'allow' END AS verdict FROM f"""


@query
def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into sequences of binary length."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "bucket")


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows of 20 words that also start earlier."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.substring_dedup(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside fold 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held_out = (toxicity.fold(F.col("doc_id")) == 0).alias("held_out")
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out, "score", "predicted")


@query
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.classes(docs).select("doc_id", "class_id", "class_size", "kept")


@query
def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the hash of the text that they decode to."""
    docs, model = table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")
    rows = pieces.decode(pieces.encode(docs, model), model)
    return rows.select("doc_id", "n_ids", "ids", F.sha2("decoded", 256).alias("decoded_sha256"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


@query
def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under the mixed model, beside a unigram one."""
    return mixing.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the multilingual byte-level vocabulary, and the bytes that they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bytebpe.encode(docs, ranks, public_tokenizers.PATTERN, round_trip=True)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def drop_letter(doc: bytes, word: bytes) -> bytes:
    """The word without one letter, in one of 199 pairs of document and word."""
    h = zlib.crc32(word, zlib.crc32(doc + b":"))
    if h % 199:
        return word
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1:]).encode()


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some of them misspelt on purpose, under their frequent forms."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(spelling.count_words(docs, alter=drop_letter)).select(
        "word", "form", "root", "n", "n_near", "form_n")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with dropped, emptied, cut and repeated rows and wrong roles, by a checksum of conversation and turn."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    what, role, text = F.crc32(key.cast("binary")) % 20, *(F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return rows.select("conv_id", "turn", F.when(what == 4, "user").otherwise(role).alias("role"), F.when(what == 1, "").when(
        what == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), what.alias("what")).filter(
        "what <> 0").withColumn("copy", F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(
            F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of every conversation after damage; lost ones have none."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair.repair(damaged(rows), "report").withColumnRenamed("conv_id", "found_id").withColumn("there", F.lit(True))
    every = rows.select("conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts),
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
