"""The registered queries of this folder (``QUERIES``) and their DuckDB twins (``SQL``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, decontam, embed_dedup, licenses, mixing, packing, secrets, sharding, simhash, substrings, toxicity, trie
from .common import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn
    return deco


_RE_CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|role\|>|<\|text\|>|<\|end\|>"


def _sql_escape(x: str) -> str:
    return (f"regexp_replace(regexp_replace({x}, '(\\\\*)({_RE_CONTROL})', '\\1\\1\\\\\\2', 'g'), '(\\\\+)$', '\\1\\1')")


@_register("op1_chat_formatting", f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length({_sql_escape('text')}) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
         ELSE 23 + length({_sql_escape('role')}) END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""")
def op1_chat_formatting(spark, sf_dir):
    """All conversations and conversation -1, formatted; digests read back from the formatted text."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.chat_digests(chat.format_chats(c.unionByName(probe)))


@_register("op9_secret_scans")
def op9_secret_scans(spark, sf_dir):
    """Secrets in every whole text; counts and digests from the operator's spans."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    said = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in secrets.KINDS[:3]),
                        F.sha2(said(F.filter("spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"),
                        said(F.col("spans")).alias("spans"), count("guess"))


def _held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@_register("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    """A classifier learned from rows that aren't held out scores every whole text."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), keep=~_held_out())
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
                         (F.col("score") >= F.col("threshold")).cast("int").alias("predicted_by_language"))


def tokenizer_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@_register("op8_packing")
def op8_packing(spark, sf_dir):
    """All documents tokenised, concatenated and cut into windows of 2048 ids."""
    return packing.with_crc(packing.pack(table(spark, sf_dir, "documents"), tokenizer_file()))


@_register("op2_benchmark_decontamination")
def op2_benchmark_decontamination(spark, sf_dir):
    """Benchmark items met in the documents, the best stretch of each document and item."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_register("op4_simhash")
def op4_simhash(spark, sf_dir):
    """SimHash components of all documents: four-word shingles, at most four bits apart."""
    return simhash.near_groups(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


@_register("op7_embedding_dedup")
def op7_embedding_dedup(spark, sf_dir):
    """Links and components of all vectors of equal label at cosine 0.93 or more."""
    return embed_dedup.link_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


@_register("op3_substring_dedup", """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i) WHERE len(w) >= 13),
f AS (SELECT g, min(doc_id) AS first FROM p GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM p JOIN f USING (g), range(13) t(k) WHERE f.first < p.doc_id),
kept AS (SELECT d.doc_id, d.w, coalesce(list(gone.i) FILTER (gone.i IS NOT NULL), []) AS x FROM d LEFT JOIN gone USING (doc_id) GROUP BY ALL)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(x) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(list_transform(w, lambda v, i: CASE WHEN list_contains(x, i) THEN NULL ELSE v END), lambda v: v IS NOT NULL), ' ')) AS kept_sha256
FROM kept""")
def op3_substring_dedup(spark, sf_dir):
    """Words of all documents outside 13-word windows that a smaller doc_id's document has too."""
    kept = substrings.dedup_substrings(table(spark, sf_dir, "documents"), window=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_register("op6_license_scan", licenses.license_sql())
def op6_license_scan(spark, sf_dir):
    """License notices in all documents, the best window of each document and template."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


#: Bytes of text that a shard may hold.
SHARD_BYTES = 16 * 1024 * 1024


@_register("op10_sharding", sharding.shard_sql(SHARD_BYTES))
def op10_sharding(spark, sf_dir):
    """All documents, each with its shard of at most ``SHARD_BYTES`` of text."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


#: Turns of a conversation's rebuilt form; crc32 of its decimal id by its bits (polynomial 0xEDB88320).
_SQL_CRC = """list_reduce([4294967295] || list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(conv_id AS VARCHAR), i, 1))::BIGINT),
  lambda a, ch: list_reduce([xor(a, ch)] || range(8), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))"""


@_register("op11_conversation_trie", f"""
WITH RECURSIVE t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
w AS (SELECT conv_id, list({{'k': sha256(length(role) || ':' || role || text), 'b': octet_length(encode(text))}} ORDER BY pos) AS w FROM t GROUP BY conv_id),
h AS (SELECT conv_id, w, xor({_SQL_CRC}, 4294967295) % 9 AS h FROM w),
r AS (SELECT h.conv_id, list_concat(list_slice(coalesce(o.w, []), 1, h.h), list_slice(h.w, h.h + 1, len(h.w))) AS w FROM h LEFT JOIN w o ON o.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, d, len(w) = d AS is_end, list_transform(list_slice(w, 1, d), lambda x: x.k) AS k, coalesce(w[d].b, 0) AS b FROM r, LATERAL (SELECT unnest(range(0, len(w) + 1)) AS d)),
n AS (SELECT k, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256 FROM p GROUP BY k, d),
c AS (SELECT list_slice(k, 1, depth - 1) AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (k)),
u AS (SELECT list_slice(k, 1, a) AS k, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum((n_convs - 1) * b) AS saved_tokens
      FROM f, LATERAL (SELECT unnest(range(0, depth + 1)) AS a) GROUP BY 1)
SELECT f.conv_id, f.depth, g.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN u USING (k) LEFT JOIN n g ON f.depth > 0 AND g.k = list_slice(f.k, 1, f.depth - 1)""")
def op11_conversation_trie(spark, sf_dir):
    """The prefix trie of all conversations, each rebuilt with the first turns of another."""
    convs = table(spark, sf_dir, "conversations")
    ids = convs.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    turns, ids = trie.splice(trie.number_turns(convs, texts=False), ids)
    return trie.trie_of(turns, ids).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@_register("op12_mixing", mixing.mix_sql())
def op12_mixing(spark, sf_dir):
    """All documents and the words that a mix of 150 % of all words, weighed 5, 2, 1 by source, takes of each."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_register("op13_centroid_clustering", centroids.cluster_sql())
def op13_centroid_clustering(spark, sf_dir):
    """All vectors of 64 components as integers, clustered in ten rounds around eight centroids."""
    rows, centers = centroids.cluster(table(spark, sf_dir, "embeddings"))
    if not centers:
        return rows.withColumn("centroid_sha256", F.lit(None).cast("string"))
    named = F.array(*(F.lit(centroids.digest(c)) for c in centers))
    return rows.withColumn("centroid_sha256", F.element_at(named, F.col("cluster") + 1))
