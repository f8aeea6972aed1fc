"""The numbered queries: each applies one operator to its whole table, with its production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, knn, langid, linededup, lm, mix, near, packing, pii, repair, simhash, variants, warc
from .common import documents, shared_dir

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def crc_mod(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned_from = F.coalesce(crc_mod(7) != 2, F.lit(True))
    return lm.score_all(lm.learn(documents(spark, sf_dir), learned_from))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), TOKENIZER, 1024, 0)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(crc_mod(4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("row.doc_id", "row.held_out", "lang_pred", "score", "rejected")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    trap = "\\### Assistant: </turn> ok"
    fixed = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.segments(rows.unionByName(fixed)))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.jaccard_join(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = mix.mix_sizes(documents(spark, sf_dir))
    return x.withColumn("target", F.round("target", 6))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_all(documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many lines it has, which go (numbers from 0), and a digest of what is left."""
    x = linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    return x.select("row.doc_id", F.coalesce(F.size(F.split("row.text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"),
                    F.array_join(gone.cast("array<string>"), ",").alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return knn.nearest(vectors, F.col("vec_id") % 100 == 0, 10)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair.digest(repair.repair(repair.damage(rows)))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, left in the shared folder, and what reading them back gives; each payload is digested again."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(warc.revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    x = warc.read(spark, path, payload="false", verify="true").where(F.col("record_type").isin("response", "revisit"))
    return x.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.word_counts(documents(spark, sf_dir))).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_packing, op3_language_id, op4_chat_formatting, op5_ngram_jaccard_join, op6_mixing, op7_fingerprints, op8_line_dedup, op9_personal_data, op10_nearest_neighbours, op11_conversation_repair, op12_warc, op13_spelling_variants)}
ORACLE_SQL: dict[str, str] = {
    "op6_mixing": r"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(concat_ws('|', '7', CAST(doc_id AS VARCHAR), text)) AS k FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS n FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE n % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS w, 2e0 * source_size AS cap, 1.5e0 * sum(source_size) OVER () AS budget FROM s),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, w * max(CASE WHEN level * w <= cap THEN level END) OVER ()) AS target FROM l),
c AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY k) AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT source, size, k, cum + p * source_size AS place, (cum + p * source_size) / target AS finish FROM c, (VALUES (0), (1)) v(p) WHERE size > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, source, place, k ROWS UNBOUNDED PRECEDING) AS so_far FROM q),
r AS (SELECT source, max(place) AS reach FROM o WHERE so_far <= (SELECT sum(target) FROM t) * (1 + 1e-12) + 1e-6 GROUP BY source)
SELECT doc_id, size, c.source, source_size, round(target, 6) AS target,
  CAST(size * (CASE WHEN cum <= coalesce(reach, 0) THEN 1 ELSE 0 END + CASE WHEN cum + source_size <= coalesce(reach, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c LEFT JOIN r ON c.source IS NOT DISTINCT FROM r.source""",
}
