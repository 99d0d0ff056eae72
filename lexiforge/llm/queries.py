"""The queries of this subpackage and the SQL that gives their rows, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import crc_mod, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiforge.llm.sharding import shard_rows

    return shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiforge.llm.suffix_dedup import PASSAGE, remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), passage=PASSAGE, words=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiforge.llm.quality import learn, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = learn(docs, table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held))
    out = score(docs.withColumn("held_out", held), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiforge.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiforge.llm.language import learn, predict

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = learn(docs.filter(~held))
    out = predict(docs.select("doc_id", "text", held.alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lexiforge.llm.packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiforge.llm.fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiforge.llm.line_dedup import drop_common_lines

    out = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexiforge.llm.simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lexiforge.llm.pieces import encode

    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


OP9_SQL = r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM t),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, c.owner IS NOT NULL AND c.owner <> k.doc_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_quality": op3_quality,
    "op4_neighbours": op4_neighbours,
    "op5_language": op5_language,
    "op6_packing": op6_packing,
    "op7_fingerprint": op7_fingerprint,
    "op8_simhash": op8_simhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_sentencepiece": op10_sentencepiece,
}
SQL = {"op9_line_dedup": OP9_SQL}
