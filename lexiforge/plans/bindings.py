"""How the driver's tables stand for entries, definitions and the other inputs of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.sources.spool import table


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries: the word is the first one, the provider the language, senses the lines."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.lower(F.regexp_extract("text", "[^ \\t\\n]+", 0)).alias("word"), F.col("lang").alias("provider"), F.col("source").alias("source_name"),
        (100 - F.substring("source", 4, 9).cast("int")).alias("authority"), F.col("doc_id").alias("ord"),
        F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "").alias("senses"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct lower-cased words of all documents (column word)."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("\\p{L}+"), 0)
    return table(spark, sf_dir, "documents").select(F.explode(found).alias("word")).distinct()


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries to be merged."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("headword"), F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.col("o_orderstatus")).alias("part_of_speech"),
        F.nullif(key % 4, F.lit(0)).cast("int").alias("homonym_index"), F.floor(F.col("o_totalprice") / 1000).cast("int").alias("authority"), key.alias("ord"),
        F.when(key % 3 != 0, F.concat(F.lit("g"), (key % 5).cast("string"))).alias("gender"), F.col("o_orderpriority").alias("contributor"),
    )


def nested_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as whole nested entries (the columns of schema.ENTRY): a top sense for each line."""
    e = entries(spark, sf_dir)
    none = F.array().cast("array<string>")
    rel = F.struct(*[none.alias(n) for n in ("synonyms", "antonyms", "diminutives", "augmentatives", "hypernyms")])
    text = F.lit(None).cast("string")

    def node(line: Column, i: Column) -> Column:
        return F.struct(
            i.alias("node_id"), F.lit(None).cast("int").alias("parent_id"), F.lit(0).alias("depth"), (i + 1).alias("number"), line.alias("text"), F.lit("meaning").alias("type"),
            none.alias("register"), text.alias("domain"), text.alias("citation"), F.array("source_name").alias("sources"), rel.alias("relations"),
        )

    said = F.struct(text.alias("ipa"), F.col("word").alias("stress_mark"), text.alias("syllabification"), text.alias("audio_url"), text.alias("audio_mime"), text.alias("audio_attribution"))
    form = F.struct(F.col("word").alias("form"), F.array("provider").alias("tags"), F.when(F.col("doc_id") % 2 == 0, "derived").otherwise("attested").alias("origin"), F.lit("high").alias("confidence"))
    return e.select(
        F.col("provider").alias("provider_id"), F.col("word").alias("headword"), F.col("doc_id").cast("string").alias("id"), F.col("ord").cast("int").alias("ord"), F.col("word").alias("display_headword"),
        F.lit(None).cast("int").alias("homonym_index"), F.lit("unknown").alias("part_of_speech"), text.alias("gender"), F.array(form).alias("inflections"),
        F.lit(None).cast("struct<model_code:string,class_roman:string,cells:array<struct<tags:array<string>,forms:array<string>>>>").alias("paradigm"),
        F.array(said).alias("pronunciations"), F.transform("senses", node).alias("senses"), F.lit(None).cast("struct<text:string,languages:array<string>>").alias("etymology"),
        none.alias("derived"), F.array("source_name").alias("compounds"),
        F.struct(
            F.col("provider").alias("provider_id"), F.col("source_name").alias("provider_name"), F.col("source_name").alias("source_name"), text.alias("work_title"), F.col("authority").alias("authority"),
            F.lit("").alias("url"), F.lit("").alias("license"), F.lit("").alias("attribution"), F.lit(False).alias("cache_hit"),
        ).alias("source"),
    )


#: The same bindings in SQL.
ENTRIES_SQL = r"""e AS (SELECT doc_id, lower(regexp_extract(text, '[^ \t\n]+', 0)) AS word, lang AS provider, source AS source_name,
  100 - CAST(substr(source, 4) AS INTEGER) AS authority, doc_id AS ord, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS senses FROM documents)"""
TOKENS_SQL = r"w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents)"
LINKED_SQL = """o AS (SELECT 'c' || o_custkey AS lemma, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS pos, CAST(nullif(o_orderkey % 4, 0) AS INTEGER) AS own,
  CAST(floor(o_totalprice / 1000) AS INTEGER) AS authority, o_orderkey AS ord, CASE WHEN o_orderkey % 3 <> 0 THEN 'g' || (o_orderkey % 5) END AS gender, o_orderpriority AS contributor FROM orders),
g AS (SELECT *, CAST(coalesce(own, min(own) OVER (PARTITION BY lemma, pos), 1) AS INTEGER) AS homonym FROM o)"""


def sense_key_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(strip_accents({x})), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
