"""Full-text search: folded tokens, phrases whose last word is a prefix, BM25 scores.

The index is two tables: postings (term, doc, col, pos) and documents (doc, n_tokens). A query looks up its words in
postings, which are written sorted by term, so files that hold none of them are skipped.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.text import query_terms, tokens
from lexiforge.sources.spool import spool

K1, B, FLOOR = 1.2, 0.75, 1e-6


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    documents: DataFrame

    def write(self, path: str) -> None:
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc", "col", "pos").write.mode("overwrite").parquet(f"{path}/postings")
        self.documents.write.mode("overwrite").parquet(f"{path}/documents")

    @staticmethod
    def read(spark, path: str) -> Index:
        return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/documents"))


def build_index(docs: DataFrame, columns: Sequence[str], doc: str) -> Index:
    """Tokens of the columns of docs; doc names the column of unique ids. Texts are split once, into a spooled table."""
    split = spool(docs.select(F.col(doc).alias("doc"), *[tokens(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)]))
    each = [split.select("doc", F.lit(i).alias("col"), F.posexplode(f"c{i}").alias("pos", "term")) for i in range(len(columns))]
    many = reduce(lambda a, b: a + b, [F.size(f"c{i}") for i in range(len(columns))])
    return Index(reduce(DataFrame.unionByName, each).select("term", "doc", "col", "pos"), split.select("doc", many.cast("long").alias("n_tokens")))


def phrase_hits(postings: DataFrame, words: Sequence[str]) -> DataFrame:
    """doc and hits of a phrase; its last word is a prefix."""
    found = None
    for i, word in enumerate(words):
        last = i == len(words) - 1
        rows = postings.filter(F.col("term").startswith(word) if last else F.col("term") == word).select("doc", "col", (F.col("pos") - i).alias("start"))
        found = rows if found is None else found.join(rows, ["doc", "col", "start"], "left_semi")
    return found.groupBy("doc").agg(F.count("*").alias("hits"))


def search(index: Index, text: str) -> DataFrame:
    """doc and score of the documents that hold all phrases of the text; smaller is better. Nothing to look for: no rows.

    Hits of all phrases are gathered once; the driver gets two numbers of the index and one for each phrase.
    """
    phrases = query_terms(text)
    if not phrases:
        return index.documents.select("doc", F.lit(0.0).alias("score")).filter(F.lit(False))
    each = [phrase_hits(index.postings, words).withColumn("phrase", F.lit(i)) for i, words in enumerate(phrases)]
    hits = spool(reduce(DataFrame.unionByName, each))
    seen = {r["phrase"]: r["count"] for r in hits.groupBy("phrase").count().collect()}
    n, mean = index.documents.agg(F.count("*"), F.avg("n_tokens")).first()
    of = [F.sum(F.when(F.col("phrase") == i, F.col("hits"))).alias(f"f{i}") for i in range(len(phrases))]
    rows = hits.groupBy("doc").agg(F.count("*").alias("k"), *of).filter(F.col("k") == len(phrases)).join(index.documents, "doc")
    length = 1 - B + B * F.col("n_tokens") / F.lit(float(mean or 1))

    def weight(i: int) -> float:
        raw = math.log((n - seen.get(i, 0) + 0.5) / (seen.get(i, 0) + 0.5))
        return raw if raw > 0 else FLOOR

    terms = [weight(i) * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + K1 * length) for i in range(len(phrases))]
    return rows.select("doc", (-reduce(lambda a, b: a + b, terms)).alias("score"))


def page(found: DataFrame, docs: DataFrame, doc: str, preview: str, limit: int = 20, offset: int = 0, chars: int = 200) -> DataFrame:
    """A page of hits with the first characters of a text, best first; ties by id."""
    if not (1 <= limit <= 100 and offset >= 0):
        raise ValueError("limit is 1 to 100, offset not negative")
    top = found.orderBy("score", "doc").offset(offset).limit(limit)
    return top.join(docs.select(F.col(doc).alias("doc"), F.substring(preview, 1, chars).alias("preview")), "doc").orderBy("score", "doc")
