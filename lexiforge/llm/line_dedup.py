"""Line deduplication in DataFrame operations only.

Lines are exploded as hashes with their positions, the documents that hold each hash are counted, hashes over the
threshold are joined back to positions, and each document is put together again from the positions that stay. Texts
cross the network once, in the last join; everything before it moves hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import BLANKS, ascii_lower, fresh


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def drop_common_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with two more columns n_lines and n_dropped, and text without common lines.

    A key of at least min_chars code points found in at least min_docs documents (distinct doc_id) loses its lines
    everywhere but in the largest doc_id that holds it. Null and empty texts are one empty line and come back as the
    empty text. Repeated rows count once and are all rewritten alike; rows with a null doc_id keep their lines and
    count for nobody. A text of very many lines costs in proportion to them; it must fit into a task. An empty table gives
    no rows. Further columns pass through, columns with the new names are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    row_at, drop_at = fresh(docs.columns, "row", "drop")
    text = F.coalesce(F.col("text"), F.lit(""))
    # a row's own key: its id and its text, so that rows which repeat an id are told apart
    row = F.struct(F.col("doc_id").alias("d"), F.xxhash64(text).alias("h"))
    # the text is hashed and split in a select of its own, below the explode, or it would be hashed again for each line
    lines = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64(text).alias("text_hash"), F.split(text, "\n", -1).alias("lines"))
    # explode before the key is made: the generator's rows run in generated code, a lambda would not
    lines = lines.select("doc_id", "text_hash", F.posexplode("lines").alias("pos", "line"))
    lines = lines.filter(F.length("line") >= min_chars)  # cheap first cut: a key is no longer than its line
    lines = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    lines = lines.filter(F.length("key") >= min_chars)
    lines = lines.select(
        "doc_id", "text_hash", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2")
    )
    # one row for each key and document first: a line repeated in a document counts once
    held = lines.select("k1", "k2", "doc_id").distinct()
    common = (
        held.groupBy("k1", "k2")
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("owner"))
        .filter(F.col("n") >= min_docs)
        .select(F.struct("k1", "k2").alias("k"), "owner")
    )
    # a key of another shape than the aggregate's, so that both sides are dealt anew and Spark can split a hot key's rows
    gone = (
        lines.select("doc_id", "text_hash", "pos", F.struct("k1", "k2").alias("k")).join(common, "k")
        .filter(F.col("doc_id") != F.col("owner"))
        .groupBy(F.struct(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).alias(row_at))
        .agg(F.collect_set("pos").alias(drop_at))
    )
    out = docs.withColumn(row_at, row).join(gone, row_at, "left").drop(row_at)
    split = F.split(text, "\n", -1)
    # the positions that stay, by a hash set of those that go; the array of one binds the lines, so that they are split once
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop_at)
    kept = F.get(F.transform(F.array(split), lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.get(lines, i)), "\n")), F.lit(0))
    return out.withColumns(
        {
            "n_lines": F.size(split).cast("long"),
            "n_dropped": F.coalesce(F.size(drop_at).cast("long"), F.lit(0).cast("long")),
            "text": F.when(F.col(drop_at).isNull(), text).otherwise(kept),
        }
    ).drop(drop_at)
