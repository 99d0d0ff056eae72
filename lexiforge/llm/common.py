"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.sources.spool import free, partitions, spool, table, written  # noqa: F401  for the operators

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of the contracts: blank and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


#: Bytes of a batch of rows on its way to a Python worker or back; Spark's own bound is 64 MB, in the JVM and in the worker at once.
BATCH = 4 << 20


def small_batches(spark: SparkSession, most: int = BATCH) -> None:
    """Rows go to Python workers in batches of about so many bytes from now on, if the session does not ask for smaller ones."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = spark.conf.get(name, None)
    if not had or spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(had) > most:
        spark.conf.set(name, str(most))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores in front until no column is called so (Spark does not tell case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod: how the contracts deal folds."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def least_by_hash(rows: DataFrame, group: str, hashed: Column, k: int) -> DataFrame:
    """A bounded draw: the rows of about the 4 k least hashes of each group, or all rows of a smaller group.

    hashed is an even 64-bit hash. Groups are few (labels): their counts of distinct hashes are broadcast. Each task drops
    what lies above its group's threshold, so what is left does not grow with the table, but for rows of equal hash.
    """
    (n_at,) = fresh(rows.columns, "n")
    counts = rows.groupBy(group).agg(F.approx_count_distinct(hashed).alias(n_at))
    part = hashed / F.lit(2.0**64) + 0.5
    return rows.join(F.broadcast(counts), group).filter(part * F.col(n_at) <= 4 * k).drop(n_at)


def salt_of(column: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
