"""Snapshots of entries by provider and headword: replaced by key, stamped with a time to live, swept, revalidated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.sources.spool import spool

NEVER = "9999-12-31 23:59:59"


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str] = ("provider_id", "headword")) -> DataFrame:
    """All rows of new, and the rows of existing whose key new does not have. A key's rows are replaced as a set."""
    return existing.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    others = [c for c in rows.columns if c not in keys]
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__x"))
    return out.select(*keys, "__x.*")


def stamp(rows: DataFrame, ttl: DataFrame, key: str, fetched_at: str = "fetched_at") -> DataFrame:
    """With expires_at: fetched_at and the seconds of ttl (key, ttl_s; a row a provider). Without a time to live: never."""
    out = rows.join(ttl.select(key, "ttl_s"), key, "left")
    at = F.col(fetched_at) + F.make_dt_interval(secs=F.col("ttl_s").cast("decimal(18,6)"))
    return out.withColumn("expires_at", F.when(F.col("ttl_s").isNull(), F.lit(NEVER).cast(dict(rows.dtypes)[fetched_at])).otherwise(at)).drop("ttl_s")


def fresh(rows: DataFrame, now: Column, refresh: bool = False) -> DataFrame:
    """The rows that need not be fetched again. refresh: all must, whatever their time to live."""
    return rows.filter(F.lit(False) if refresh else F.col("expires_at") > now)


def to_fetch(wanted: DataFrame, lookups: DataFrame, now: Column, refresh: bool = False, keys: Sequence[str] = ("provider_id", "headword")) -> DataFrame:
    """The keys of wanted that no fresh lookup answers."""
    return wanted.select(*keys).distinct().join(fresh(lookups, now, refresh).select(*keys), list(keys), "left_anti")


def sweep(rows: DataFrame, now: Column) -> DataFrame:
    """Without expired rows; one that expires now is still there."""
    return rows.filter(F.col("expires_at") >= now)


def revalidate(lookups: DataFrame, replies: DataFrame, keys: Sequence[str] = ("provider_id", "headword")) -> DataFrame:
    """lookups whose expiry is moved where the reply (keys, status, new_expires_at) says that nothing changed."""
    kept = replies.filter("status = 304").groupBy(*keys).agg(F.max("new_expires_at").alias("__until"))
    return lookups.join(kept, list(keys), "left").withColumn("expires_at", F.coalesce("__until", "expires_at")).drop("__until")


def write_snapshot(entries: DataFrame, path: str) -> None:
    """One folder a provider; only the folders that entries has are replaced."""
    out = entries.repartition("provider_id", F.pmod(F.xxhash64("headword"), F.lit(64))).sortWithinPartitions("headword", "ord")
    out.write.mode("overwrite").partitionBy("provider_id").option("partitionOverwriteMode", "dynamic").parquet(path)


def merge_into_snapshot(spark: SparkSession, new: DataFrame, path: str) -> None:
    """Replace the keys of new in the snapshot at path. The new state is written elsewhere first, since it reads the old one."""
    new = spool(new)
    touched = [r[0] for r in new.select("provider_id").distinct().collect()]  # providers: a registry's few rows
    old = spark.read.parquet(path).filter(F.col("provider_id").isin(touched)).select(*new.columns)
    write_snapshot(spool(upsert(old, new)), path)


def lookup(spark: SparkSession, path: str, provider: str, headword: str) -> DataFrame:
    """The entries of a key in order; only the provider's folder is read, and in it only row groups that may hold the word."""
    return spark.read.parquet(path).filter((F.col("provider_id") == provider) & (F.col("headword") == headword)).orderBy("ord")
