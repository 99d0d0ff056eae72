"""Sharding by best-fit-decreasing bin packing.

Groups (rows with equal texts) are indivisible. Each partition packs its small groups into parcels of a fixed
capacity: sorted by size, each group enters the parcel with the least room that still holds it, found in a
balanced tree of remaining capacities. Groups larger than a parcel are parcels of their own. The parcels, whose number is
bounded whatever the input, are then packed into the shards the same way. Only sizes, counts and hashes move.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import partitions, salt_of, spool

#: Salted pieces of a group at least; with more shuffle partitions as many as those.
SALTS = 32


class RoomTree:
    """Remaining capacities in order, as a B+ tree of two levels whose leaves are split when they are full."""

    def __init__(self, leaf: int = 256) -> None:
        self.leaf, self.leaves, self.tops = leaf, [], []

    def add(self, room: int, place: int) -> None:
        item = (room, place)
        if not self.leaves:
            self.leaves, self.tops = [[item]], [item]
            return
        k = min(bisect_left(self.tops, item), len(self.leaves) - 1)
        leaf = self.leaves[k]
        insort(leaf, item)
        self.tops[k] = leaf[-1]
        if len(leaf) > self.leaf:
            half = len(leaf) // 2
            self.leaves[k : k + 1] = [leaf[:half], leaf[half:]]
            self.tops[k : k + 1] = [leaf[half - 1], leaf[-1]]

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the place with the least room of at least size; the first made wins a tie."""
        k = bisect_left(self.tops, (size, -1))
        if k == len(self.leaves):
            return None
        leaf = self.leaves[k]
        item = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.tops[k] = leaf[-1]
        else:
            del self.leaves[k], self.tops[k]
        return item


def best_fit_decreasing(sizes: Iterable[int], capacity: int, bins: int | None = None) -> list[int] | None:
    """The bin of each item; larger items first. An item above the capacity gets a bin of its own.

    bins: the most that may be opened; None comes back if they do not do.
    """
    sizes = list(sizes)
    rooms, opened, out = RoomTree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        room, place = rooms.take(sizes[i]) or (max(capacity, sizes[i]), opened)
        if place == opened:
            opened += 1
            if bins is not None and opened > bins:
                return None
        out[i] = place
        rooms.add(room - sizes[i], place)
    return out


def pack_into(sizes: list[int], bins: int) -> list[int]:
    """Bins of near equal sums: best-fit decreasing at the least capacity for which so many bins do."""
    if not sizes:
        return []
    low = max(max(sizes), -(-sum(sizes) // bins))
    high = low
    while (best := best_fit_decreasing(sizes, high, bins)) is None:
        high += max(1, high // 64)
    while low < high:
        mid = (low + high) // 2
        if (found := best_fit_decreasing(sizes, mid, bins)) is None:
            low = mid + 1
        else:
            best, high = found, mid
    return best


def _parcels(batches: Iterator[pd.DataFrame], capacity: int) -> Iterator[pd.DataFrame]:
    """Pack the groups of a partition; adds parcel (its first group's key) and first, the rows before a group in it."""
    held = [x for x in batches if len(x)]
    if not held:
        return
    x = pd.concat(held, ignore_index=True)
    x["parcel"] = best_fit_decreasing(x["bytes"].tolist(), capacity)
    x = x.sort_values(["parcel", "key"], kind="stable", ignore_index=True)
    x["first"] = x.groupby("parcel")["n"].cumsum() - x["n"]
    x["parcel"] = x.groupby("parcel")["key"].transform("first")
    yield x[["key", "parcel", "first", "bytes", "n"]]


def shard_rows(docs: DataFrame, shards: int = 16, parcels: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, law, shard and slot for each row: shards of near equal bytes, equal texts together.

    A row's size is its text's UTF-8 bytes (null: none) plus 1. Null and empty texts are one group, with crc32 0.
    Slots are gapless from 0 in each shard; repeated rows get slots of their own. A group above a shard's even
    share fills a shard alone. parcels: how many parcels an even shard holds at least; the driver sees about
    2 x shards x parcels of them, and one more for each partition. Other columns of docs are not carried.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = spool(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            salt_of(F.coalesce("doc_id", F.lit(0)), max(SALTS, partitions(spark))).alias("salt"),
        )
    )
    # a hot group is counted in salted pieces, so no task gathers its rows
    pieces = rows.groupBy("key", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    groups = spool(pieces.groupBy("key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")))
    total, count = groups.agg(F.sum("bytes"), F.count("*")).first()
    capacity = max(1, (total or 0) // (shards * parcels))
    spread = max(partitions(spark), -(-count // 200_000))
    packed = spool(groups.repartition(spread, "key").mapInPandas(lambda it: _parcels(it, capacity), "key long, parcel long, first long, bytes long, n long"))
    # each partition leaves at most one parcel less than half full, so their number is bounded by the ratio of sizes
    heap = packed.groupBy("parcel").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).orderBy(F.col("bytes").desc(), "parcel").toPandas()
    heap["shard"] = np.array(pack_into(heap["bytes"].tolist(), shards), dtype="int32")
    heap["base"] = heap.groupby("shard")["n"].cumsum() - heap["n"]
    places = spark.createDataFrame(heap[["parcel", "shard", "base"]].astype({"parcel": "int64", "shard": "int32", "base": "int64"}), "parcel long, shard int, base long")
    in_group = Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("key", "salt", F.coalesce(F.sum("n").over(in_group), F.lit(0).cast("long")).alias("before"))
    placed = pieces.join(packed.join(F.broadcast(places), "parcel"), "key").select("key", "salt", "shard", (F.col("base") + F.col("first") + F.col("before")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("key", "salt").orderBy("doc_id"))
    out = rows.withColumn("rank", rank - 1).join(placed, ["key", "salt"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
