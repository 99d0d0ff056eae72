"""Approximate nearest neighbours by collision counting.

Vectors are projected on `lines` random lines; for each line the projections are kept as one sorted array. A query's window
on a line is centred at its own projection, and virtual rehashing widens all windows by a constant factor: each step
walks outward from the window before and counts the entries that are new. A vector that lies in the windows of at least
`share` of the lines is a candidate and is verified against the original vectors in double precision. A query stops
widening when a block has enough candidates. Inner products are turned into distances by one more coordinate
that gives all indexed vectors the same length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block and queries of a chunk, on average; they depend on the tables alone.
BLOCK, CHUNK = 32768, 1024


class CollisionIndex:
    """The sorted arrays of one block of vectors."""

    def __init__(self, vectors: np.ndarray, longest: float, lines: int, seed: int = 11) -> None:
        self.vectors = vectors
        rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
        self.lines = np.random.default_rng(seed).normal(size=(vectors.shape[1] + 1, lines))
        shadows = (np.c_[vectors, rest] @ self.lines).T.copy()
        self.order = np.argsort(shadows, axis=1, kind="stable")
        self.sorted = np.take_along_axis(shadows, self.order, 1)
        self.scale = float(longest) or 1.0

    def candidates(self, queries: np.ndarray, enough: int, share: float, first: float = 0.6, factor: float = 1.1) -> list[np.ndarray]:
        """For each query the rows that collide on enough lines, at the first window that gives `enough` of them.

        first: half of the first window, for vectors of length 1; factor: by how much windows grow.
        """
        lines, n = self.order.shape
        at = np.c_[queries, np.zeros(len(queries))] @ self.lines
        need, enough = int(np.ceil(share * lines)), min(enough, n)
        ranges: list[tuple[list[list[int]], list[list[int]]]] = []

        def window(q: int, step: int) -> tuple[list[int], list[int]]:
            if step == len(ranges):  # the windows of all queries at this width
                half = first * self.scale * factor**step
                ranges.append(tuple(np.stack([np.searchsorted(s, at[:, j] + d, side) for j, s in enumerate(self.sorted)], 1).tolist() for d, side in ((-half, "left"), (half, "right"))))
            low, high = ranges[step]
            return low[q], high[q]

        out = []
        for q in range(len(queries)):
            step = 0
            low, high = window(q, 0)
            count = np.zeros(n, np.uint8 if lines < 256 else np.uint16)
            one = count.dtype.type(1)
            for o, a, b in zip(self.order, low, high, strict=True):
                np.add.at(count, o[a:b], one)
            while np.count_nonzero(hit := count >= need) < enough:
                step += 1
                left, right = window(q, step)
                for o, a, b, c, d in zip(self.order, left, low, high, right, strict=True):
                    np.add.at(count, o[a:b], one)
                    np.add.at(count, o[c:d], one)
                low, high = left, right
            out.append(np.flatnonzero(hit))
        return out


def search(index: pd.DataFrame, queries: pd.DataFrame, longest: float, k: int, lines: int, share: float, enough: float, least: int) -> pd.DataFrame:
    """The k best verified candidates of a block for each query, ties to the smaller vec_id, and how many were verified."""
    ids = index["vec_id"].to_numpy()
    block = CollisionIndex(np.stack(index["embedding"]).astype(np.float64), longest, lines)
    owners, best_ids, scores, verified = [], [], [], []
    for low in range(0, len(queries), 256):
        part = queries.iloc[low : low + 256]
        vectors = np.stack(part["query"]).astype(np.float64)
        for own, v, found in zip(part["query_id"], vectors, block.candidates(vectors, k + 1 + max(least, int(enough * len(ids))), share), strict=True):
            found = found[ids[found] != own]
            many = len(found)
            score = block.vectors[found] @ v
            if many > k:
                edge = np.partition(score, many - k)[many - k]
                found, score = found[score >= edge], score[score >= edge]
            best = np.lexsort((ids[found], -score))[:k]
            owners.append(np.full(len(best), own))
            best_ids.append(ids[found[best]])
            scores.append(score[best])
            verified.append(np.full(len(best), many))
    return pd.DataFrame({"query_id": np.concatenate(owners), "vec_id": np.concatenate(best_ids), "score": np.concatenate(scores), "verified": np.concatenate(verified)})


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, lines: int = 128, share: float = 0.5, enough: float = 0.15, least: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score and verified: the k nearest by inner product for each row whose vec_id is divisible by `every`.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id. Of rows that
    repeat an id the least vector counts. Only vectors of one length are compared. An empty table gives no rows. A
    query with fewer than k others gets them all. Other columns of vectors are not looked at. Block and query chunk meet in
    one task each, so memory is bounded. enough, least: the part of a block that is verified for a query, and how many of
    its vectors, at least; verified: how many vectors of the row's block that were.
    """
    good = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n, n_queries, longest = rows.agg(F.count("*"), F.sum((F.col("vec_id") % every == 0).cast("long")), F.max(norm)).first()
    blocks, chunks = max(1, -(-n // BLOCK)), max(1, -(-(n_queries or 0) // CHUNK))
    deal = lambda seed, m: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(m)).cast("int")
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    index = rows.select("vec_id", "embedding", "dim", deal(1, blocks).alias("block"), all_of(chunks).alias("chunk"))
    queries = rows.filter(F.col("vec_id") % every == 0)
    # names of their own, so that the optimizer never takes a column of one side for one of the other
    queries = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("dim").alias("dim"), all_of(blocks).alias("block"), deal(2, chunks).alias("chunk"))
    longest = longest or 1.0

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"), "verified": pd.Series(dtype="int64")})
        return search(a, b, longest, k, lines, share, enough, least)

    key = ["dim", "block", "chunk"]
    found = index.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score double, verified long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "verified")
