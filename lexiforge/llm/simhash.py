"""SimHash near-duplicates: 64-bit fingerprints, links at a Hamming radius, connected components.

Fingerprints are made by Spark's own functions (its xxhash64 is XXH64 with seed 42). BK-trees find the links: a child
hangs at the integer distance to its parent, and a search follows only edges within the radius. As long as the distinct
fingerprints are few, which is counted, one tree is broadcast and each task searches it for its own. Beyond that shards of
trees are dealt by key: two fingerprints within radius r agree in at least one of r + 1 blocks of bits, so the shards are
the fingerprints that share a block; a shard that is still large is cut again by the blocks of its remaining bits. What a
task reports is a spanning forest of its links, at most one row for each member, so groups of copies never become pairs.
Components are then joined by alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import ascii_lower, spool

RADIUS = 3
#: Widths in bits of the blocks at each level; each level has radius + 1 = 4 of them over the bits that are left.
WIDTHS = (16, 12, 9)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, h (hash of the text) and fp (long) for each distinct pair of doc_id and text; null texts are empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(ascii_lower(text), "[ \\x09-\\x0D]+", -1), lambda w: w != "")
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), words.alias("words"))
    rows = rows.select("doc_id", "h", "words", F.posexplode_outer("words").alias("i", "w"))
    last = F.greatest(F.size("words") - shingle, F.lit(0))
    joined = F.concat_ws(" ", "w", *[F.get("words", F.col("i") + k) for k in range(1, shingle)])
    rows = rows.filter(F.col("i").isNull() | (F.col("i") <= last))
    rows = rows.select("doc_id", "h", F.when(F.col("i").isNotNull(), F.xxhash64(joined)).alias("s"))
    two = (1 << 32) | 1
    sums = [F.coalesce(F.sum(F.shiftrightunsigned("s", i).bitwiseAND(F.lit(two))), F.lit(0).cast("long")).alias(f"c{i}") for i in range(32)]
    agg = rows.groupBy("doc_id", "h").agg(*sums, F.count("s").alias("n"))
    bit = lambda c, at: F.when(2 * c > F.col("n"), F.lit(1 << at if at < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    fp: Column = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"c{i}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"c{i}", 32)
        fp = fp.bitwiseOR(bit(low, i)).bitwiseOR(bit(high, i + 32))
    return agg.select("doc_id", "h", fp.alias("fp"))


def _levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Tables of key and fp: rows that share a key are a shard."""
    out, bits = [], 64
    rows = nodes.select(F.lit(0).cast("long").alias("key"), "fp", F.col("fp").alias("rest"))
    for depth, width in enumerate(WIDTHS):
        cut = []
        for j in range(RADIUS + 1):
            s = j * width
            value = F.shiftrightunsigned("rest", s).bitwiseAND(F.lit((1 << width) - 1))
            above = F.shiftleft(F.shiftrightunsigned("rest", s + width), s) if s + width < bits else F.lit(0).cast("long")
            below = F.col("rest").bitwiseAND(F.lit((1 << s) - 1))
            cut.append(F.struct(F.xxhash64(F.col("key"), F.lit(depth), F.lit(j), value).alias("key"), "fp", above.bitwiseOR(below).alias("rest")))
        bits -= width
        rows = rows.select(F.explode(F.array(*cut)).alias("x")).select("x.*")
        if depth == len(WIDTHS) - 1:
            out.append(rows)
            break
        large = rows.groupBy("key").count().filter(F.col("count") > most).select("key")
        large = spool(large)
        if large.isEmpty():
            out.append(rows)
            break
        out.append(rows.join(large, "key", "left_anti"))
        rows = spool(rows.join(large, "key", "left_semi"))
    return [x.select("key", "fp") for x in out]


def _tree(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of all groups at once: parent of each item (-1: root), and its distance to it. Items are sorted by group."""
    n = len(fp)
    parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    first = np.r_[True, group[1:] != group[:-1]]
    root = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    left = np.flatnonzero(~first)  # those without a place yet
    at = root[left]
    while len(left):
        d = np.bitwise_count(fp[left] ^ fp[at]).astype(np.int64)
        slot = at * 65 + d  # who shares parent and distance goes below the first of them
        _, head, back = np.unique(slot, return_index=True, return_inverse=True)
        chosen = left[head]
        parent[chosen], edge[chosen] = at[head], d[head]
        stay = np.ones(len(left), bool)
        stay[head] = False
        left, at = left[stay], chosen[back][stay]
    return root, parent, edge


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of a[i] and b[i]; a label is the smallest index of its component."""
    while len(a):
        la, lb = label[a], label[b]
        off = la != lb
        a, b, la, lb = a[off], b[off], la[off], lb[off]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _index(group: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trees of all groups: root of each item, and the children sorted by parent and distance (keys and items)."""
    root, parent, edge = _tree(group, fp)
    slot = np.where(parent >= 0, parent * 65 + edge, -1)
    order = np.argsort(slot, kind="stable")
    return root, slot[order], order


def _search(queries: np.ndarray, fp: np.ndarray, tree: list[np.ndarray], radius: int, label: np.ndarray, pairs: int = 2_000_000) -> None:
    """Join the labels of queries (items) and of what lies within the radius; pairs bounds how many (query, node) pairs are looked at together."""
    root, keys, order = tree
    sizes = np.bincount(root, minlength=len(fp))[root[queries]]
    step = np.cumsum(np.maximum(sizes, 1)) // pairs
    for q in np.split(queries, np.flatnonzero(np.diff(step)) + 1):
        node = root[q]
        while len(q):
            d = np.bitwise_count(fp[q] ^ fp[node]).astype(np.int64)
            hit = (d <= radius) & (q != node)
            _merge(label, q[hit], node[hit])
            # only edges within the radius of the distance lead to matches
            lo = np.searchsorted(keys, node * 65 + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(keys, node * 65 + np.minimum(d + radius, 64), "right")
            many = hi - lo
            q = np.repeat(q, many)
            node = order[np.repeat(lo - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())]


def link(group: np.ndarray, fp: np.ndarray, radius: int = RADIUS, pairs: int = 2_000_000) -> np.ndarray:
    """For each item the smallest index of its component among items of its group; sorted by group, fp distinct there."""
    label = np.arange(len(fp))
    _search(np.arange(len(fp)), fp, _index(group, fp), radius, label, pairs)
    return label


def _link_shards(batches: Iterator[pd.DataFrame], most_rows: int = 200_000) -> Iterator[pd.DataFrame]:
    """Whole shards at a time (batches come sorted by key); yields a row (a, b) for each member but one of a component."""

    def done(x: pd.DataFrame) -> pd.DataFrame:
        key, fp = x["key"].to_numpy(), x["fp"].to_numpy()
        label = link(key, fp.view(np.uint64))
        on = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": fp[on], "b": fp[label[on]]})

    kept: list[pd.DataFrame] = []
    rows = 0
    for x in batches:
        if not len(x):
            continue
        kept.append(x)
        rows += len(x)
        if rows >= most_rows:
            x = pd.concat(kept, ignore_index=True)
            last = int(np.searchsorted(x["key"].to_numpy(), x["key"].iloc[-1]))
            if last:
                yield done(x[:last])
            kept = [x[last:]]
            rows = len(kept[0]) if last else 0
    if kept:
        yield done(pd.concat(kept, ignore_index=True))


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for the nodes of edges a, b; any number of rounds until nothing changes."""
    edges = spool(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        edges = spool(small.select("x.*").filter("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _tree_links(nodes: DataFrame) -> DataFrame:
    """a, b: links of all nodes by one broadcast tree; each task searches it for its own fingerprints. nodes are few (checked)."""
    fps = np.sort(np.array([r["fp"] for r in nodes.select("fp").collect()], np.int64).view(np.uint64))
    shared = nodes.sparkSession.sparkContext.broadcast((fps, *_index(np.zeros(len(fps), np.int64), fps)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fp, *tree = shared.value
        for x in batches:
            if not len(x):
                continue
            label = np.arange(len(fp))
            _search(np.searchsorted(fp, x["fp"].to_numpy().view(np.uint64)), fp, tree, RADIUS, label)
            on = np.flatnonzero(label != np.arange(len(label)))
            yield pd.DataFrame({"a": fp[on].view(np.int64), "b": fp[label[on]].view(np.int64)})

    return nodes.select("fp").mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 2048, broadcast: int = 8192) -> DataFrame:
    """doc_id, h, fp, component and component_id for each row; extra columns of docs are not carried.

    h: hash of the text; component: a number that the rows of one component share; component_id: the smallest doc_id in it.
    Null and empty texts have fingerprint zero and are linked like any other; texts of any length are shingled whole, one
    text's words must fit into a task. Repeated rows come back as often as they came; rows of one id with other texts are
    fingerprinted each, and linked only if their fingerprints are. Rows with a null doc_id get their fingerprint's component,
    and no component_id if no document with an id is in it. An empty table gives no rows.

    broadcast: up to so many distinct fingerprints are one tree (16 bytes each) that all tasks get; more are dealt to
    shards by blocks of bits. most: shards of more fingerprints are cut again.
    """
    prints = spool(fingerprints(docs, shingle))
    nodes = spool(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    if nodes.count() <= broadcast:
        edges = _tree_links(nodes)
    else:
        edges = None
        for level in _levels(nodes, most):
            found = level.repartition("key").sortWithinPartitions("key").mapInPandas(_link_shards, "a long, b long")
            edges = found if edges is None else edges.unionByName(found)
    roots = components(edges)
    named = spool(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("component")))
    # by fingerprint, so that a component of very many copies is one row for each distinct one
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.select("fp", "component").join(least, "component")
    ids = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h"))
    named = spool(prints.join(named, "fp"))
    same = (ids["doc_id"].eqNullSafe(named["doc_id"])) & (ids["h"] == named["h"])
    return ids.join(named, same).select(ids["doc_id"], ids["h"], "fp", "component", "component_id")
