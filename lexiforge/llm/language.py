"""Language identification by prediction by partial matching.

For each language a byte context tree of variable order (up to three bytes) is counted on a bounded sample of labelled
documents and then frozen. In a context, seen symbols share T / (T + D) of the probability by their counts and the
escape D / (T + D) passes to the next shorter context, over the symbols not seen here (T: count, D: distinct symbols);
below the empty context all 256 bytes are alike. A text's exact code length under each language is the sum over all
its bytes; the shortest wins. Contexts are held once for all languages: the last two bytes lead to a node, the third
to one of the node's children if it has any, that is to the row of the longest context in the tree; and the row
gives the code length of each symbol in each language. Bytes that the sample never holds have equal probabilities in
every context, so one column stands for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.arrow_text import raw
from lexiforge.llm.common import fresh, least_by_hash

CHUNK = 1 << 19


def sample(docs: DataFrame, per_language: int, most_bytes: int) -> DataFrame:
    """lang and text of up to per_language distinct rows of each language, most_bytes together: short texts first, then by a hash.

    A text that alone has more than most_bytes is learned from as far as they go.
    """
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    size = F.octet_length("text").cast("long")
    rows = rows.select("lang", size.alias("size"), (size > 32768).alias("long"), F.xxhash64("doc_id", "text").alias("u"), "text")
    drawn = least_by_hash(rows.drop("text").withColumn("group", F.struct("lang", "long")), "group", F.col("u"), per_language)
    # rows that repeat are one: partial sums come first, so a row with very many copies is one of each task
    drawn = drawn.groupBy("lang", "long", "u").agg(F.min("size").alias("size"))
    order = Window.partitionBy("lang").orderBy("long", "u")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = drawn.withColumns({"r": F.row_number().over(order), "before": before}).filter((F.col("r") <= per_language) & (F.col("before") < most_bytes))
    # texts are read for the rows that were drawn alone: per_language of each language
    some = rows.join(F.broadcast(drawn.select("lang", "u", "r")), ["lang", "u"])
    return some.groupBy("lang", "u").agg(F.min("r").alias("r"), F.min(F.substring("text", 1, most_bytes)).alias("text")).select("lang", "text", "r").orderBy("lang", "r").drop("r")


def fit(langs: list[str], texts: list[str], rows: int | None = 8192, least: int = 6) -> dict:
    """The frozen trees of the languages. rows: how many contexts are kept, the most frequent ones (None: all); least: the count from which one is kept."""
    names = sorted(set(langs))
    which = {x: i for i, x in enumerate(names)}
    parts = [np.frombuffer(b"\n\n\n" + text.encode("utf-8", "replace"), np.uint8) for text in texts]
    owner = np.repeat(np.array([which[x] for x in langs], np.min_scalar_type(len(names))), [len(p) for p in parts])
    inner = np.ones(len(owner), bool)
    heads = np.cumsum([0, *(len(p) for p in parts)])[:-1]
    inner[(heads[:, None] + np.arange(3)).ravel()] = False
    data = np.concatenate(parts)
    del parts
    seen = np.flatnonzero(np.bincount(data, minlength=256))
    symbols, n_lang = len(seen) + 1, len(names)
    sym = np.full(256, len(seen), np.int32)
    sym[seen] = np.arange(len(seen))
    stands_for = np.ones(symbols)  # how many bytes a column stands for
    stands_for[-1] = 256 - len(seen)
    s = sym[data].astype(np.uint16)
    del data

    def slices(order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Contexts of so many bytes, and symbol and language in one number; a slice at a time, for the driver's memory."""
        for low in range(3, len(s), 1 << 18):
            at = np.arange(low, min(len(s), low + (1 << 18)))
            at = at[inner[at]]
            ctx = np.zeros(len(at), np.int64)
            for back in range(order, 0, -1):
                ctx = ctx * symbols + s[at - back]
            yield ctx, s[at].astype(np.int64) * n_lang + owner[at]

    kept: list[np.ndarray] = []  # the contexts of each order, ascending
    blocks: list[np.ndarray] = []
    bases = [0]
    for order in range(4):
        found = [np.unique(ctx, return_counts=True) for ctx, _ in slices(order)]
        ctx, at = np.unique(np.concatenate([c for c, _ in found] or [np.zeros(0, np.int64)]), return_inverse=True)
        many = np.bincount(at, np.concatenate([m for _, m in found] or [np.zeros(0)]), len(ctx)) if len(ctx) else np.zeros(0)
        if order:
            on = (many >= least) & np.isin(ctx % symbols ** (order - 1), kept[-1])  # a context's shorter one is kept, too
            ctx, many = ctx[on], many[on]
            if rows is not None and len(ctx) > rows - bases[-1]:
                ctx = np.sort(ctx[np.argsort(-many, kind="stable")[: max(0, rows - bases[-1])]])
        else:
            ctx = np.zeros(1, np.int64)
        counts = np.zeros(len(ctx) * symbols * n_lang, np.float32)
        for where, what in slices(order):
            row = np.minimum(np.searchsorted(ctx, where), max(0, len(ctx) - 1))
            on = ctx[row] == where if len(ctx) else np.zeros(len(where), bool)
            cell, more = np.unique(row[on] * (symbols * n_lang) + what[on], return_counts=True)
            counts[cell] += more
        counts = counts.reshape(-1, symbols, n_lang)
        if order == 0:
            shorter = np.full((1, symbols, n_lang), 1 / 256)
        else:
            shorter = blocks[-1][np.searchsorted(kept[-1], ctx % symbols ** (order - 1))]
        total, distinct = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        unseen = np.where(counts > 0, 0, shorter)
        rest = (unseen * stands_for[:, None]).sum(1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            escape = np.where(rest > 0, distinct / (total + distinct), 0)
            unseen *= escape / rest
            p = np.where(counts > 0, counts * ((1 - escape) / total), unseen)
        np.copyto(p, shorter, where=total == 0)
        blocks.append(p)
        kept.append(ctx)
        bases.append(bases[-1] + len(ctx))
    cost = -np.log2(np.maximum(np.concatenate(blocks), 1e-30)).reshape(-1, n_lang).astype(np.float32)

    def rows_of(order: int, ctx: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
        if not len(kept[order]):
            return otherwise
        at = np.minimum(np.searchsorted(kept[order], ctx), len(kept[order]) - 1)
        return np.where(kept[order][at] == ctx, bases[order] + at, otherwise)

    pair = np.arange(symbols * symbols)
    row = rows_of(2, pair, rows_of(1, pair % symbols, np.zeros(len(pair), np.int64)))
    parents, nth = np.unique(kept[3] % symbols**2, return_inverse=True)
    step = np.zeros(len(pair), np.int32)  # 1 for the pairs that have children, one cell for each symbol
    step[parents] = 1
    first = np.cumsum(np.where(step, symbols, 1)) - np.where(step, symbols, 1)
    cells = np.repeat(row, np.where(step, symbols, 1))
    cells[first[parents[nth]] + kept[3] // symbols**2] = bases[3] + np.arange(len(kept[3]))
    return {"names": names, "sym": sym, "first": first.astype(np.int32), "step": step, "cells": cells.astype(np.int32), "cost": cost, "symbols": symbols}


def code_lengths(buf: np.ndarray, offsets: np.ndarray, model: dict) -> np.ndarray:
    """Bits of each text under each language; buf holds the texts one after another."""
    k, n = model["symbols"], len(offsets) - 1
    out = np.zeros((n, len(model["names"])))
    pad = int(model["sym"][10])
    for start in range(0, len(buf), CHUNK):
        stop = min(len(buf), start + CHUNK)
        lead = min(3, start)
        s = np.concatenate([np.full(3 - lead, pad, np.int32), model["sym"][buf[start - lead : stop]]])
        first = np.searchsorted(offsets, start, "right") - 1
        last = np.searchsorted(offsets, stop, "left")
        heads = offsets[max(0, first) : last]
        c = [s[j : j + stop - start].copy() for j in range(3)]  # the third, second and last byte before
        for back in range(3):  # bytes before a text's start are as new lines
            for step in range(back + 1):
                at = heads + step - start
                at = at[(at >= 0) & (at < stop - start)]
                c[2 - back][at] = pad
        pair = c[1] * k + c[2]
        row = model["cells"][model["first"][pair] + model["step"][pair] * c[0]]
        bits = model["cost"][row * k + s[3:]]
        cuts = np.maximum(offsets[first:last], start) - start
        has = np.flatnonzero(np.minimum(offsets[first + 1 : last + 1], stop) - start > cuts)
        if len(has):
            out[first + has] += np.add.reduceat(bits, cuts[has], axis=0, dtype=np.float64)
    return out


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs' columns and lang_pred and score (the posterior under equal priors); docs needs a column text.

    Null texts, texts without a letter, and all texts if nothing was learned get `und` and score 0. Ties go to the
    name that sorts first. Texts of any length are read half a megabyte at a time. Columns of docs named lang_pred or
    score are replaced, others pass through; Python workers get the texts alone and send none back, since each of a task's
    batches (64 MB) would be held twice. Rows that repeat come back as often; an empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "score")
    (told_at,) = fresh(docs.columns, "told")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for x in batches:
            names, score = np.full(len(x), "und", object), np.zeros(len(x))
            if m is not None and len(x):
                bits = code_lengths(*raw(x), m)
                best = bits.argmin(1)
                names = np.array(m["names"], object)[best]
                score = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

    # a filter on the result must not run it once more
    told = F.arrow_udf(run, "lang_pred string, score double").asNondeterministic()
    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    out = docs.withColumn(told_at, told("text"))
    at = F.col(told_at)
    lang, score = F.when(letters, at["lang_pred"]).otherwise("und"), F.when(letters, at["score"]).otherwise(0.0)
    return out.withColumns({"lang_pred": lang, "score": score}).drop(told_at)


def learn(docs: DataFrame, per_language: int = 600, most_bytes: int = 8 << 20, rows: int | None = 8192, least: int = 6) -> dict | None:
    """Fit on a bounded sample of docs (columns doc_id, text, lang); None if no row has text, language and id.

    per_language, most_bytes: rows and bytes for each language; rows, least: which contexts the trees keep (see fit). Rows
    that repeat count once.
    """
    got = sample(docs, per_language, most_bytes).collect()  # at most per_language texts and about most_bytes for each language
    return fit([r["lang"] for r in got], [r["text"] for r in got], rows, least) if got else None
