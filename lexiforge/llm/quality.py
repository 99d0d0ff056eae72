"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters slide over chunks of 16 bytes that overlap by 8 and cover the whole text, each
filter is max-pooled over all chunks, and a logistic unit combines the maxima into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.llm.arrow_text import raw
from lexiforge.llm.common import least_by_hash

STRIDE, WIDTH, FILTERS = 8, 4, 24
#: Blocks of STRIDE bytes that are looked at together, which bounds memory for texts of any length.
BLOCKS = 1 << 15


def _blocks(text: np.ndarray) -> np.ndarray:
    """The bytes in rows of STRIDE, zero-filled, and a row of zeros after them."""
    n = max(1, -(-len(text) // STRIDE))
    out = np.zeros((n + 1) * STRIDE, np.uint8)
    out[: len(text)] = text
    return out.reshape(-1, STRIDE)


def _responses(blocks: np.ndarray, m: dict) -> np.ndarray:
    x = m["embed"][blocks].reshape(len(blocks), -1)
    return x[:-1] @ m["left"] + x[1:] @ m["right"] + m["bias"]


def pooled(buf: np.ndarray, offsets: np.ndarray, m: dict) -> np.ndarray:
    """The max-pooled filters of each text."""
    n = len(offsets) - 1
    out = np.zeros((n, m["left"].shape[1]), np.float32)
    at = 0
    while at < n:
        group, rows = [], 0
        while at < n and rows < BLOCKS:
            group.append(at)
            rows += (offsets[at + 1] - offsets[at]) // STRIDE + 2
            at += 1
        parts = [_blocks(buf[offsets[i] : offsets[i + 1]]) for i in group]
        starts = np.cumsum([0, *(len(p) for p in parts)])
        both = np.concatenate(parts) if len(parts) > 1 else parts[0]
        joint = np.zeros(len(both), bool)  # a chunk that would reach into the next text
        joint[starts[1:] - 1] = True
        best = np.zeros((len(group), out.shape[1]), np.float32)
        for low in range(0, len(both) - 1, BLOCKS):
            z = _responses(both[low : low + BLOCKS + 1], m)
            z[joint[low : low + len(z)]] = 0
            first = np.searchsorted(starts, low, "right") - 1
            last = np.searchsorted(starts, low + len(z), "left")
            heads = np.maximum(starts[first:last], low) - low
            most = np.maximum.reduceat(z, heads, axis=0)
            best[first:last] = np.maximum(best[first:last], most[: len(group) - first])
        out[group] = np.maximum(best, 0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 12, seed: int = 0) -> dict:
    """Train by Adam on whole texts; the gradient of a filter flows to the chunk that holds its maximum."""
    rng = np.random.default_rng(seed)
    d = STRIDE * WIDTH
    m = {
        "embed": rng.normal(0, 0.5, (256, WIDTH)), "left": rng.normal(0, 0.25, (d, FILTERS)), "right": rng.normal(0, 0.25, (d, FILTERS)),
        "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.3, FILTERS), "base": np.zeros(1),
    }
    m = {k: v.astype(np.float32) for k, v in m.items()}
    blocks = [_blocks(np.frombuffer(t, np.uint8)) for t in texts]
    weight = np.where(labels > 0, 0.5 / max(1e-9, labels.mean()), 0.5 / max(1e-9, 1 - labels.mean()))
    first, second, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    for epoch in range(epochs):
        rate = 0.01 if epoch < epochs * 2 // 3 else 0.002
        for batch in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // 32)):
            grad = {k: np.zeros_like(v) for k, v in m.items()}
            for i in batch:
                z = _responses(blocks[i], m)
                j = z.argmax(0)
                top = z[j, np.arange(FILTERS)]
                h = np.maximum(top, 0)
                err = (_sigmoid(h @ m["out"] + m["base"])[0] - labels[i]) * weight[i] / len(batch)
                grad["out"] += err * h
                grad["base"] += err
                g = err * m["out"] * (top > 0)
                a, b = blocks[i][j], blocks[i][j + 1]
                grad["left"] += (m["embed"][a].reshape(FILTERS, d) * g[:, None]).T
                grad["right"] += (m["embed"][b].reshape(FILTERS, d) * g[:, None]).T
                grad["bias"] += g
                np.add.at(grad["embed"], a, (g[:, None] * m["left"].T).reshape(FILTERS, STRIDE, WIDTH))
                np.add.at(grad["embed"], b, (g[:, None] * m["right"].T).reshape(FILTERS, STRIDE, WIDTH))
            step += 1
            for k, v in m.items():
                gk = grad[k] + (1e-4 * v if k != "base" else 0)
                first[k] = 0.9 * first[k] + 0.1 * gk
                second[k] = 0.999 * second[k] + 0.001 * gk * gk
                v -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 1200, most_bytes: int = 65536) -> dict | None:
    """Fit on up to per_class documents of each quality, by a hash of the id, of texts up to most_bytes; None without both classes.

    docs: doc_id, text; labels: doc_id, quality. The prior comes from the counts of all labels given. Of rows that repeat
    an id one text counts, of labels that do the better one.
    """
    labels = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= most_bytes)
    rows = texts.select("doc_id").join(labels, "doc_id").select("doc_id", "quality", F.xxhash64("doc_id", F.lit(7)).alias("u"))
    drawn = least_by_hash(rows, "quality", F.col("u"), per_class).distinct()
    rank = F.row_number().over(Window.partitionBy("quality").orderBy("u", "doc_id"))
    ids = drawn.withColumn("r", rank).filter(F.col("r") <= per_class).select("doc_id", "quality", "r")
    one = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("r").alias("r"), F.min("quality").alias("quality"), F.min("text").alias("text"))
    got = one.orderBy("r", "quality").collect()  # at most 2 x per_class texts of most_bytes
    share = labels.agg(F.avg("quality")).first()[0]
    y = np.array([r["quality"] for r in got], float)
    if not len(got) or y.min() == y.max():
        return None
    model = fit([r["text"].encode("utf-8", "replace") for r in got], y)
    # trained on even classes; the offset brings back the share of good labels
    model["base"] = model["base"] + np.float32(np.log(share / (1 - share)))
    return model


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs' columns and score, from the column text alone; null texts are empty. Without a model every score is 0.5.

    Whole texts of any length are looked at, a bounded number of chunks at a time. Rows that repeat come back as often; an
    empty table gives no rows. A column of docs named score is replaced, others pass through.
    """
    docs = docs.drop("score")
    out_type = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for x in batches:
            p = np.full(len(x), 0.5)
            if m is not None and len(x):
                p = _sigmoid((pooled(*raw(x.column("text")), m) @ m["out"] + m["base"]).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(p, pa.float64())], names=[*x.schema.names, "score"])

    return docs.mapInArrow(run, out_type)
