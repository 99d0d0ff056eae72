"""Every query of the subpackage on the driver's tables against brute force, a round trip or held-out rows."""

import re
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute
import compare

from lexiforge.llm import language, suffix_dedup
from lexiforge.llm import queries as q


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())


def test_op1(spark, sf_dir, docs):
    rows = q.op1_sharding(spark, sf_dir).collect()
    text = dict(docs)
    assert sorted(r["doc_id"] for r in rows) == sorted(text)
    slots, of_text, load = defaultdict(list), defaultdict(set), defaultdict(int)
    for r in rows:
        data = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        slots[r["shard"]].append(r["slot"])
        of_text[text[r["doc_id"]]].add(r["shard"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    assert set(load) == set(range(16))
    largest = max(len((t or "").encode()) + 1 for _, t in docs)
    assert max(load.values()) <= max(largest * 4, 1.02 * sum(load.values()) / 16)


def test_op2(spark, sf_dir, docs):
    got = {r["doc_id"]: tuple(r) for r in q.op2_suffix_dedup(spark, sf_dir).collect()}
    passages = brute.suffix_dedup(docs, suffix_dedup.PASSAGE)
    want = {d: (d, n, gone, spans, brute.sha(kept), p[2]) for (d, n, gone, spans, kept), p in zip(brute.suffix_dedup(docs), passages, strict=True)}
    assert got == want
    assert any(x[2] for x in want.values())


def test_op3(spark):
    d = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in q.op3_quality(spark, d).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{d}/labels.parquet").collect()]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (brute.crc_mod(i, 4) == 2) for i, r in rows.items())
    held = [(rows[i]["score"], y) for i, y in labels if i in rows and rows[i]["held_out"]]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9


@pytest.mark.parametrize("d, most", [("/root/testdata/sf0.01", 1.0), ("/root/testdata/sf0.1", 0.45)])
def test_op4(spark, d, most):
    """Recall against every inner product, with a bound on the part of the vectors that is verified."""
    rows = q.op4_neighbours(spark, d).collect()
    data = [(r["vec_id"], np.array(r["embedding"], np.float64)) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    ids, vectors = np.array([i for i, _ in data]), np.stack([v for _, v in data])
    assert np.mean([r["verified"] for r in rows]) <= most * len(data)
    found = defaultdict(dict)
    for r in rows:
        found[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    hits = total = 0
    for i, v in data:
        if i % 20:
            continue
        score = vectors @ v
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != i][:20]
        mine = [found[i][k] for k in range(1, 21)]
        assert mine == sorted(mine, key=lambda x: (-x[1], x[0]))
        at = {x: s for x, s in zip(ids, score, strict=True)}
        assert all(abs(at[x] - s) < 1e-9 for x, s in mine)
        hits += len({x for x, _ in mine} & set(ids[order]))
        total += len(order)
    assert hits / total >= 0.9


def test_op5(spark, sf_dir):
    d = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in q.op5_language(spark, d).collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert all(r["held_out"] == (brute.crc_mod(i, 5) == 0) and 0 <= r["score"] <= 1 for i, r in rows.items())
    held = [i for i, r in rows.items() if r["held_out"]]
    assert np.mean([rows[i]["lang_pred"] == lang[i] for i in held]) > 0.95


def test_op6(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x in docs}
    n = brute.check_packing([r.asDict() for r in q.op6_packing(spark, sf_dir).collect()], ids)
    assert n <= -(-sum(map(len, ids.values())) // 4096) + 1


def test_op7(spark, sf_dir, docs):
    rows = {r["doc_id"]: r for r in q.op7_fingerprint(spark, sf_dir).collect()}
    order = sorted(docs, reverse=True)
    prints = defaultdict(set)
    for (d, t), (e, u) in zip(order, [*order[1:], order[0]], strict=True):
        t, u = t or "", u or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        r = rows[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), brute.sha(edited))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if len(t) < 3000:
            (f, a), (g, b), (_, c) = (brute.fingerprint(x) for x in (t, edited, u))
            assert (r["fingerprint"], r["edited_fingerprint"]) == (f, g)
            assert abs(r["near_edited"] - brute.likeness(a, b)) < 1e-9 and abs(r["near_next"] - brute.likeness(a, c)) < 1e-9
        if edited == t:
            assert r["edited_fingerprint"] == r["fingerprint"] and r["near_edited"] == 1
        if rows[e]["fingerprint"] == r["fingerprint"]:
            assert r["near_next"] == 1
        prints[t].add(r["fingerprint"])
    assert all(len(s) == 1 for s in prints.values())
    assert len({next(iter(s)) for s in prints.values()}) == len(prints)
    long = [r for r in rows.values() if r["n_chars"] > 1000]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long]) + 0.2


def test_op8(spark, sf_dir, docs):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in q.op8_simhash(spark, sf_dir).collect()}
    prints = [(d, brute.simhash(t)) for d, t in docs]
    root = brute.components(prints)
    assert got == {d: (f"{f:016x}", root[d]) for d, f in prints}


def test_op9(spark, sf_dir, docs):
    compare.check(q.op9_line_dedup(spark, sf_dir), sf_dir, q.SQL["op9_line_dedup"])
    got = {r["doc_id"]: tuple(r)[1:] for r in q.op9_line_dedup(spark, sf_dir).collect()}
    assert got == {d: (n, gone, brute.sha(t)) for d, (n, gone, t) in brute.line_dedup(docs).items()}


def test_op10(spark, sf_dir, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in q.op10_sentencepiece(spark, sf_dir).collect():
        ids = sp.encode(dict(docs)[r["doc_id"]] or "", num_threads=1)
        assert list(r["ids"]) == ids
        assert r["decoded_sha256"] == brute.sha(sp.decode(ids))


def test_pipeline(spark, sf_dir):
    """Each stage against brute force on what the stage before gave."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    rows = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "suffix_dedup", "best_fit_packing"]
    had = rows(docs)
    out = []
    for name, stage in p.STAGES:
        docs = stage(spark, docs, sf_dir).persist()
        if name == "best_fit_packing":
            break
        assert docs.columns == p.COLUMNS
        now = rows(docs)
        assert docs.filter(F.col("n_chars") != F.length("text")).count() == 0
        if name == "language_id":
            assert set(now) <= set(had) and len(now) > 0.95 * len(had)
            told = [(r["lang"], r["text"]) for r in language.sample(spark.read.parquet(f"{sf_dir}/documents.parquet"), 600, 8 << 20).collect()]
            model = language.fit([x for x, _ in told], [t for _, t in told])
            one = {d: language.code_lengths(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]), model)[0] for d, t in had}
            sure = {d for d, t in had if re.search(r"[^\W\d_]", t or "") and 1 / np.exp2(-np.minimum(one[d] - one[d].min(), 1000)).sum() >= p.MIN_SCORE}
            assert {d for d, _ in now} == sure
        elif name == "line_dedup":
            want = brute.line_dedup(had)
            assert now == sorted((d, t) for d, (_, gone, t) in want.items() if t or not gone)
        elif name == "simhash_dedup":
            root = brute.components([(d, brute.simhash(t)) for d, t in had])
            assert now == [x for x in had if root[x[0]] == x[0]]
        else:
            want = brute.suffix_dedup(had, p.PASSAGE_BYTES)
            assert now == sorted((d, kept.decode("utf-8", "ignore")) for d, _, gone, _, kept in want if not gone or kept.decode("utf-8", "ignore"))
        had = now
        out.append(len(now))
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: [*t.encode(x, add_special_tokens=False).ids, 1] for d, x in had}
    brute.check_packing([r.asDict() for r in docs.collect()], ids)
    assert p.run(spark, sf_dir).count() == docs.count()


def test_xxhash_is_sparks(spark):
    assert spark.sql("SELECT xxhash64('ab')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"ab", seed=42)
