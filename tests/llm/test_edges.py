"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns for every operator of the subpackage."""

import random
import re
import sys
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
import brute

from lexiforge.llm import fingerprint, language, line_dedup, neighbours, packing, pieces, quality, sharding, simhash, suffix_dedup, words

BPE, SP = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
PASSAGE = " ".join(f"passage{i * 7919 % 1000}" for i in range(60))
LINE = "A line that is long enough to be counted by all of them."
TEXTS = [
    None, "", " ", "\n", "a", "A b", "a b c", LINE, f"  {LINE.lower()}\t", *[f"{LINE}\nown {i}" for i in range(5)], PASSAGE, f"x {PASSAGE} y", f"{PASSAGE} {PASSAGE}", "é" * 900, "é" * 900,
    "word " * 40000, "\x00 zero", "emoji 😀 ḿ İ ß", "|<|endoftext|>|", "▁ ▁▁", "123 45",
]
#: Names that operators use for themselves.
EXTRA = ["h", "k1", "_k1", "runs", "row", "drop", "line", "pos", "key", "score", "n_bytes", "n_lines", "size", "rank", "lang_pred", "__runs", "bucket", "salt", "fp", "held_out"]


def frame(spark, texts=TEXTS, more=()):
    rows = [(i, t, "l" if i % 2 else None, "s", None, *[f"x{i}"] * len(EXTRA)) for i, t in enumerate(texts)] + [(*r, "l", "s", None, *["y"] * len(EXTRA)) for r in more]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA))


def bare(spark, texts=TEXTS, more=()):
    return frame(spark, texts, more).select("doc_id", "text")


MORE = [(3, "\n"), (14, PASSAGE), (None, PASSAGE), (None, None)]  # repeated rows, and rows without an id


def test_sharding(spark):
    rows = sharding.shard_rows(frame(spark, more=MORE)).collect()
    assert len(rows) == len(TEXTS) + len(MORE)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard_rows(frame(spark).limit(0)).count() == 0
    hot = spark.createDataFrame([(i, "same" if i % 2 else f"text {i}") for i in range(400)], "doc_id long, text string")
    assert len({r["shard"] for r in sharding.shard_rows(hot).collect() if r["doc_id"] % 2}) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60), st.integers(1, 8))
def test_best_fit_decreasing(sizes, bins):
    out = sharding.best_fit_decreasing(sizes, 64)
    load, order = {}, sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    for i in order:  # each item goes where the least room is left
        fit = [(64 - v, b) for b, v in load.items() if 64 - v >= sizes[i]]
        assert out[i] == (min(fit)[1] if fit else len(load))
        load[out[i]] = load.get(out[i], 0) + sizes[i]
    spread = sharding.pack_into(sizes, bins)
    if sizes:
        assert set(spread) <= set(range(bins))
        assert max(sum(s for s, b in zip(sizes, spread, strict=True) if b == k) for k in range(bins)) <= max(max(sizes), -(-sum(sizes) // bins) * 4 / 3 + 1)


def test_line_dedup(spark):
    got = {r["doc_id"]: r for r in line_dedup.drop_common_lines(frame(spark)).collect()}
    for d, (n, gone, text) in brute.line_dedup(list(enumerate(TEXTS))).items():
        assert (got[d]["n_lines"], got[d]["n_dropped"], got[d]["text"]) == (n, gone, text)
        assert all(got[d][c] == f"x{d}" for c in EXTRA if c != "n_lines")
    assert got[7]["n_dropped"] == 1
    out = line_dedup.drop_common_lines(frame(spark, more=MORE)).collect()
    assert len(out) == len(TEXTS) + len(MORE)
    assert line_dedup.drop_common_lines(frame(spark).limit(0)).count() == 0


def test_line_dedup_of_very_many_lines(spark):
    many = "\n".join([*(f"{LINE} {i}" for i in range(50_000)), *("own " * 10 + str(i) for i in range(50_000))])
    docs = spark.createDataFrame([(i, many + f"\n{i}") for i in range(5)], "doc_id long, text string")
    start = time.perf_counter()
    got = {r["doc_id"]: r for r in line_dedup.drop_common_lines(docs).collect()}
    assert time.perf_counter() - start < 60
    assert all((r["n_lines"], r["n_dropped"], r["text"]) == ((100_001, 100_000, str(i)) if i < 4 else (100_001, 0, f"{many}\n4")) for i, r in got.items())


def test_suffix_dedup(spark):
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(frame(spark)).collect()}
    for d, n, gone, spans, kept in brute.suffix_dedup(list(enumerate(TEXTS))):
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, gone, spans, brute.sha(kept))
        assert all(r[c] == f"x{d}" for c in EXTRA if c != "n_bytes")
    again = suffix_dedup.remove_repeats(bare(spark, more=MORE)).collect()
    assert len(again) == len(TEXTS) + len(MORE)
    assert all(r["n_removed"] == len(PASSAGE) for r in again if r["text"] is not None and r["n_bytes"] == len(PASSAGE))
    assert suffix_dedup.remove_repeats(frame(spark).limit(0)).count() == 0


def test_suffix_dedup_at_random(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd") for _ in range(1200)) for _ in range(6)]
    texts = []
    for _ in range(120):
        parts = [b[(s := rng.randint(0, 700)) : s + rng.randint(350, 480)] if rng.random() < 0.7 else "".join(rng.choice("abcdé") for _ in range(rng.randint(0, 90))) for b in rng.choices(base, k=4)]
        texts.append("".join(parts))
    texts += ["ab" * 2000, "a" * 3000, "ab" * 2100]
    want, shorter = brute.suffix_dedup(list(enumerate(texts))), brute.suffix_dedup(list(enumerate(texts)), 256)
    for most in (32, 2):  # also with every anchor dealt to several shards
        got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(bare(spark, texts), passage=256, most=most).collect()}
        for (d, n, gone, spans, kept), short in zip(want, shorter, strict=True):
            r = got[d]
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["n_passage"]) == (n, gone, spans, brute.sha(kept), short[2])


def test_passages_of_words(spark, tmp_path):
    """The query names every document that shares over 50 words with another, of whatever length in bytes."""
    from lexiforge.llm import queries

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    short = " ".join(word()[:3] for _ in range(51))
    tiny, fifty, twice = " ".join("ab"[i % 2] + "cdefg"[i // 7 % 5] for i in range(51)), text(50), " ".join(word()[:3] for _ in range(51))
    texts = [f"{text(90)} {p} {text(70)}" for p in (short, short, tiny, tiny, fifty, fifty, f"{twice} {text(9)} {twice}", text(40))]
    texts += [short, None, "", f"{text(9)}x{short}", short]
    want = []
    found = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    windows = [{(t or "").encode()[w[i][0] : w[i + 50][1]]: (w[i][0], w[i + 50][1]) for i in range(len(w) - 50)} for t, w in zip(texts, found, strict=True)]
    for k, mine in enumerate(windows):
        covered = {x for d, (a, b) in mine.items() if any(d in other for j, other in enumerate(windows) if j != k) for x in range(a, b)}
        want.append(len(covered))
    assert len(short) < 320 and len(tiny) < 160 and [bool(n) for n in want] == [True] * 4 + [False] * 4 + [True, False, False, False, True]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = suffix_dedup.CHUNK
    for size in (before, 600):
        suffix_dedup.CHUNK = size
        try:
            buf = np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8)
            got = suffix_dedup.word_windows(buf, np.cumsum([0, *(len(t or "") for t in texts)]), 50, 320)
        finally:
            suffix_dedup.CHUNK = before
        every = {(k, a, b) for k, mine in enumerate(windows) for d, (a, b) in mine.items() if b - a < 320}
        assert {(k, a, b) for k, a, b in zip(got["text"].tolist(), got["start"].tolist(), got["stop"].tolist(), strict=True)} >= every
    rows = {r["doc_id"]: r["n_passage"] for r in queries.op2_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [rows[i] for i in range(len(texts))] == want


def test_pipeline_cuts_short_passages_of_words(spark, sf_dir):
    """Runs of over 50 words that two documents share go whatever their bytes, with `beside` also next to a longer repeat; 50 words stay."""
    import corpus_pipeline as p

    rng = random.Random(12)
    text = lambda n, k: " ".join("".join(rng.choice("abcdefgh") for _ in range(k)) for _ in range(n))
    short, fifty, long, twice = text(51, 3), text(50, 3), text(60, 7), text(51, 3)
    assert len(short) < p.PASSAGE_BYTES < len(long)
    kinds = [[short], [short, long], [long], [fifty], [fifty], [twice, twice], [short, fifty]]
    own = [[text(30, 5) for _ in range(len(k) + 1)] for k in kinds]
    texts = [" ".join(x for pair in zip(o, [*k, ""], strict=True) for x in pair).strip() for o, k in zip(own, kinds, strict=True)]
    rows = [(i, t, "l", "s", len(t)) for i, t in enumerate(texts)] + [(90, None, None, None, None), (91, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    less = {i: t.replace(f" {long} ", "") for i, t in enumerate(texts)}
    want = {i: t.replace(short, "").split() for i, t in less.items()} | {90: [], 91: []}
    every = suffix_dedup.remove_repeats(docs, length=p.PASSAGE_BYTES, words=p.PASSAGE_WORDS, beside=True)
    assert {r["doc_id"]: r["text"].split() for r in every.collect()} == want
    got = {r["doc_id"]: (r["text"] or "").split() for r in p.suffix_dedup(spark, docs, sf_dir).collect()}
    assert got == want | {1: less[1].split()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80))
def test_suffix_arrays(symbols):
    text = np.array(symbols, np.uint8)
    sa, rank = suffix_dedup.suffix_array(text)
    data = text.tobytes()
    want = sorted(range(len(data)), key=lambda i: data[i:])
    assert sa.tolist() == want
    common = [0] + [next((k for k, (x, y) in enumerate(zip(data[a:], data[b:], strict=False)) if x != y), min(len(data) - a, len(data) - b)) for a, b in zip(want, want[1:], strict=False)]
    if len(data):
        assert suffix_dedup.common_prefixes(text, sa, rank).tolist() == common


def test_simhash(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    texts = [*TEXTS]
    for _ in range(30):
        t = rng.choices(words, k=rng.randint(1, 300))
        texts += [" ".join(t), " ".join([*t[:-1], "end"]), " ".join(t).upper()]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    prints = [(d, brute.simhash(t)) for d, t in enumerate(texts)]
    root = brute.components(prints)
    for d, f in prints:
        assert (got[d]["fp"] % (1 << 64), got[d]["component_id"]) == (f, root[d])
    assert len({root[i] for i in (0, 1, 2, 3)}) == 1  # no words: fingerprint zero, linked
    out = simhash.near_duplicates(frame(spark, more=MORE)).collect()
    assert len(out) == len(TEXTS) + len(MORE)
    assert simhash.near_duplicates(frame(spark).limit(0)).count() == 0


def test_simhash_links_at_every_distance():
    rng = np.random.default_rng(7)
    fp = np.unique(rng.integers(0, 1 << 63, 40, dtype=np.uint64))
    near = [f ^ np.uint64(sum(1 << int(b) for b in rng.choice(63, k, replace=False))) for f in fp for k in (1, 3, 4, 6)]
    fp = np.unique(np.r_[fp, np.array(near, np.uint64)])
    label = simhash.link(np.zeros(len(fp), np.int64), fp, pairs=50)
    assert label.tolist() == [brute.components([(i, int(f)) for i, f in enumerate(fp)])[i] for i in range(len(fp))]


def test_simhash_cut_shards(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices("abcdefgh", k=6)) for _ in range(500)]
    want = brute.components([(d, brute.simhash(t)) for d, t in enumerate(texts)])
    for broadcast in (8192, 0):  # one tree for all tasks, or shards
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(bare(spark, texts), most=2, broadcast=broadcast).collect()}
        assert got == want


def test_simhash_of_ids_that_repeat(spark):
    """Rows of one id with other texts are documents each; so are rows without an id."""
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 9
    rows = [(1, "p q r s"), (1, near), (2, near + "end"), (None, near), (None, "x y z"), (4, "p q r s")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    of = {(r["doc_id"], r["h"]): r["component"] for r in got}
    assert len(of) == 6 and len(set(of.values())) == 3
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1), (4, 1)]


def test_fingerprints(spark):
    rows = {r["doc_id"]: r for r in fingerprint.fingerprints(frame(spark), ranges=4).collect()}
    order = sorted(enumerate(TEXTS), reverse=True)
    for (d, t), (_, u) in zip(order, [*order[1:], order[0]], strict=True):
        t, u = t or "", u or ""
        assert rows[d]["n_chars"] == len(t)
        assert rows[d]["edited_sha256"] == brute.sha(t[: len(t) - len(t) // 2] + u[: len(t) // 2])
    assert rows[17]["fingerprint"] == rows[18]["fingerprint"]
    out = fingerprint.fingerprints(bare(spark, more=MORE)).collect()
    assert sorted(r["doc_id"] for r in out if r["doc_id"] is not None) == sorted([*range(len(TEXTS)), 3, 14])
    assert len(out) == len(TEXTS) + len(MORE)
    # rows without an id come last: the first of them follows document 0, whose text is null, the last is followed by the highest id
    none = [r for r in out if r["doc_id"] is None]
    assert {r["n_chars"] for r in none} == {0, len(PASSAGE)}
    hot = spark.createDataFrame([(7, f"p {i} q {i % 9}\nr") for i in range(300)] + [(i, f"o {i}") for i in range(60)], "doc_id long, text string")
    got = [sorted((r["doc_id"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in fingerprint.fingerprints(hot, ranges=k).collect()) for k in (1, 4, 16)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 360
    one = fingerprint.fingerprints(spark.createDataFrame([(1, "abc\nd")], "doc_id long, text string")).collect()
    assert one[0]["near_next"] == 1
    assert fingerprint.fingerprints(frame(spark).limit(0)).count() == 0
    a, b, both, turned = (
        {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(spark.createDataFrame([(1, "p q r"), (2, "s t"), (3, "p q r\ns t"), (4, "s t\np q r")], "doc_id long, text string")).collect()}[i] for i in (1, 2, 3, 4)
    )
    assert both == turned == fingerprint.combine(a, b)
    assert fingerprint.combine(both, b, -1) == a


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    got = [r.asDict() for r in packing.pack(frame(spark), BPE).collect()]
    brute.check_packing(got, {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x in enumerate(TEXTS)})
    assert packing.pack(frame(spark, more=MORE), BPE).count() == len(got) + len(MORE)
    assert packing.pack(frame(spark).limit(0), BPE).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), max_size=8))
def test_bin_completion(counts):
    found = packing.bin_completion(counts, 30)
    used = {}
    for runs, n in found:
        assert sum(x * k for x, k in runs) <= 30
        for x, k in runs:
            used[x] = used.get(x, 0) + k * n
    assert used == counts
    assert sum(n for _, n in found) <= sum(n for _, n in packing.best_fit(counts, 30))


def test_bin_completion_finds_the_least_number():
    """Against every way to fill sequences, on small tables."""

    def least(items, capacity):
        items, best = sorted(items, reverse=True), [len(items)]

        def go(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(items):
                best[0] = len(rooms)
                return
            for room in {r for r in rooms if r >= items[i]}:
                k = rooms.index(room)
                rooms[k] -= items[i]
                go(i + 1, rooms)
                rooms[k] += items[i]
            go(i + 1, [*rooms, capacity - items[i]])

        go(0, [])
        return best[0]

    better = 0
    for seed in range(400):
        rng = random.Random(seed)
        capacity = rng.choice([10, 20, 30])
        items = [rng.randint(1, capacity) if rng.random() < 0.3 else rng.randint(capacity // 5, capacity // 2) for _ in range(rng.randint(1, 12))]
        counts = dict(Counter(items))
        found = sum(n for _, n in packing.bin_completion(counts, capacity, None, None, None))
        assert packing.lower_bound(counts, capacity) <= found == least(items, capacity)
        better += found < sum(n for _, n in packing.best_fit(counts, capacity))
    assert better > 5


@pytest.mark.parametrize("seed", range(3))
def test_bin_completion_beats_best_fit(seed):
    """Ten sequences that three pieces each fill to the last token: best fit needs more, the search does not."""
    rng, counts = random.Random(seed), Counter()
    for _ in range(10):
        a = rng.randint(1040, 1800)
        b = rng.randint(1040, 4096 - a - 1030)
        counts.update([a, b, 4096 - a - b])
    assert sum(n for _, n in packing.best_fit(counts, 4096)) > 10
    assert sum(n for _, n in packing.bin_completion(counts)) == 10


def test_word_memory():
    """Ids do not depend on what is kept, nor on where a long text is cut."""
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(BPE), random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdeé1'.") for _ in range(rng.randint(1, 9))) for _ in range(300)) for _ in range(40)]
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    coder = packing.Encoder(BPE, most=50_000)
    assert [coder.encode([x])[0] for x in texts] == want == coder.encode(texts)
    before = words.PART
    try:
        words.PART = 100
        assert coder.encode(texts) == want
    finally:
        words.PART = before
    long = "x" * 1_000_000 + " " + "y z" * 300_000
    assert packing.Encoder(BPE).encode([long])[0] == np.array(t.encode(long, add_special_tokens=False).ids, "<u4").tobytes()


def test_words_of_the_table():
    """Ids of texts with every kind of word, where words share slots of the table and its pool begins anew."""
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(BPE), random.Random(5)
    symbols = "abstrvemld''' .,\n\t12é²½ßÉÀŸſŉ\xa0\x85\x00-AZ"
    texts = ["".join(rng.choice(symbols) for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    texts += ["", "'", "'s", "it's 'll'rest''s .'s", "x" * 5000 + " y", "Ω ſ", "<|endoftext|> a", " ".join("abcdefghijklmnopqrstuv"[: rng.randint(1, 22)] for _ in range(900))]
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    sizes = packing.BLOCK, packing.SLOTS, packing.POOL
    try:
        for packing.BLOCK, packing.SLOTS, packing.POOL in (sizes, (3000, 16, 64)):
            coder = packing.Encoder(BPE, most=50_000)
            assert coder.encode(texts) == want == coder.encode(texts)
    finally:
        packing.BLOCK, packing.SLOTS, packing.POOL = sizes
    coder, asked = packing.Encoder(BPE), []
    each = coder.memory.each
    coder.memory.each = lambda new: asked.append(len(new)) or each(new)
    many = ["der hund und die katze " * 4000] * 3
    assert len(set(coder.encode(many))) == 1 and coder.encode(many[:1]) == coder.encode(many)[:1]
    assert sum(asked) == 5  # of each word one is looked up in the dictionary, once


def test_small_batches(spark, sf_dir):
    """The pipeline's stages send no more than a few megabytes of rows to a Python worker at once."""
    import corpus_pipeline as p
    import pyarrow as pa
    from lexiforge.llm.common import BATCH

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.range(4000).selectExpr("id", "repeat('abcdefghij', 400) AS text").coalesce(1)
    sizes = lambda it: (pa.RecordBatch.from_arrays([pa.array([x.nbytes])], names=["n"]) for x in it)
    try:
        for k in (0, 3, 4):
            spark.conf.unset(name)
            assert max(r["n"] for r in rows.mapInArrow(sizes, "n long").collect()) > 2 * BATCH
            p.STAGES[k][1](spark, frame(spark), sf_dir)
            assert max(r["n"] for r in rows.mapInArrow(sizes, "n long").collect()) < 1.1 * BATCH
        spark.conf.set(name, "64k")
        p.STAGES[0][1](spark, frame(spark), sf_dir)
        assert spark.conf.get(name) == "64k"
    finally:
        spark.conf.unset(name)


def test_pieces(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    for r in pieces.encode(frame(spark), SP).collect():
        text = TEXTS[r["doc_id"]] or ""
        ids = sp.encode(text, num_threads=1)
        assert list(r["ids"]) == ids, text[:40]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r["decoded_sha256"] == brute.sha(sp.decode(ids))
    assert pieces.encode(frame(spark, more=MORE), SP).count() == len(TEXTS) + len(MORE)
    assert pieces.encode(frame(spark).limit(0), SP).count() == 0
    m = pieces.model(SP)
    for text in ("", " a  b ", "x", "Ünïcödé ▁ 😀", "\x00"):
        ids = sp.encode(text)
        assert m.decode(ids) == sp.decode(ids)


def test_pieces_of_long_words():
    """One word of a million characters, in seconds; long words of every kind against the library."""
    import sentencepiece

    sp, m, rng = sentencepiece.SentencePieceProcessor(model_file=SP), pieces.Pieces(SP, most=20_000), random.Random(8)
    some = [
        "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/") for _ in range(3000)), "a" * 5000, "ab" * 3000, "the" * 2000, "é" * 999, "=-" * 700,
        "".join(rng.choice("etaoinshrdlu") for _ in range(9000)), " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 120))) for _ in range(400)),
    ]
    for t, ids in zip(some, m.encode(some), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(t, num_threads=1), t[:30]
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=1_000_000))
    start = time.perf_counter()
    ids = m.encode([long])[0]
    assert time.perf_counter() - start < 60
    assert np.frombuffer(ids, "<u4").tolist() == sp.encode(long, num_threads=1)
    before = words.PART
    try:
        words.PART = 100
        assert [np.frombuffer(x, "<u4").tolist() for x in m.encode(some)] == [sp.encode(t, num_threads=1) for t in some]
    finally:
        words.PART = before


def test_pieces_that_cross_words():
    """A model whose pieces cross words has no words; the result is the same for one that does not need it."""
    import sentencepiece

    sp, m = sentencepiece.SentencePieceProcessor(model_file=SP), pieces.Pieces(SP)
    assert not m.crosses
    m.crosses = True
    for t in ("a b  c", "the quick brown fox " * 40, " x", "\n\n"):
        assert np.frombuffer(m.encode([t])[0], "<u4").tolist() == sp.encode(t, num_threads=1)


def test_language(spark):
    docs = frame(spark, [*TEXTS, *["der hund und die katze"] * 20, *["le chien et la souris"] * 20]).drop("lang")
    from pyspark.sql import functions as F

    told = docs.withColumn("lang", F.when(F.col("text").startswith("der hund"), "de").when(F.col("text").startswith("le chien"), "fr"))
    model = language.learn(told)
    out = {r["doc_id"]: r for r in language.predict(told, model).collect()}
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (0, 1, 2, 3, len(TEXTS) - 1))
    assert {r["lang_pred"] for r in out.values() if r["lang"]} == {"de", "fr"}
    assert all(r["lang_pred"] == r["lang"] for r in out.values() if r["lang"])
    assert out[5]["held_out"] == "x5"
    assert language.learn(told.limit(0)) is None
    assert {r["lang_pred"] for r in language.predict(told, None).collect()} == {"und"}
    assert language.predict(told.limit(0), model).count() == 0


def test_language_sends_no_text_back(spark):
    """Python workers return names and scores alone, and each text is told once though the result is filtered."""
    rows = [(i, f"der hund und die katze {i} " * 400, "de") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    out = language.predict(docs, language.fit(["de", "fr"] * 9, ["der hund", "le chien"] * 9)).filter("lang_pred = 'de' AND score >= 0.5")
    assert sorted(tuple(r)[:3] for r in out.collect()) == rows
    sent = {"pythonDataSent": 0, "pythonDataReceived": 0}
    nodes = [out._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        for k in sent:
            if node.metrics().contains(k):
                sent[k] += node.metrics().apply(k).value()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    size = sum(len(t) for _, t, _ in rows)
    assert size <= sent["pythonDataSent"] < 1.5 * size
    assert 0 < sent["pythonDataReceived"] < size / 20


def test_code_lengths():
    """Against a loop over bytes and contexts, with bytes that the sample never holds and a language that some contexts lack."""
    rng = random.Random(6)
    letters = {"x": "abc de\né", "y": "bcdf g日\x01", "z": "aaab "}
    langs = [rng.choice("xyz") for _ in range(40)]
    texts = ["".join(rng.choice(letters[x]) for _ in range(rng.randint(0, 40))) for x in langs]
    probes = [b"", b"a", "abc de é日本\x00".encode(), bytes(range(250, 256)), b"aaab aaab bcd", texts[0].encode(), texts[7].encode()]
    buf, offsets = np.frombuffer(b"".join(probes), np.uint8), np.cumsum([0, *map(len, probes)])
    for least in (1, 4):
        model = language.fit(langs, texts, None, least)
        got = language.code_lengths(buf, offsets, model)
        for i, t in enumerate(probes):
            for k, x in enumerate(model["names"]):
                want = brute.code_length(langs, texts, least, x, t)
                assert abs(got[i, k] - want) < 1e-4 * (1 + want), (t, x, got[i, k], want)
    # the most frequent contexts alone, and no more of them than are asked for
    assert len(language.fit(langs, texts, 20, 1)["cost"]) == 20 * model["symbols"]


def test_samples_are_bounded(spark):
    """Rows that repeat, ids with many texts and long texts do not make a sample larger."""
    rows = [(1, "same text", "a")] * 300 + [(2, f"text {i} " * 40, "a") for i in range(300)] + [(3, "long " * 20000, "b"), (4, None, "b"), (5, "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.sample(docs, 50, 5000).collect()
    by = {x: [r["text"] for r in got if r["lang"] == x] for x in "ab"}
    assert len(by["a"]) == len(set(by["a"])) <= 50 and sum(map(len, by["a"][:-1])) < 5000
    assert by["b"] == [("long " * 20000)[:5000]]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1)], "doc_id long, quality int")
    assert quality.learn(docs, labels, per_class=2, most_bytes=1000) is not None
    assert {0 <= r["score"] <= 1 for r in quality.score(docs, quality.learn(docs, labels)).collect()} == {True}
    clash = docs.withColumn("score", docs["lang"]).withColumn("letters", docs["lang"])
    assert quality.score(clash, None).columns == ["doc_id", "text", "lang", "letters", "score"]
    told = language.predict(clash, language.learn(docs))
    assert told.columns == ["doc_id", "text", "lang", "letters", "lang_pred", "score"] and told.filter("letters <> lang").count() == 0


def test_convolution():
    """Scores against a loop over chunks."""
    rng = np.random.default_rng(3)
    m = quality.fit([b"abcdefgh" * 4, b"zzz", b"hello there"] * 4, np.array([1, 0, 1] * 4), epochs=2)
    texts = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 7, 8, 9, 16, 17, 300)]
    got = quality.pooled(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), m) @ m["out"] + m["base"]
    for x, t in zip(got, texts, strict=True):
        assert abs(1 / (1 + np.exp(-float(x))) - brute.convolution(t, m, quality.STRIDE, quality.FILTERS)) < 1e-5


def test_code_lengths_do_not_depend_on_batches():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc de\né") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    model = language.fit(["x", "y"] * 20, texts, least=1)
    one = [language.code_lengths(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), model)[0] for t in texts]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    before = language.CHUNK
    try:
        for size in (before, 7):
            language.CHUNK = size
            assert np.allclose(language.code_lengths(buf, offsets, model), np.array(one))
    finally:
        language.CHUNK = before


def test_quality(spark):
    good = [f"A clean sentence number {i} about water and trees." for i in range(60)]
    bad = [f"$$$ !!! {i} ### %%% &&&" for i in range(60)]
    docs = bare(spark, [*TEXTS, *good, *bad])
    labels = spark.createDataFrame([(len(TEXTS) + i, int(i < 60)) for i in range(120)] + [(None, 1), (5, None), (len(TEXTS), 1)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    out = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in out.values())
    assert np.mean([out[len(TEXTS) + i] > out[len(TEXTS) + 60 + i] for i in range(60)]) == 1
    assert quality.learn(docs, labels.filter("quality = 1")) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_pooling_does_not_depend_on_batches():
    rng = np.random.default_rng(4)
    m = quality.fit([b"abcdefgh" * 4, b"zzz"] * 4, np.array([1, 0] * 4), epochs=1)
    texts = [rng.integers(0, 256, n, dtype=np.uint8) for n in (0, 1, 7, 8, 9, 100, 5000)]
    buf, offsets = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    whole = quality.pooled(buf, offsets, m)
    before = quality.BLOCKS
    try:
        quality.BLOCKS = 5
        assert np.allclose(quality.pooled(buf, offsets, m), whole, atol=1e-5)
    finally:
        quality.BLOCKS = before


def test_neighbours(spark):
    kind = "vec_id long, embedding array<float>, label int"
    rows = [(0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.5], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1), (7, [float("inf"), 1.0], 1),
            (None, [1.0, 1.0], 1), (2, [0.5, 0.5], 2), (40, [0.0, 0.0], 1), (8, [], 1)]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(spark.createDataFrame(rows, kind)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 1.0), (0, 3, 2, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 2, 0.5)]
    assert neighbours.nearest(spark.createDataFrame([], kind)).count() == 0
    more = spark.createDataFrame(rows, kind).selectExpr("*", "1 AS rank", "2 AS score", "3 AS dim", "4 AS block")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(more).orderBy("query_id", "rank").collect()] == got
    assert neighbours.nearest(spark.createDataFrame([(0, [1.0], 1)], kind)).count() == 0


def test_windows_count_each_entry_once():
    """The candidates are those that collide on enough lines in the window that is reached."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8))
    v /= np.sqrt((v**2).sum(1, keepdims=True))
    index = neighbours.CollisionIndex(v, 1.0, 40)
    shadows, at = np.c_[v, np.zeros(len(v))] @ index.lines, np.c_[v[:20], np.zeros(20)] @ index.lines
    for q, found in enumerate(index.candidates(v[:20], 60, 0.5)):
        for step in range(100):
            hit = (np.abs(shadows - at[q]) <= 0.6 * 1.1**step).sum(1) >= 20
            if hit.sum() >= 60:
                break
        assert set(found) == set(np.flatnonzero(hit))


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_on_odd_tables(spark, stage, sf_dir):
    import corpus_pipeline as p

    name, run = p.STAGES[stage]
    docs = frame(spark, more=MORE)
    out = run(spark, docs, sf_dir)
    if name != "best_fit_packing":
        assert out.columns == p.COLUMNS
    rows = out.collect()
    assert run(spark, docs.limit(0), sf_dir).count() == 0
    if name == "simhash_dedup":
        # one row of each group: rows that repeat, one id with another text, and no id
        prints = {(d, t): brute.simhash(t) for d, t in [*enumerate(TEXTS), *((d, t) for d, t in MORE)]}
        root = brute.components(list(enumerate(prints.values())))
        groups = {}
        for k, row in enumerate(prints):
            groups.setdefault(root[k], []).append(row)
        got = [(r["doc_id"], r["text"]) for r in rows]
        assert len(got) == len(groups)
        for group in groups.values():
            (kept,) = [x for x in group if x in got or (x[1] is None and (x[0], "") in got)]
            assert kept[0] == min((d for d, _ in group if d is not None), default=None)
