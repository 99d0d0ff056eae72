"""The contracts again, as loops over Python values."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import xxhash

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def crc_mod(doc_id: int, mod: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % mod


def line_dedup(docs: list[tuple[int, str | None]], min_chars: int = 40, min_docs: int = 5) -> dict[int, tuple[int, int, str]]:
    lines = {d: (t or "").split("\n") for d, t in docs}
    key = lambda x: x.strip(BLANK).translate(LOWER)
    held = defaultdict(set)
    for d, ls in lines.items():
        for x in ls:
            if len(key(x)) >= min_chars:
                held[key(x)].add(d)
    out = {}
    for d, ls in lines.items():
        kept = [x for x in ls if len(h := held.get(key(x), ())) < min_docs or max(h) == d]
        out[d] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    return out


def suffix_dedup(docs: list[tuple[int, str | None]], length: int = 400) -> list[tuple[int, int, int, int, bytes]]:
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(docs, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        gone[len(t)] = False
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((d, len(t), int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone[: len(t)]].tobytes()))
    return out


def simhash(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints: list[tuple[int, int]], radius: int = 3) -> dict[int, int]:
    ids = sorted(prints)
    root = {d: d for d, _ in ids}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, fa) in enumerate(ids):
        for b, fb in ids[i + 1 :]:
            if (fa ^ fb).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d, _ in ids}


def check_packing(rows: list[dict], ids: dict[int, list[int]], capacity: int = 4096) -> int:
    """Whether rows pack all pieces of the documents' ids without gaps; the number of sequences."""
    want = set()
    for d, x in ids.items():
        for k, at in enumerate(range(0, len(x), capacity)):
            cut = x[at : at + capacity]
            want.add((d, k, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert len(rows) == len(want)
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def code_length(langs: list[str], texts: list[str], least: int, lang: str, text: bytes) -> float:
    """Bits of the text under the language's trees, by recursion over contexts."""
    data = [(x, b"\n\n\n" + t.encode()) for x, t in zip(langs, texts, strict=True)]
    counts = defaultdict(Counter)  # context and language: how often each byte follows
    every = Counter()
    for x, d in data:
        for i in range(3, len(d)):
            for order in range(4):
                counts[d[i - order : i], x][d[i]] += 1
                every[d[i - order : i]] += 1

    @lru_cache(maxsize=None)
    def p(ctx: bytes, b: int) -> float:
        seen = counts[ctx, lang]
        shorter = (lambda c: p(ctx[1:], c)) if ctx else (lambda c: 1 / 256)
        total, distinct = sum(seen.values()), len(seen)
        if not total:
            return shorter(b)
        rest = left(ctx)
        escape = distinct / (total + distinct) if rest > 0 else 0
        return seen[b] / total * (1 - escape) if b in seen else escape * shorter(b) / rest

    @lru_cache(maxsize=None)
    def left(ctx: bytes) -> float:
        return sum(p(ctx[1:], c) if ctx else 1 / 256 for c in range(256) if c not in counts[ctx, lang])

    padded, bits = b"\n\n\n" + text, 0.0
    for i in range(3, len(padded)):
        order = max(k for k in range(4) if not k or all(every[padded[i - j : i]] >= least for j in range(1, k + 1)))
        bits -= math.log2(p(padded[i - order : i], padded[i]))
    return bits


def convolution(text: bytes, m: dict, stride: int, filters: int) -> float:
    """The probability of the network, chunk by chunk; a chunk is two strides wide and zeros follow the text."""
    n = max(1, -(-len(text) // stride))
    data = text.ljust((n + 1) * stride, b"\0")
    best = np.zeros(filters)
    for k in range(n):
        chunk = data[k * stride : (k + 2) * stride]
        left = np.concatenate([m["embed"][b] for b in chunk[:stride]]).astype(float)
        right = np.concatenate([m["embed"][b] for b in chunk[stride:]]).astype(float)
        best = np.maximum(best, left @ m["left"] + right @ m["right"] + m["bias"])
    return 1 / (1 + math.exp(-(float(best @ m["out"]) + float(m["base"][0]))))


def fingerprint(text: str) -> tuple[str, list[int]]:
    """The sums of the lines' vectors, modulo 2^32, as digits; and the sketch: bits set in the pairs' hashes, and pairs."""
    dense, sketch = [0] * 16, [0] * 65
    for line in text.split("\n"):
        h = hashlib.sha512(line.encode()).digest()
        dense = [(a + int.from_bytes(h[4 * i : 4 * i + 4], "big")) % (1 << 32) for i, a in enumerate(dense)]
        words = re.findall(r"[^\x20\x09\x0B-\x0D]+", line)
        for i, w in enumerate(words):
            x = xxhash.xxh64_intdigest(w.encode(), seed=42)
            if i + 1 < len(words):
                x = xxhash.xxh64_intdigest(words[i + 1].encode(), seed=x)
            sketch = [c + (x >> b & 1) for b, c in enumerate(sketch[:64])] + [sketch[64] + 1]
    return "".join(f"{x % (1 << 32):08x}" for x in dense + sketch), sketch


def likeness(a: list[int], b: list[int]) -> float:
    x, y = ([2 * c - s[64] for c in s[:64]] for s in (a, b))
    both = sum(v * v for v in x) + sum(v * v for v in y)
    return max(0.0, 1 - sum((p - q) ** 2 for p, q in zip(x, y, strict=True)) / both) if both else 1.0
