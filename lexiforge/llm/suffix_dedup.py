"""Exact substring deduplication with suffix arrays: remove every byte covered by a 400-byte string that starts twice.

Suffix arrays of a whole corpus would have to be merged pair by pair, which grows with the square of the shards. So the
strings are dealt to shards by their content first. Each window (400 bytes) has an anchor: the leftmost of its 64-byte grams
with the least hash. Equal windows have equal anchors, so windows can only be equal within one anchor. Consecutive windows
of a document with the same anchor form a span. Then:

1. Spans are counted by anchor. An anchor that stands once cannot repeat and is left out; nothing else is decided by counts.
2. Of every other anchor the distinct spans are fetched, two places of a span that has several, and dealt to shards. Two
   places of one span are compared byte by byte. The distinct spans of an anchor that has more than one go into the
   shard's suffix array, built by Larsson-Sadakane refinement, with common prefixes by Kasai's rule; windows whose
   suffixes share 400 bytes are equal.
3. An anchor with many spans is dealt to several shards. Those report their distinct windows as digests in sorted arrays, and
   equal windows of different shards are found by binary search.
4. Covered spans are joined back to all documents that hold them, which lose the bytes.

A second, shorter length (passage) can be looked for by the same arrays; it is reported and not cut. Passages can be told by
words, too (words): a document without such a string is searched for runs of over so many words that another document holds
byte for byte. Their windows have fewer than `passage` bytes and are dealt by the least hash of eight words; counts of that
and a bitmap of fixed size leave out what stands once, equal windows are found by their digests. Without `passage` such runs
are cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.arrow_text import raw
from lexiforge.llm.common import free, fresh, partitions, spool, written

LENGTH, PASSAGE, GRAM, CHUNK = 400, 320, 64, 1 << 19
_TABLE = np.random.default_rng(20240).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
RECORD = "k1 long, k2 long, anchor long, span long, start int, m int, size int, off int"


# ---- anchors ----------------------------------------------------------------------------------------------------


def _gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram (a power of two) bytes from each position on."""
    x, width = _TABLE[buf], 1
    while width < gram:
        x = x[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + x[width:]
        width *= 2
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def spans(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, reach: int = 0) -> dict[str, np.ndarray]:
    """Spans of the texts in buf: text (index), start (byte in it), m (windows), size (bytes), off (the anchor's place), anchor and span (hashes).

    Windows have `length` bytes; a span's bytes go on for `reach` (at least length) from its last window, or to the text's end.
    """
    import xxhash

    n, reach = len(offsets) - 1, max(reach, length)
    pieces: list[tuple[int, int, int, int]] = []  # text, first byte, last byte of windows, last byte
    for i in np.flatnonzero(np.diff(offsets) >= length).tolist():
        a, b = int(offsets[i]), int(offsets[i + 1])
        pieces += [(i, at, min(b, at + CHUNK + length - 1), min(b, at + CHUNK + reach - 1)) for at in range(a, b - length + 1, CHUNK)]
    kinds = {"text": np.int64, "start": np.int64, "m": np.int32, "size": np.int32, "off": np.int32, "anchor": np.uint64, "span": np.uint64}
    out: dict[str, list] = {k: [np.zeros(0, t)] for k, t in kinds.items()}
    digest = xxhash.xxh3_64_intdigest
    at = 0
    while at < len(pieces):
        group, size = [], 0
        while at < len(pieces) and (not group or size + pieces[at][3] - pieces[at][1] <= CHUNK):
            group.append(pieces[at])
            size += pieces[at][3] - pieces[at][1]
            at += 1
        whole = np.concatenate([buf[a:b] for _, a, _, b in group]) if len(group) > 1 else np.ascontiguousarray(buf[group[0][1] : group[0][3]])
        begins = np.cumsum([0, *(b - a for _, a, _, b in group)])
        stop_at = begins[:-1] + np.array([c - a for _, a, c, _ in group])
        g = _gram_hashes(whole, gram)
        low = np.uint64((1 << 20) - 1)
        least = _window_min((g & ~low) | np.arange(len(g), dtype=np.uint64), length - gram + 1) & low
        valid = np.zeros(len(least) + 1, np.int8)  # a change of +1 where windows begin in a text, -1 where they end
        valid[begins[:-1]] += 1
        ends = stop_at - length + 1
        valid[ends] -= 1
        valid = np.cumsum(valid[:-1]).astype(bool)
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
        starts = np.flatnonzero(new)
        owner = np.searchsorted(begins, starts, "right") - 1
        stops = np.minimum(np.r_[starts[1:], len(least)], ends[owner])
        last = np.minimum(stops + reach - 1, begins[owner + 1])
        view = memoryview(whole)
        out["span"].append(np.fromiter((digest(view[a:b]) for a, b in zip(starts.tolist(), last.tolist(), strict=True)), np.uint64, len(starts)))
        out["anchor"].append(g[least[starts].astype(np.int64)])
        out["m"].append((stops - starts).astype(np.int32))
        out["size"].append((last - starts).astype(np.int32))
        out["off"].append((least[starts].astype(np.int64) - starts).astype(np.int32))
        text = np.array([i for i, _, _, _ in group], np.int64)[owner]
        out["text"].append(text)
        out["start"].append(np.array([a for _, a, _, _ in group], np.int64)[owner] - offsets[text] + starts - begins[owner])
    return {k: np.concatenate(v) if n else np.zeros(0, kinds[k]) for k, v in out.items()}


def _records(batches: Iterator[pa.RecordBatch], length: int, reach: int) -> Iterator[pa.RecordBatch]:
    for x in batches:
        s = spans(*raw(x.column("text")), length, GRAM, reach)
        at = pa.array(s["text"])
        hashes = [pa.array(s[c].view(np.int64)) for c in ("anchor", "span")]
        yield pa.RecordBatch.from_arrays(
            [x.column("k1").take(at), x.column("k2").take(at), *hashes, *(pa.array(s[c].astype(np.int32)) for c in ("start", "m", "size", "off"))],
            names=["k1", "k2", "anchor", "span", "start", "m", "size", "off"],
        )
        pa.default_memory_pool().release_unused()


# ---- suffix arrays ----------------------------------------------------------------------------------------------


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks. Suffixes are sorted by their first eight bytes, then groups of equal ones are refined by the
    ranks of the suffixes h bytes on, h doubling, until each stands alone."""
    n = len(text)
    key, width = np.r_[text.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)], 1  # what lies past the end sorts first
    while width < 4:
        key = key[:-width] * np.uint64(1 << (9 * width)) + key[width:]  # nine bits a byte: seven bytes fit
        width *= 2
    key = key[: n + 3]
    key = key[:n] * np.uint64(1 << 27) + (key[3 : n + 3] & np.uint64((1 << 27) - 1)) if n else key[:0]
    # bytes i to i + 3, then i + 4 to i + 6, which are the last three of those from i + 3 on
    h = 7
    sa = np.argsort(key, kind="stable").astype(np.int32)
    sorted_key = key[sa]
    head = np.r_[True, sorted_key[1:] != sorted_key[:-1], True] if n else np.ones(1, bool)  # whether a place begins a group
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(head[:-1], np.arange(n, dtype=np.int32), 0))
    padded = np.zeros(n + 1, np.int32)  # rank + 1 of a suffix; 0 past the end
    while True:
        slot = np.flatnonzero(~(head[:-1] & head[1:]))  # places in sa that are not settled
        if not len(slot):
            return sa, rank
        padded[:n] = rank
        padded[:n] += 1
        first = head[slot]
        two = first & head[slot + 2 - (slot + 2 > n)] & (slot + 1 < n)  # groups of two need no sort
        p = slot[two]
        a, b = sa[p], sa[p + 1]
        x, y = padded[np.minimum(a + h, n)], padded[np.minimum(b + h, n)]
        turn, settled = x > y, x != y
        second = np.where(turn, a, b)
        in_two = two.copy()
        in_two[1:] |= two[:-1]
        slot = slot[~in_two]
        at = sa[slot]
        ahead = padded[np.minimum(at + h, n)]
        order = np.argsort(rank[at].astype(np.int64) * (n + 1) + ahead, kind="stable")
        at, ahead = at[order], ahead[order]
        own = rank[at]
        sa[p], sa[p + 1] = np.where(turn, b, a), second
        head[p[settled] + 1] = True
        rank[second[settled]] = p[settled] + 1
        if len(slot):
            sa[slot] = at
            fresh_group = np.r_[True, (own[1:] != own[:-1]) | (ahead[1:] != ahead[:-1])]
            head[slot] = fresh_group
            rank[at] = slot[np.maximum.accumulate(np.where(fresh_group, np.arange(len(slot)), 0))]
        h *= 2


def common_prefixes(text: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """lcp[r]: what suffixes sa[r - 1] and sa[r] share; lcp[0] is 0.

    Kasai's rule: if the bytes before a suffix and before its neighbour are equal, its prefix is that of the suffix one
    to the left, less one. Only the others are compared, all at once, eight bytes a step.
    """
    n = len(text)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    i = np.arange(n)
    first = before < 0
    chain = np.zeros(n, bool)
    chain[1:] = ~first[1:] & ~first[:-1] & (before[1:] > 0) & (text[:-1] == text[np.maximum(before[1:] - 1, 0)])
    padded = np.r_[text, np.zeros(16, np.uint8)]
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (n + 8, 8), (1, 1))
    found = np.zeros(n, np.int64)
    at = np.flatnonzero(~chain & ~first)
    a, b = at.copy(), before[at]
    while len(at):
        differ = words[np.minimum(a, n)] != words[np.minimum(b, n)]
        some = differ.any(1)
        same = np.minimum(np.where(some, differ.argmax(1), 8), n - np.maximum(a, b))
        found[at] += same
        go = (same == 8)
        at, a, b = at[go], a[go] + 8, b[go] + 8
    last = np.maximum.accumulate(np.where(chain, 0, i))
    plcp = np.maximum(found[last] - (i - last), 0)
    plcp[first] = 0
    lcp[rank] = plcp
    return lcp


# ---- shards -----------------------------------------------------------------------------------------------------

#: Windows of a hot anchor are reported in blocks of so many neighbours, by their place against the anchor.
BLOCK = 8
FOUND = "level int, anchor long, span long, rel int, size int, d1 long, d2 long, windows binary"
_WINDOW = np.dtype([("rel", "<i4"), ("open", "u1"), ("digest", "<i8")])


def _repeats(x: pd.DataFrame, lengths: list[int]) -> Iterator[pd.DataFrame]:
    """The repeats of one shard, at each length: runs of bytes (size > 0), and of hot anchors blocks of distinct windows.

    All windows of a block hold the same core, the bytes from the last one's start to the first one's end. Blocks whose
    core no other span has need no look at their windows.
    """
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    first: dict[tuple[int, int], int] = {}
    row, copied = np.ones(len(x), bool), np.zeros(len(x), bool)
    data, anchors = x["bytes"].tolist(), x["anchor"].tolist()
    for i, at in enumerate(zip(anchors, x["span"].tolist(), strict=True)):
        k = first.setdefault(at, i)
        if k != i and data[k] == data[i]:  # the span stands in two places
            row[i], copied[k] = False, True
    x, copied = x[row].reset_index(drop=True), copied[row]
    alone = ~(x["anchor"].duplicated(keep=False) | x["hot"]).to_numpy()
    m, sizes = x["m"].to_numpy(), x["bytes"].str.len().to_numpy()
    for level, length in enumerate(lengths):  # an anchor with one span has no other that could hold its windows
        many = np.minimum(m, sizes - length + 1)
        on = alone & copied & (many > 0)
        yield pd.DataFrame({"level": level, "anchor": x["anchor"][on], "span": x["span"][on], "rel": 0, "size": many[on] + length - 1, "d1": 0, "d2": 0, "windows": None})
    x, copied = x[~alone].reset_index(drop=True), copied[~alone]
    if not len(x):
        return
    texts, m, sizes = x["bytes"].tolist(), x["m"].to_numpy(), x["bytes"].str.len().to_numpy()
    whole = np.frombuffer(b"".join(texts), np.uint8)
    base = np.cumsum(sizes) - sizes
    sa, rank = suffix_array(whole)
    lcp = common_prefixes(whole, sa, rank)
    anchor, span, hot, place = (x[c].to_numpy() for c in ("anchor", "span", "hot", "off"))
    for level, length in enumerate(lengths):
        many = np.clip(np.minimum(m, sizes - length + 1), 0, None)  # windows of this length
        text = np.repeat(np.arange(len(x)), many)
        if not len(text):
            continue
        rel = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        # suffixes that share `length` bytes are neighbours in suffix order: one class
        kind = np.cumsum(lcp < length)[rank[base[text] + rel]]
        twice = (np.bincount(kind) + np.bincount(kind, copied[text]) > 1)[kind]
        edge = np.r_[True, (text[1:] != text[:-1]) | (twice[1:] != twice[:-1])]
        heads = np.flatnonzero(edge)
        tails = np.r_[heads[1:], len(text)]
        on = twice[heads]
        heads, tails = heads[on], tails[on]
        t = text[heads]
        yield pd.DataFrame({"level": level, "anchor": anchor[t], "span": span[t], "rel": rel[heads], "size": tails - heads + length - 1, "d1": 0, "d2": 0, "windows": None})
        if not hot.any():
            continue
        _, one = np.unique(kind, return_index=True)
        one = np.sort(one[hot[text[one]]])
        if not len(one):
            continue
        windows = np.zeros(len(one), _WINDOW)
        windows["rel"], windows["open"] = rel[one], ~twice[one]
        windows["digest"] = np.fromiter((digest(texts[t][r : r + length]) for t, r in zip(text[one].tolist(), rel[one].tolist(), strict=True)), np.uint64, len(one)).view(np.int64)
        block = (place[text[one]] - rel[one]) // BLOCK
        starts = np.flatnonzero(np.r_[True, (text[one][1:] != text[one][:-1]) | (block[1:] != block[:-1])])
        cores = []
        for t, k in zip(text[one[starts]].tolist(), block[starts].tolist(), strict=True):
            at = int(place[t]) - BLOCK * k  # the last window of the block starts here
            cores.append(xxhash.xxh3_128_intdigest(texts[t][at : at + length - BLOCK + 1], seed=level))
        halves = np.array([(d >> 64, d & ((1 << 64) - 1)) for d in cores], np.uint64).reshape(-1, 2).view(np.int64)
        packed = [windows[a:b].tobytes() for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(one)], strict=True)]
        t = text[one[starts]]
        yield pd.DataFrame({"level": level, "anchor": anchor[t], "span": span[t], "rel": 0, "size": 0, "d1": halves[:, 0], "d2": halves[:, 1], "windows": packed})


def _shards(batches: Iterator[pd.DataFrame], lengths: list[int], most: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Rows come sorted by shard; whole shards of about `most` bytes together get one suffix array."""
    kept: list[pd.DataFrame] = []
    size = 0
    for x in batches:
        for low in range(0, len(x), 1000):
            part = x.iloc[low : low + 1000]
            kept.append(part)
            size += int(part["bytes"].str.len().sum())
            if size >= most:
                whole = pd.concat(kept, ignore_index=True)
                cut = int(np.searchsorted(whole["shard"].to_numpy(), whole["shard"].iloc[-1]))
                if cut:
                    yield from _repeats(whole[:cut].reset_index(drop=True), lengths)
                    kept = [whole[cut:]]
                    size = int(kept[0]["bytes"].str.len().sum())
    if kept:
        yield from _repeats(pd.concat(kept, ignore_index=True), lengths)


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each window of the blocks."""
    for x in batches:
        if len(x):
            windows = np.frombuffer(b"".join(x["windows"]), _WINDOW)
            at = np.repeat(np.arange(len(x)), x["windows"].str.len() // _WINDOW.itemsize)
            yield pd.DataFrame({**{c: x[c].to_numpy()[at] for c in ("level", "anchor", "span", "d1", "d2")}, "rel": windows["rel"], "open": windows["open"] > 0, "digest": windows["digest"]})


def _merge_shards(batches: Iterator[pd.DataFrame], lengths: list[int]) -> Iterator[pd.DataFrame]:
    """Windows that another shard holds as well; equal digests are in one partition. Found by binary search."""
    rows = [x for x in batches if len(x)]
    if not rows:
        return
    x = pd.concat(rows, ignore_index=True)
    digest = np.empty(len(x), [("a", np.int64), ("b", np.int64), ("c", np.int64)])
    digest["a"], digest["b"], digest["c"] = x["d1"], x["d2"], x["digest"]
    _, code = np.unique(digest, return_inverse=True)
    merged = np.sort(code)
    many = np.searchsorted(merged, code, "right") - np.searchsorted(merged, code, "left")
    x = x[(many > 1) & x["open"].to_numpy()]
    yield pd.DataFrame({"level": x["level"], "anchor": x["anchor"], "span": x["span"], "rel": x["rel"], "size": np.array(lengths, np.int32)[x["level"]]})


# ---- runs of words ----------------------------------------------------------------------------------------------

#: Words in a gram; bits of the map of anchors that stand twice, and of each of its parts.
WORDS, MAP, PART = 8, 26, 20
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse modulo 2^64, to the powers that a block of texts can need."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            _POWERS.append(np.cumprod(np.r_[np.uint64(1), np.full(CHUNK << 1, base, np.uint64)], dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def word_windows(buf: np.ndarray, offsets: np.ndarray, words: int, under: int) -> dict[str, np.ndarray]:
    """Windows of words + 1 words in fewer than `under` bytes: text (index), start, stop (bytes in it), anchor (hash)."""
    out: dict[str, list] = {k: [np.zeros(0, t)] for k, t in (("text", np.int64), ("start", np.int64), ("stop", np.int64), ("anchor", np.uint64))}
    pieces: list[tuple[int, int, int, int, int]] = []  # text, first byte, last byte, first and last start of windows
    for i in np.flatnonzero(np.diff(offsets) > 2 * words).tolist():
        a, b = int(offsets[i]), int(offsets[i + 1])
        pieces += [(i, max(a, at - 1), min(b, at + CHUNK + under + 1), at, min(b, at + CHUNK)) for at in range(a, b, CHUNK)]
    up, down = _powers()
    gap, at = np.full(1, 10, np.uint8), 0
    while at < len(pieces):
        group, size = [], 0
        while at < len(pieces) and (not group or size + pieces[at][2] - pieces[at][1] < CHUNK):
            group.append(pieces[at])
            size += pieces[at][2] - pieces[at][1] + 1
            at += 1
        whole = np.concatenate([x for _, a, b, _, _ in group for x in (gap, buf[a:b])] + [gap])
        begins = np.cumsum([1, *(b - a + 1 for _, a, b, _, _ in group)])[:-1]
        inside = np.r_[(whole != 32) & ((whole < 9) | (whole > 13)), False]
        s, e = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1, np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        if len(s) <= words:
            continue
        sums = np.r_[np.uint64(0), np.cumsum(_TABLE[whole] * up[: len(whole)], dtype=np.uint64)]
        g = (sums[e[WORDS - 1 :]] - sums[s[: len(s) - WORDS + 1]]) * down[s[: len(s) - WORDS + 1]]
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
        low = np.uint64((1 << 20) - 1)
        least = (_window_min((g & ~low) | np.arange(len(g), dtype=np.uint64), words + 2 - WORDS) & low).astype(np.int64)
        first, last = s[: len(s) - words], e[words:]
        owner = np.searchsorted(begins, first, "right") - 1
        shift = np.array([x[1] for x in group], np.int64) - begins  # from a place in the block to one in buf
        start, stop = first + shift[owner], last + shift[owner]
        lows, highs, ends = (np.array([x[k] for x in group], np.int64)[owner] for k in (3, 4, 2))
        on = np.flatnonzero((last - first < under) & (start >= lows) & (start < highs) & (stop <= ends))
        text = np.array([x[0] for x in group], np.int64)[owner[on]]
        out["text"].append(text)
        out["start"].append(start[on] - offsets[text])
        out["stop"].append(stop[on] - offsets[text])
        out["anchor"].append(g[least[on]])
    return {k: np.concatenate(v) for k, v in out.items()}


def _word_anchors(batches: Iterator[pa.RecordBatch], words: int, under: int) -> Iterator[pa.RecordBatch]:
    for x in batches:
        w = word_windows(*raw(x.column("text")), words, under)
        new = np.r_[True, (w["anchor"][1:] != w["anchor"][:-1]) | (w["text"][1:] != w["text"][:-1])][: len(w["text"])]
        pairs = np.unique(np.rec.fromarrays([w["text"][new], w["anchor"][new]], names="text,anchor"))
        ends = np.searchsorted(pairs["text"], np.arange(len(x) + 1)).astype(np.int32)
        some = pa.array(np.diff(ends) > 0)
        anchors = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(pairs["anchor"]).view(np.int64)))
        yield pa.RecordBatch.from_arrays([x.column("k1"), x.column("k2"), anchors], names=["k1", "k2", "anchors"]).filter(some)
        pa.default_memory_pool().release_unused()


def _word_digests(batches: Iterator[pa.RecordBatch], words: int, under: int, bitmap) -> Iterator[pa.RecordBatch]:  # noqa: ANN001  a broadcast
    import xxhash

    bits = np.frombuffer(bitmap.value, np.uint8)
    for x in batches:
        buf, offsets = raw(x.column("text"))
        w = word_windows(buf, offsets, words, under)
        slot = w["anchor"] & np.uint64((1 << MAP) - 1)
        on = (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
        text, start, stop = (w[k][on] for k in ("text", "start", "stop"))
        view, at = memoryview(np.ascontiguousarray(buf)), offsets[text]
        digests = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip((at + start).tolist(), (at + stop).tolist(), strict=True)), np.uint64, len(text))
        rows = pa.array(text)
        yield pa.RecordBatch.from_arrays(
            [*(x.column(c).take(rows) for c in ("u", "k1", "k2")), pa.array(digests.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))],
            names=["u", "k1", "k2", "digest", "start", "stop"],
        )
        pa.default_memory_pool().release_unused()


def _map_part(x: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(1 << PART, np.uint8)
    bits[x["slot"].to_numpy() & ((1 << PART) - 1)] = 1
    return pd.DataFrame({"part": x["part"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


def _word_runs(own: DataFrame, covered: DataFrame | None, words: int, under: int, level: int) -> DataFrame:
    """k1, k2 and runs, of that level, of the documents that covered lacks (None: of all) and that share over so many words with another."""
    spark = own.sparkSession
    anchors = own.mapInArrow(lambda it: _word_anchors(it, words, under), "k1 long, k2 long, anchors array<long>")
    if covered is None:
        dealt = anchors.select(F.lit(True).alias("asks"), F.explode("anchors").alias("anchor"))
    else:
        known = covered.select("k1", "k2", F.lit(True).alias("known"))
        dealt = anchors.join(known, ["k1", "k2"], "left").select(F.col("known").isNull().alias("asks"), F.explode("anchors").alias("anchor"))
    often = dealt.groupBy("anchor").agg(F.count("*").alias("n"), F.max("asks").alias("asks")).filter("n > 1 AND asks")
    slots = often.select(F.expr(f"anchor & {(1 << MAP) - 1}").alias("slot")).distinct().withColumn("part", F.shiftright("slot", PART))
    whole = bytearray(1 << (MAP - 3))
    for r in slots.groupBy("part").applyInPandas(_map_part, "part long, bits binary").collect():  # at most 2^26 bits
        whole[r["part"] << (PART - 3) : (r["part"] + 1) << (PART - 3)] = r["bits"]
    bitmap = spark.sparkContext.broadcast(bytes(whole))
    each = own.withColumn("u", F.monotonically_increasing_id())  # rows that repeat are documents each
    windows = spool(each.mapInArrow(lambda it: _word_digests(it, words, under, bitmap), "u long, k1 long, k2 long, digest long, start int, stop int"))
    shared = windows.groupBy("digest").agg(F.min("u").alias("a"), F.max("u").alias("b")).filter("a < b").select("digest")
    if covered is None:
        # written, so that Spark can split the rows of a digest that very many documents hold
        found = windows.join(spool(shared), "digest", "left_semi")
    else:
        found = windows.join(covered.select("k1", "k2"), ["k1", "k2"], "left_anti").join(shared, "digest", "left_semi")
    run = F.struct(F.lit(level).alias("level"), "start", "stop")
    return found.groupBy("k1", "k2").agg(F.collect_set(run).alias("runs"))


# ---- the operator -----------------------------------------------------------------------------------------------


def _joined(runs: list[dict]) -> list[list[int]]:
    """Runs of bytes as maximal stretches; runs that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted((r["start"], r["stop"]) for r in runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _cut(batches: Iterator[pa.RecordBatch], text_at: str, runs_at: str, names: list[str], passage: bool) -> Iterator[pa.RecordBatch]:
    """Take the runs of level 0 out of the texts; count the bytes of all runs for the passages."""
    for x in batches:
        texts, rows = x.column(text_at).to_pylist(), x.column(runs_at).to_pylist()
        n_bytes, n_removed, n_spans, sha, kept_texts, shared = [], [], [], [], [], []
        for text, runs in zip(texts, rows, strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            gone = _joined([r for r in runs or () if r["level"] == 0])
            at, kept = 0, []
            for a, b in gone:
                kept.append(data[at:a])
                at = b
            rest = b"".join([*kept, data[at:]])
            n_bytes.append(len(data))
            n_removed.append(len(data) - len(rest))
            n_spans.append(len(gone))
            sha.append(hashlib.sha256(rest).hexdigest())
            kept_texts.append(rest.decode("utf-8", "ignore") if gone else text or "")
            shared.append(sum(b - a for a, b in _joined(runs or ())))
        cols = [pa.array(kept_texts, pa.string()) if n == text_at else x.column(n) for n in names]
        new = [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())]
        yield pa.RecordBatch.from_arrays([*cols, *new, *([pa.array(shared, pa.int64())] if passage else [])], names=[*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["n_passage"] if passage else [])])
        pa.default_memory_pool().release_unused()


def remove_repeats(docs: DataFrame, length: int = LENGTH, passage: int | None = None, most: int = 32, words: int | None = None, beside: bool = False) -> DataFrame:
    """docs with text less every repeated byte, and n_bytes, n_removed, n_spans, kept_sha256 of the remaining bytes.

    length: of the strings whose bytes go. passage: a shorter length to look for as well; n_passage is the number of
    the input's bytes in such strings (without it the column is absent). most: places of an anchor in one shard. words: where
    a document has no such string, n_passage is the number of its bytes in runs of over so many words (at least eight, parted by
    blanks and U+0009 to U+000D) that another document holds, of any length in bytes. Without passage the bytes of such runs go,
    from documents without a string of `length` or, with beside, from all.

    Where a cut splits a character, the text loses the rest of it (kept_sha256 is of the bytes). Null and empty texts are
    empty and lose nothing. A text of any length is looked at in pieces of half a megabyte that overlap; one text
    with its runs must fit into a worker. Repeated rows count as documents each, so they cover one another; rows need
    no unique id, nor any. An empty table gives no rows. Other columns pass through; columns with the new names
    are replaced.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["n_passage"] if passage else [])]
    docs = docs.drop(*new)
    spark = docs.sparkSession
    lengths = [length, passage] if passage else [length]
    shortest, reach = min(lengths), max(lengths)
    k1, k2, runs_at = fresh(docs.columns, "k1", "k2", "runs")
    # 128 bits name a row by its id and text; rows that repeat are alike in all that follows
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({k1: F.xxhash64("doc_id", text), k2: F.xxhash64(F.lit(2), text, "doc_id")})
    own = keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), "text")
    with written() as made:
        every = spool(own.filter(F.octet_length("text") >= shortest).mapInArrow(lambda it: _records(it, shortest, reach), RECORD))
        # partial sums come first, so an anchor that a third of all documents hold is one row of each task here; the table is
        # written, so that both sides of the join are dealt anew and Spark can split a hot anchor's rows
        often = spool(every.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("anchor"))
    records = spool(every.join(often, "anchor", "left_semi"))
    free(spark, made)
    where = F.struct("k1", "k2", "start")
    spans_of = records.groupBy("anchor", "span").agg(F.count("*").alias("n"), F.min(where).alias("first"), F.max(where).alias("last"), *[F.max(c).alias(c) for c in ("m", "size", "off")])
    counted = spool(spans_of)
    places = spool(counted.groupBy("anchor").agg(F.sum(F.least("n", F.lit(2))).alias("k")))
    two = F.when(F.col("n") > 1, F.array(F.struct(F.lit(0).alias("nth"), F.col("first").alias("at")), F.struct(F.lit(1).alias("nth"), F.col("last").alias("at"))))
    two = two.otherwise(F.array(F.struct(F.lit(0).alias("nth"), F.col("first").alias("at"))))
    wanted = counted.join(places, "anchor").select("anchor", "span", "k", "m", "size", "off", F.explode(two).alias("x")).select("anchor", "span", "k", "m", "size", "off", "x.nth", "x.at.*")
    sub = F.pmod(F.col("span"), F.ceil(F.col("k") / most))
    wanted = wanted.withColumns({"hot": F.col("k") > most, "shard": F.xxhash64("anchor", sub)}).drop("k")
    cut = F.expr("substring(cast(text AS binary), start + 1, size)")
    fetched = wanted.join(own, ["k1", "k2"]).select("k1", "k2", "start", "nth", "shard", "anchor", "span", "m", "off", "hot", cut.alias("bytes"))
    fetched = fetched.dropDuplicates(["k1", "k2", "start", "nth", "anchor"])  # a row that repeats is fetched as often
    dealt = fetched.select("shard", "anchor", "span", "m", "off", "hot", "bytes").repartition(partitions(spark), "shard").sortWithinPartitions("shard")
    found = spool(dealt.mapInPandas(lambda it: _shards(it, lengths), FOUND))
    runs = found.filter("size > 0").select("level", "anchor", "span", "rel", "size")
    blocks = found.filter("size = 0").select("level", "anchor", "span", "d1", "d2", "windows")
    shared = blocks.groupBy("d1", "d2").agg(F.count("*").alias("n")).filter("n > 1").select("d1", "d2")
    across = blocks.join(shared, ["d1", "d2"]).mapInPandas(_unpack, "level int, anchor long, span long, d1 long, d2 long, rel int, open boolean, digest long")
    across = across.repartition(partitions(spark), "d1", "digest")
    runs = runs.unionByName(across.mapInPandas(lambda it: _merge_shards(it, lengths), "level int, anchor long, span long, rel int, size int"))
    # at most as many as a span has windows; written, so that both sides of the join are dealt anew and Spark can split a hot span's rows
    listed = spool(runs.groupBy("anchor", "span").agg(F.collect_set(F.struct("level", "rel", "size")).alias("runs")))
    ends = F.transform("runs", lambda r: F.struct(r["level"].alias("level"), (F.col("start") + r["rel"]).alias("start"), (F.col("start") + r["rel"] + r["size"]).alias("stop")))
    covered = records.join(listed, ["anchor", "span"]).groupBy("k1", "k2").agg(F.flatten(F.collect_set(ends)).alias(runs_at))
    if words:
        covered = spool(covered.withColumnRenamed(runs_at, "runs"))
        more = _word_runs(own, None if beside and not passage else covered, words, passage or length, 1 if passage else 0)
        covered = covered.unionByName(more)
        if beside and not passage:
            covered = covered.groupBy("k1", "k2").agg(F.flatten(F.collect_list("runs")).alias("runs"))
        covered = covered.withColumnRenamed("runs", runs_at)
    out = keyed.join(covered.select(F.col("k1").alias(k1), F.col("k2").alias(k2), runs_at), [k1, k2], "left").drop(k1, k2)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    kinds = dict(zip(["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage"], ["long", "long", "long", "string", "long"], strict=True))
    columns = ", ".join([columns, *(f"{c} {kinds[c]}" for c in new)])
    names = docs.columns
    return out.mapInArrow(lambda it: _cut(it, "text", runs_at, names, bool(passage)), columns)
