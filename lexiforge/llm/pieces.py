"""SentencePiece encoding and decoding (byte-pair models) by suffix-array matching.

Where no piece of a model crosses the start of a word (checked as it is read), a text's ids are those of its words, and words
are encoded once; otherwise a text is one word. The new words of a batch are concatenated and indexed by a suffix array;
binary search finds each piece's range of occurrences; the occurrences are the edges of the lattice, sorted by position; and the
edges are relaxed: of a word's adjacent symbols, those whose union is the edge of the best score (then the leftmost) are
joined, until no edge joins two. Short words are relaxed together, long ones by a heap each.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexiforge.llm.suffix_dedup import suffix_array
from lexiforge.llm.words import WordMemory

MARK = "▁"
_WORDS, _GAP, _NEVER = re.compile(" *[^ ]+| +"), re.compile("(?<! ) "), re.compile("(?!)")
#: Words of more symbols are relaxed by a heap.
LONG = 48
codecs.register_error("piecewise", lambda e: ("�", e.start + 1))


class Pieces:
    """The pieces of a model file, and the ids of words seen so far. most: bytes for the words that are kept."""

    def __init__(self, path: str, most: int = 192 << 20) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.vocab_size()
        self.bytes_at = next(i for i in range(size) if m.is_byte(i))  # <0x00>; the others follow
        plain = [i for i in range(size) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        names = [m.id_to_piece(i).encode() for i in plain]
        order = sorted(range(len(plain)), key=names.__getitem__)
        self.names, self.ids = [names[i] for i in order], np.array([plain[i] for i in order])
        self.lengths = np.array([len(x) for x in self.names])
        self.wide = int(self.lengths.max())
        self.matrix = np.zeros((len(self.names), self.wide), np.uint8)
        for row, name in zip(self.matrix, self.names, strict=True):
            row[: len(name)] = np.frombuffer(name, np.uint8)
        score = np.array([m.get_score(i) for i in range(size)])
        self.rank = np.unique(-score, return_inverse=True)[1]  # 0 is the best score; equal scores share a rank
        self.surface = [b"" if m.is_control(i) else " ⁇ ".encode() if m.is_unknown(i) else bytes([i - self.bytes_at]) if m.is_byte(i) else m.id_to_piece(i).replace(MARK, " ").encode() for i in range(size)]
        self.marked = [x[:1] == b" " and not m.is_byte(i) and not m.is_unknown(i) for i, x in enumerate(self.surface)]
        # whether a mark stands behind another character in some piece
        self.crosses = any(MARK in m.id_to_piece(i).lstrip(MARK) for i in plain)
        self.memory = WordMemory(self._learn, most)

    def _occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges sorted by position: keys (position * (longest piece + 1) + length) and piece ids."""
        sa, _ = suffix_array(text)
        padded = np.r_[text, np.zeros(self.wide, np.uint8)]
        rows = np.lib.stride_tricks.as_strided(padded, (len(text) + 1, self.wide), (1, 1))
        inside = np.arange(self.wide) < self.lengths[:, None]
        ends = []
        for right in (False, True):  # the first suffix not below the piece, and the first beyond those that begin with it
            low, high = np.zeros(len(self.names), np.int64), np.full(len(self.names), len(sa))
            while (go := low < high).any():
                mid = (low + high) // 2
                got = rows[sa[np.minimum(mid, len(sa) - 1)]]
                off = (got != self.matrix) & inside
                at = off.argmax(1)
                where = np.arange(len(at))
                differ = off[where, at]
                less = np.where(differ, got[where, at] < self.matrix[where, at], right)
                low, high = np.where(go & less, mid + 1, low), np.where(go & ~less, mid, high)
            ends.append(low)
        many = ends[1] - ends[0]
        at = sa[np.repeat(ends[0] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())]
        # one number for position, length and piece sorts faster than places would
        edges = (at * (self.wide + 1) + np.repeat(self.lengths, many)) << 20 | np.repeat(self.ids, many)
        edges.sort()
        return edges >> 20, edges & ((1 << 20) - 1)

    def _relax(self, stop: np.ndarray, start: np.ndarray, rank: np.ndarray, keys: memoryview, ranks: memoryview) -> tuple[np.ndarray, np.ndarray]:
        """Join the symbols of one word, the best score first, then the leftmost; a heap holds the pairs."""
        n, none = len(start), np.iinfo(np.int64).max
        begin, end, now = start.tolist(), stop.tolist(), rank.tolist()
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [r * n + i for i, r in enumerate(now) if r != none]
        heapify(heap)

        def look(i: int) -> None:
            """The rank of joining symbol i with the next, from the sorted edges."""
            now[i] = none
            if (j := after[i]) >= 0 and (size := end[j] - begin[i]) <= self.wide:
                want = begin[i] * (self.wide + 1) + size
                at = bisect_left(keys, want)
                if at < len(keys) and keys[at] == want:
                    now[i] = ranks[at]
                    heappush(heap, now[i] * n + i)

        while heap:
            r, i = divmod(heappop(heap), n)
            if now[i] != r:
                continue  # one of the two has changed since
            j = after[i]
            end[i], after[i], now[j] = end[j], after[j], none
            if after[i] >= 0:
                before[after[i]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        kept, i = [], 0
        while i >= 0:
            kept.append(i)
            i = after[i]
        return np.array([begin[i] for i in kept]), np.array([end[i] for i in kept])

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Encode words (blanks as marks), about two megabytes at a time: the search for all pieces costs the same for any size."""
        out, part, size = {}, [], 0
        for w in words:
            part.append(w)
            size += len(w)
            if size > 2 << 20:
                out |= self._encode(part)
                part, size = [], 0
        return out | self._encode(part) if part else out

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        data = [w.replace(" ", MARK).encode("utf-8", "replace") for w in words]
        text = np.frombuffer(b"\0".join(data), np.uint8)
        keys, ids = self._occurrences(text)
        none, unit = np.iinfo(np.int64).max, self.wide + 1

        def edge(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
            """The piece from start to stop, or -1."""
            size = stop - start
            want = start * unit + np.minimum(size, self.wide)
            at = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
            return np.where((keys[at] == want) & (size <= self.wide), ids[at], -1) if len(keys) else np.full(len(start), -1)

        def merge(start: np.ndarray, stop: np.ndarray, word: np.ndarray) -> np.ndarray:
            """The rank of joining each symbol with the next of its word."""
            out = np.full(len(start), none)
            pair = np.flatnonzero(word[1:] == word[:-1])
            found = edge(start[pair], stop[pair + 1])
            out[pair] = np.where(found >= 0, self.rank[found], none)
            return out

        base = np.cumsum([0, *(len(d) + 1 for d in data)])[:-1]
        start = np.flatnonzero((text & 0xC0) != 0x80)  # characters
        gap = np.zeros(len(text), bool)
        gap[base[1:] - 1] = True
        stop = np.r_[start[1:], len(text)]
        keep = ~gap[start]
        start, stop = start[keep], stop[keep]
        word = np.searchsorted(base, start, "right") - 1
        rank = merge(start, stop, word)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        many = np.bincount(word, minlength=len(words))
        if (many > LONG).any():
            ranks = memoryview(self.rank[ids])
            first = np.cumsum(many) - many
            for w in np.flatnonzero(many > LONG):
                at = slice(first[w], first[w] + many[w])
                a, b = self._relax(stop[at], start[at], rank[at], memoryview(keys), ranks)
                done.append((a, b, np.full(len(a), w)))
            short = many[word] <= LONG
            start, stop, word, rank = start[short], stop[short], word[short], rank[short]
        while len(start):
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, heads)
            size = np.diff(np.r_[heads, len(start)])
            active = np.repeat(best < none, size)
            if not active.all():
                done.append((start[~active], stop[~active], word[~active]))
                start, stop, word, rank = start[active], stop[active], word[active], rank[active]
                size, best = size[best < none], best[best < none]
                if not len(start):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            at = hit[np.r_[True, word[hit[1:]] != word[hit[:-1]]]]  # the leftmost of each word
            stop[at] = stop[at + 1]
            stay = np.ones(len(start), bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))
            start, stop, word, rank = start[stay], stop[stay], word[stay], rank[stay]
            for k in (at, at[at > 0] - 1):
                k1 = np.minimum(k + 1, len(start) - 1)
                found = np.where((word[k1] == word[k]) & (k1 > k), edge(start[k], stop[k1]), -1)
                rank[k] = np.where(found >= 0, self.rank[found], none)
        if not done:
            return {}
        start, stop, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(start, kind="stable")
        start, stop, word = start[order], stop[order], word[order]
        found = edge(start, stop)
        # a character without a piece becomes its bytes
        many = np.where(found >= 0, 1, stop - start)
        at = np.repeat(np.arange(len(start)), many)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out = np.where(found[at] >= 0, found[at], self.bytes_at + text[start[at] + nth].astype(np.int64)).astype("<u4")
        cuts = np.searchsorted(word[at], np.arange(len(words) + 1)) * 4
        raw, cuts = out.tobytes(), cuts.tolist()
        return {w: raw[a:b] for w, a, b in zip(words, cuts, cuts[1:], strict=False)}

    def _split(self, text: str) -> list[str]:
        return [text] if self.crosses else _WORDS.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        return self.memory.encode([" " + t.replace(MARK, " ") if t else "" for t in texts], self._split, _NEVER if self.crosses else _GAP)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD each. The blank that encoding puts in front is taken off."""
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "piecewise")
        return text[1:] if len(ids) and self.marked[ids[0]] else text


@lru_cache(maxsize=1)
def model(path: str) -> Pieces:
    """One for each worker process, so that tasks which follow each other share the words they know."""
    return Pieces(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_crc32 and decoded_sha256 for each row of docs (doc_id, text), over whole texts.

    Null and empty texts have no ids. Texts longer than four million characters are encoded in parts, words of any length in
    time that grows little faster than they. Repeated rows come back as often as they came; an empty table gives no rows. Other
    columns are not carried. decoded_sha256 is of the text that the ids decode to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for x in batches:
            for low in range(0, len(x), 1000):
                part = x.slice(low, 1000)
                data = m.encode([t or "" for t in part.column("text").to_pylist()])
                flat = np.frombuffer(b"".join(data), "<u4")
                offsets = np.cumsum([0, *(len(d) // 4 for d in data)])
                names = list(map(m.surface.__getitem__, flat.tolist()))
                bounds = offsets.tolist()
                text = [b"".join(names[a:b]).decode("utf-8", "piecewise").removeprefix(" ") for a, b in zip(bounds, bounds[1:], strict=False)]
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int32)))
                cols = [part.column("doc_id"), pa.array(np.diff(offsets)), ids, pa.array([zlib.crc32(d) for d in data], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in text])]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids", "ids_crc32", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, ids_crc32 long, decoded_sha256 string")
