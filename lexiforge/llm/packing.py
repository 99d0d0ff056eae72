"""Best-fit packing of tokenised documents into sequences by bin completion.

Whatever the number of documents, a packing depends only on how many pieces there are of each length, so the search runs
on that histogram (at most `capacity` counters) and yields patterns with multiplicities. Best-fit decreasing gives the
incumbent. If it needs more sequences than the lower bound, branch and bound looks for better: around the longest piece that
is left it enumerates the fillings that no other one dominates, least waste first, and prunes what already wastes
too much to beat the incumbent. Pieces then find their pattern by their rank among pieces of equal length.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import partitions, salt_of, spool
from lexiforge.llm import words
from lexiforge.llm.words import WordMemory

CAPACITY, END = 4096, 1
Runs = tuple[tuple[int, int], ...]  # (length, how many), longest first


# ---- packing of a histogram -------------------------------------------------------------------------------------


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Runs, int]]:
    """Best-fit decreasing on counts of lengths: patterns and how many sequences follow each."""
    rooms: dict[int, list[tuple[Runs, int]]] = {}
    order: list[int] = []  # the rooms that have sequences, ascending

    def put(room: int, runs: Runs, n: int) -> None:
        if n:
            if room not in rooms:
                rooms[room] = []
                insort(order, room)
            rooms[room].append((runs, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(order, length)
            if k == len(order):
                break
            room = order[k]
            fits = room // length  # best fit comes back to the same sequence until it is too full
            runs, n = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], order[k]
            whole = min(n, left // fits)
            put(room - fits * length, (*runs, (length, fits)), whole)
            left -= whole * fits
            if whole < n:
                if left:
                    put(room - left * length, (*runs, (length, left)), 1)
                    whole, left = whole + 1, 0
                put(room, runs, n - whole)
        if left:
            fits = capacity // length
            put(capacity - fits * length, ((length, fits),), left // fits)
            if left % fits:
                put(capacity - left % fits * length, ((length, left % fits),), 1)
    return [x for room in order for x in rooms[room]]


def dominates(a: Runs, b: Runs) -> bool:
    """Whether b's pieces fit into places of the sizes of a's pieces, so that a is never the worse filling."""
    rooms = sorted(x for x, k in a for _ in range(k))
    for x, k in b:
        for _ in range(k):
            at = next((i for i, r in enumerate(rooms) if r >= x), None)
            if at is None:
                return False
            rooms[at] -= x
            rooms.sort()
    return True


def fillings(counts: dict[int, int], room: int, slack: int, most: int | None = 12, steps: int | None = 3000) -> list[Runs]:
    """Undominated fillings of the room that waste `slack` at most, least waste first.

    most: how many come back; steps: how many partial ones are looked at (None: all).
    """
    sizes = sorted((x for x, n in counts.items() if n and x <= room), reverse=True)
    if not sizes:
        return [()] if room <= slack else []
    rest = [0]  # what the sizes from a place on hold together
    for x in reversed(sizes):
        rest.append(rest[-1] + x * counts[x])
    rest.reverse()
    rising = sizes[::-1]
    found: list[tuple[int, Runs]] = []
    stack: list[tuple[int, int, Runs]] = [(0, room, ())]
    steps = math.inf if steps is None else steps
    while stack and steps > 0 and (most is None or len(found) < 4 * most):
        steps -= 1
        i, left, runs = stack.pop()
        i = max(i, len(sizes) - bisect_right(rising, left))
        if left - rest[i] > slack:
            continue
        if i == len(sizes):
            found.append((left, runs))
            continue
        x = sizes[i]
        if left < 2 * sizes[-1]:  # room for one more: the largest that fits dominates the others
            if left - x <= slack:
                found.append((left - x, (*runs, (x, 1))))
            continue
        top = min(counts[x], left // x)
        stack += [(i + 1, left - k * x, (*runs, (x, k)) if k else runs) for k in range(top + 1)]
    found.sort(key=lambda f: (f[0], [(-x, -k) for x, k in f[1]]))
    out: list[Runs] = []
    for _, runs in found:
        if sum(k for _, k in runs) > 64 or not any(dominates(a, runs) for a in out if sum(k for _, k in a) <= 64):
            out.append(runs)
    return out[:most]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The least number of sequences by area, with pieces that cannot share a sequence counted apart, at every threshold."""
    sizes = sorted(x for x, n in counts.items() if n)
    many = np.r_[0, np.cumsum([counts[x] for x in sizes])].astype(object)
    area = np.r_[0, np.cumsum([x * counts[x] for x in sizes])].astype(object)
    half = bisect_right(sizes, capacity // 2)
    best = -(-int(area[-1]) // capacity)
    for k in range(half + 1):  # pieces below the k-th size are left out
        least = sizes[k] if k < half else capacity // 2
        alone = max(half, bisect_right(sizes, capacity - least))  # from here on nothing that is left in fits beside
        shared = area[half] - area[min(k, half)] - ((many[alone] - many[half]) * capacity - (area[alone] - area[half]))
        best = max(best, int(many[-1] - many[half]) + max(0, -(-int(shared) // capacity)))
    return best


def complete(counts: dict[int, int], capacity: int, target: int, nodes: float, most: int | None, steps: int | None) -> tuple[list[tuple[Runs, int]] | None, float]:
    """A packing into `target` sequences, or None; and the nodes that are left.

    A node fills the sequence of the longest piece that is left. Each undominated filling is tried as often as it fits and
    then once less, down to none, and is not tried again below for the same longest piece, since packings that have it
    have been looked at. A branch whose waste goes beyond target x capacity is not entered.
    """
    left, used = dict(counts), 0
    slack = target * capacity - sum(x * n for x, n in counts.items())

    def options(banned: frozenset[Runs]) -> list[Runs]:
        first = max(left)
        others = dict(left)
        others[first] -= 1
        return [r for f in fillings(others, capacity - first, slack, most, steps) if (r := _merge(first, f)) not in banned]

    def put(runs: Runs, n: int) -> None:
        nonlocal slack, used
        for x, k in runs:
            left[x] = left.get(x, 0) - k * n
            if not left[x]:
                del left[x]
        slack -= n * (capacity - sum(x * k for x, k in runs))
        used += n

    if slack < 0:
        return None, nodes
    frames: list[list] = [[options(frozenset()), 0, 0, frozenset(), max(left)]]  # options, which, how often, banned, the longest piece
    while frames:
        frame = frames[-1]
        fills, at, n, banned, first = frame
        if n:  # what it led to has been looked at: once less
            put(fills[at], -1)
            frame[2] = n = n - 1
            if not n:
                frame[1] = at = at + 1
        if not n:
            if at == len(fills):
                frames.pop()
                continue
            runs = fills[at]
            waste = capacity - sum(x * k for x, k in runs)
            n = min([*(left.get(x, 0) // k for x, k in runs), *([slack // waste] if waste else [])])
            if n <= 0:
                frame[1] += 1
                continue
            put(runs, n)
            frame[2] = n
        nodes -= 1
        if left and len(left) <= 512:  # best fit may already do for the rest
            rest = best_fit(left, capacity)
            if used + sum(k for _, k in rest) <= target:
                return [*((f[0][f[1]], f[2]) for f in frames), *rest], nodes
        if not left:
            return [(f[0][f[1]], f[2]) for f in frames], nodes
        if nodes <= 0:
            return None, nodes
        longest = max(left)
        tried = banned | frozenset(fills[: frame[1] + 1]) if longest == first else frozenset()
        frames.append([options(tried), 0, 0, tried, longest])
    return None, nodes


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int | None = 20000, most: int | None = 12, steps: int | None = 3000) -> list[tuple[Runs, int]]:
    """Patterns and multiplicities that hold all pieces in as few sequences as the search finds.

    The incumbent is best fit's packing. Where the lower bound is below it, packings of that size are looked for, then
    of one more, and so on. nodes: how many nodes in all; most and steps: see fillings. With all three None the
    result is the least number of sequences, at any cost.
    """
    counts = {x: n for x, n in counts.items() if n}
    best = best_fit(counts, capacity)
    size = sum(n for _, n in best)
    target, left = lower_bound(counts, capacity), math.inf if nodes is None else nodes
    while target < size and left > 0:
        # half of what is left for each size, so that larger ones get their turn
        share = left if left == math.inf else max(1, left // 2)
        found, over = complete(counts, capacity, target, share, most, steps)
        left -= share - over if left != math.inf else 0
        if found:
            return found
        target += 1
    return best


def _merge(first: int, runs: Runs) -> Runs:
    return ((first, runs[0][1] + 1), *runs[1:]) if runs and runs[0][0] == first else ((first, 1), *runs)


# ---- tokens -----------------------------------------------------------------------------------------------------


def _class(kind: str, top: int = 0x180) -> str:
    return "".join(f"\\u{c:04x}" for c in range(top) if unicodedata.category(chr(c))[0] == kind)


#: Texts beyond these characters, and such as hold special tokens, go to the tokenizer as they are.
_ODD = re.compile("[İƀ-\U0010ffff\x1c-\x1f]|<\\|")
_SPACE = "\\t-\\r \\x85\\xa0"
_GAP = re.compile(f"[{_SPACE}]")
#: Blank, letter, number or other (0 to 3): of the characters that are not odd, and of single bytes.
_KIND = np.array([0 if _GAP.match(chr(c)) else {"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3) for c in range(0x180)], np.uint8)
_KIND_OF_BYTE = np.r_[_KIND[:128], np.zeros(128, np.uint8)]
#: What is encoded together, in characters; slots and ids of the table of short words.
BLOCK, SLOTS, POOL = 1 << 19, 1 << 19, 1 << 22
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def cut_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a lower-case text without odd characters start and stop; its UTF-8 bytes end with three line feeds at least.

    Words are 's 't 're 've 'm 'll 'd, runs of letters, single numbers, and runs of what else is not blank.
    """
    kind = _KIND_OF_BYTE[buf]
    two = np.flatnonzero(buf >= 0xC0)
    kind[two] = kind[two + 1] = _KIND[(buf[two].astype(np.int64) & 31) << 6 | buf[two + 1] & 63]
    new = np.r_[True, kind[1:] != kind[:-1]] | (kind == 2)
    new[two + 1] = False
    at = np.flatnonzero(new & (buf == 39))  # a run of one apostrophe and a letter is looked at; longer runs have no letter next
    at = at[kind[at + 1] == 1]
    a, b = buf[at + 1], buf[at + 2]
    one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
    more = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
    at, stop = at[one | more], (at + np.where(one, 2, 3))[one | more]
    new[at + 1] = False
    new[stop] |= kind[stop] == 1
    bounds = np.flatnonzero(new)
    on = np.flatnonzero(kind[bounds[:-1]])
    return bounds[on], bounds[on + 1]


class Encoder:
    """Ids of texts as bytes of little-endian unsigned 32-bit numbers.

    The tokenizer splits texts into words before it merges, so a word's ids are kept and looked up: those of up to 16 bytes in
    a table with one slot for each hash, where the whole word is compared, the others and those whose slot has another
    word in a dictionary. Words that are new are encoded together, and cut apart where a token ends a word. most: bytes
    for the words of the dictionary.
    """

    def __init__(self, path: str, most: int = 48 << 20) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # the model alone, for words that are already lower case and cut out
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.memory = WordMemory(self._learn, most)
        # of each slot: the word's bytes in two numbers, its size (0: none), where its ids are in the pool, how many
        self.low, self.high = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.size, self.place, self.many = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(POOL, "<u4"), 0

    def _slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        out = {}
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            ids = np.array(self.bare.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):  # never seen; each word by itself then
                out.update((w, self._slow(w.decode())) for w in part)
                continue
            data, start = ids.tobytes(), 0
            for word, stop in zip(part, (cuts * 4).tolist(), strict=True):
                out[word] = data[start:stop]
                start = stop
        return out

    def _block(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without odd characters, looked up together."""
        coded = [t.lower().encode() for t in texts]
        data = b"\n".join([*coded, b"\n" * 16])
        buf = np.frombuffer(data, np.uint8)
        start, stop = cut_words(buf)
        size = stop - start
        eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        low = eight[start] & _KEEP[np.minimum(size, 8)]
        high = eight[np.minimum(start + 8, len(data) - 8)] & _KEEP[np.clip(size - 8, 0, 8)]
        h = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high + size.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
        slot = (h >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        known = (self.low[slot] == low) & (self.high[slot] == high) & (self.size[slot] == size) & (size <= 16)
        place, many = self.place[slot].astype(np.int64), self.many[slot].astype(np.int64)
        pool, new = self.pool, np.flatnonzero(~known)
        if len(new):
            # one of each hash is looked up, and those that differ from the one of their hash
            _, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            one = new[first][back]
            apart = (low[new] != low[one]) | (high[new] != high[one]) | (size[new] != size[one]) | (size[new] > 16)
            asked = np.r_[new[first], new[apart]]
            ids = self.memory.each([data[a:b] for a, b in zip(start[asked].tolist(), stop[asked].tolist(), strict=True)])
            counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            found = np.frombuffer(b"".join(ids), "<u4")
            if self.used + len(found) > len(pool):  # the table begins anew; words that were found above stay in the old pool
                self.size[:] = 0
                self.pool, self.used = np.zeros(max(POOL, len(found)), "<u4"), 0
            base = self.used
            self.pool[base : base + len(found)] = found
            self.used += len(found)
            if self.pool is not pool:
                pool, base = np.r_[pool, found], len(pool)
            at = np.cumsum(counts) - counts
            back[apart] = len(first) + np.arange(apart.sum())
            place[new], many[new] = base + at[back], counts[back]
            kept = np.flatnonzero(size[asked] <= 16)
            _, last = np.unique(slot[asked[kept]], return_index=True)
            kept = kept[last]
            to, word = slot[asked[kept]], asked[kept]
            self.low[to], self.high[to], self.size[to] = low[word], high[word], size[word]
            self.place[to], self.many[to] = self.used - len(found) + at[kept], counts[kept]
        ends = np.cumsum(many)
        out = pool[np.repeat(place - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        begins = np.cumsum([0, *(len(c) + 1 for c in coded)])
        cuts = (4 * np.r_[0, ends][np.searchsorted(start, begins)]).tolist()
        return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        data = np.frombuffer("".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
        # a byte that odd characters have: U+0180 and beyond, U+0130, controls, or a less-than sign
        some = ((data >= 0xC6) | (data == 0xC4) | (data - np.uint8(0x1C) < 4) | (data == ord("<"))).any()
        out: list[bytes | None] = [self._slow(t) if some and _ODD.search(t) else None for t in texts]
        most = min(words.PART, BLOCK)
        group: list[int] = []
        size = 0
        for k, t in enumerate(texts):
            if out[k] is not None:
                continue
            if len(t) > most:
                out[k] = b"".join(self._block([p])[0] for p in words.parts(t, _GAP, most))
                continue
            if size + len(t) > most:
                for i, ids in zip(group, self._block([texts[i] for i in group]), strict=True):
                    out[i] = ids
                group, size = [], 0
            group.append(k)
            size += len(t)
        if group:
            for i, ids in zip(group, self._block([texts[i] for i in group]), strict=True):
                out[i] = ids
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each worker process, so that tasks which follow each other share the words they know."""
    return Encoder(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: a document's ids, then the end id, cut only where longer than the capacity. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for x in batches:
            for low in range(0, len(x), 500):
                part = x.slice(low, 500)
                rows = []
                ids = coder.encode([t or "" for t in part.column("text").to_pylist()])
                for doc, data in zip(part.column("doc_id").to_pylist(), ids, strict=True):
                    data += END.to_bytes(4, "little")
                    rows += [(doc, k, at // 4, len(cut) // 4, zlib.crc32(cut)) for k, at in enumerate(range(0, len(data), 4 * capacity)) for cut in (data[at : at + 4 * capacity],)]
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


# ---- placing ----------------------------------------------------------------------------------------------------


def _places(patterns: list[tuple[Runs, int]]) -> dict[str, np.ndarray]:
    """Where the pieces of a length go by rank: from `key` (length and first rank) on, k to a sequence, at an offset."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for runs, n in patterns:
        offset = 0
        for x, k in runs:
            rows.append((x << 44 | taken.get(x, 0), k, base, offset))
            taken[x] = taken.get(x, 0) + k * n
            offset += x * k
        base += n
    rows.sort()
    return {name: np.array([r[i] for r in rows], np.int64) for i, name in enumerate(("key", "k", "base", "offset"))}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, nodes: int | None = 20000, most: int | None = 12, steps: int | None = 3000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of docs (doc_id, text).

    nodes, most, steps: how far the search goes where best fit misses the lower bound (None: to the optimum).
    Null and empty texts are one piece, the end id. Texts are encoded in parts of four million characters. Repeated rows and
    rows without an id are packed as often as they come; an empty table gives no rows. Other columns of docs are not
    carried. The driver sees one counter for each length; the table of places that executors get has
    at most a few rows for each of them.
    """
    spark = docs.sparkSession
    salts = max(64, partitions(spark))
    cut = spool(pieces(docs, tokenizer, capacity).withColumn("salt", salt_of(F.struct("doc_id", "piece"), salts)))
    tally = spool(cut.groupBy("length", "salt").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(_places(bin_completion(counts, capacity, nodes, most, steps)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = tally.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    ranked = cut.withColumn("rank", rank).join(starts, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        for x in batches:
            length, rank = x.column("length").to_numpy(), x.column("rank").to_numpy()
            at = np.searchsorted(p["key"], length << 44 | rank, "right") - 1
            local = rank - (p["key"][at] & ((1 << 44) - 1))
            k = p["k"][at]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(x.column(c) for c in names), pa.array(p["base"][at] + local // k), pa.array(p["offset"][at] + local % k * length)], names=[*names, "sequence_id", "offset"]
            )

    return ranked.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")
