"""Document fingerprints as homomorphic multiset hashes, in DataFrame operations only.

A paragraph (a line) is hashed to a wide vector, a document's fingerprint is the sum of its paragraphs' vectors, each
component modulo 2^32. Sums do not depend on order, and a paragraph can be put in or taken out by adding or
subtracting its vector. The vector has two parts:

* 16 components: the 32-bit words of the paragraph's SHA-512. They decide equality.
* 65 components: how often each of 64 bits is set in the hashes of the paragraph's word pairs, and the number of pairs.
  Read as sums of +1 and -1 they are a tug-of-war sketch: the mean squared difference of two sketches
  estimates the squared distance of the two multisets of word pairs, hence a likeness.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import partitions, spool

WORD = (1 << 32) - 1
DENSE, BITS = 16, 64


def dense_lanes(text: Column) -> Column:
    """array<long>: the sum over paragraphs of SHA-512's sixteen words, modulo 2^32."""
    hashes = F.transform(F.split(text, "\n", -1), lambda p: F.sha2(p, 512))

    def lane(i: int) -> Column:
        word = lambda h: F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: (a + word(h)).bitwiseAND(F.lit(WORD)))

    return F.array(*[lane(i) for i in range(DENSE)])


def pair_hashes(text: Column) -> Column:
    """array<long>: a hash for each word and its successor in the same paragraph (none: null)."""
    words = lambda p: F.filter(F.split(p, "[ \\x09\\x0B-\\x0D]+", -1), lambda w: w != "")
    pairs = lambda ws: F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1)))
    # a lambda binds the words once, so that they are not split again for each pair
    once = lambda p: F.flatten(F.transform(F.array(words(p)), pairs))
    return F.flatten(F.transform(F.split(text, "\n", -1), once))


def _hex(lanes: Column) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(WORD)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 from two sketches array<long> (64 bit counts, then the number of pairs): 2ab / (aa + bb)."""
    signed = lambda x: F.transform(F.slice(x, 1, BITS), lambda v: (2 * v - F.get(x, F.lit(BITS))).cast("double"))
    square = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    off = square(F.zip_with(signed(a), signed(b), lambda x, y: x - y))
    both = square(signed(a)) + square(signed(b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - off / F.nullif(both, F.lit(0.0))))


def _cuts(docs: DataFrame, n: int) -> list[int]:
    """n - 1 quantiles of the ids at most, ascending: where to cut the order into ranges of even row counts. An id with many rows repeats."""
    at = [i / n for i in range(1, n)]
    if not at:
        return []
    return sorted(docs.agg(F.percentile_approx("doc_id", at, 20 * n).alias("b")).first()["b"] or [])


def _below(value: Column, cuts: list[int], same: bool) -> Column:
    """How many cuts lie below the value (same: or are equal to it), by a search in two steps."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    under = (lambda b: b <= value) if same else (lambda b: b < value)
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    first = F.size(F.filter(longs(b[-1] for b in blocks), under))
    inner = F.get(F.array(*[longs(b) for b in blocks]), first)
    return first * step + F.coalesce(F.size(F.filter(inner, under)), F.lit(0))


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text, next_text, and bucket and rn, which together name the row.

    The next document is the one before it by doc_id; after the last comes the first. Rows of one id, and rows without
    an id, which come last, are ordered by a hash of the text. Rows are dealt to ranges of that order, so an id with
    very many rows has several; the first row of the following range stands at the end of each as a guest (guest = true),
    so that no window ever spans all rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"))
    cuts = _cuts(docs, ranges)
    share = F.col("h") / F.lit(2.0**64) + 0.5
    low, high = (_below(F.col("doc_id"), cuts, same) for same in (False, True))
    # an id that several cuts name is split among them by the hash
    bucket = F.when(F.col("doc_id").isNull(), F.floor(share * ranges).cast("int") - ranges - 1).otherwise(low + F.floor(share * (high - low)).cast("int"))
    dealt = docs.withColumn("bucket", bucket)
    # the first row of each range, 2 x ranges at most; it is a guest of the range above, that of the highest one of the lowest
    tops = spool(dealt.groupBy("bucket").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "h")).alias("top")))
    every = Window.orderBy("bucket")
    host = F.coalesce(F.lead("bucket").over(every), F.first("bucket").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = tops.select("bucket", F.col("top.doc_id").alias("d"), F.col("top.h").alias("top"), host.alias("host"))
    mine = dealt.join(F.broadcast(heads), "bucket").filter((F.col("h") == F.col("top")) & F.col("doc_id").eqNullSafe(F.col("d")))
    # rows that are alike in id and text are one guest
    one = Window.partitionBy("host").orderBy("h")
    mine = mine.withColumn("k", F.row_number().over(one)).filter("k = 1").select("doc_id", "text", "h", F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    rows = dealt.withColumn("guest", F.lit(False)).unionByName(mine)
    return rows.withColumns({"next_text": F.lead("text").over(order), "rn": F.row_number().over(order)})


#: Whole words of a row that are carried to its sums: SHA-512's sixteen and SHA-256's eight, two to a number.
_CARRIED = (DENSE + 8) // 2


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): its fingerprint, its edited text's, and the likenesses the contract asks for.

    Null texts are empty; an empty table gives no rows; a single document is its own successor. Rows without a doc_id come
    after all others, rows that repeat an id stand next to one another. Texts of any length are hashed whole; one row's
    text, the next one's and their words must fit into a task. Other columns of docs are not carried. ranges: into how
    many parts the order is cut; it changes no result.
    """
    n = ranges or max(64, min(4096, 4 * partitions(docs.sparkSession)))
    rows = with_next(docs, n)
    half = F.floor(F.length("text") / 2).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.length("text") - half)
    edited = F.concat(kept, F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), edited.alias("t"))))
    sided = rows.select("bucket", "rn", "doc_id", "guest", sides.alias("s")).select("bucket", "rn", "doc_id", "guest", "s.side", "s.t")
    sided = sided.filter(~F.col("guest") | (F.col("side") == 0))
    hexed = F.sha2(F.col("t"), 256)
    whole = F.concat(dense_lanes(F.col("t")), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(hexed, 8 * i + 1, F.lit(8)), 16, 10).cast("long")))
    paired = lambda w: F.transform(F.sequence(F.lit(0), F.lit(_CARRIED - 1)), lambda i: F.shiftleft(F.get(w, 2 * i), 32).bitwiseOR(F.get(w, 2 * i + 1)))
    sided = sided.select("bucket", "rn", "doc_id", "guest", "side", F.length("t").cast("long").alias("n_chars"), whole.alias("w"), pair_hashes(F.col("t")).alias("hs"))
    sided = sided.withColumn("w", paired(F.col("w")))
    own = ["doc_id", "guest", "n_chars", *[f"w{i}" for i in range(_CARRIED)]]
    sided = sided.select("bucket", "rn", "side", *own[:3], *[F.get("w", F.lit(i)).alias(f"w{i}") for i in range(_CARRIED)], "hs")
    sided = sided.select("bucket", "rn", "side", *own, F.explode_outer("hs").alias("h"))
    two = (1 << 32) | 1
    # bits i and i + 32 of a hash in one sum: each half counts to 2^31
    sums = [F.coalesce(F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(two))), F.lit(0).cast("long")).alias(f"c{i}") for i in range(32)]
    fixed = ["bucket", "rn", "side"]
    # rows are dealt by bucket already, so this needs no exchange
    agg = sided.groupBy(*fixed).agg(*sums, F.count("h").alias("n"), *[F.max(c).alias(c) for c in own])
    low, high = lambda c: F.col(c).bitwiseAND(F.lit(WORD)), lambda c: F.shiftrightunsigned(c, 32)
    sketch = F.array(*[low(f"c{i}") for i in range(32)], *[high(f"c{i}") for i in range(32)], F.col("n"))
    words = F.array(*[part(f"w{i}") for i in range(_CARRIED) for part in (high, low)])
    flat = agg.select(*fixed, "doc_id", "guest", "n_chars", sketch.alias("sketch"), words.alias("w"))
    flat = flat.select(*fixed, "doc_id", "guest", "n_chars", "sketch", F.concat(_hex(F.slice("w", 1, DENSE)), _hex(F.col("sketch"))).alias("fp"), _hex(F.slice("w", DENSE + 1, 8)).alias("sha"))
    order = Window.partitionBy("bucket").orderBy("rn", "side")
    # side 1 of a row stands right after its side 0, then comes side 0 of the next row
    ahead = lambda c, k: F.lead(c, k).over(order)
    out = flat.select(
        "doc_id", "n_chars", "side", "guest", F.col("fp").alias("fingerprint"), "sketch",
        ahead("sha", 1).alias("edited_sha256"), ahead("fp", 1).alias("edited_fingerprint"), ahead("sketch", 1).alias("edited_sketch"), ahead("sketch", 2).alias("next_sketch"),
    )
    out = out.filter((F.col("side") == 0) & ~F.col("guest"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def combine(a: str, b: str, sign: int = 1) -> str:
    """The fingerprint of two documents' paragraphs together (sign 1), or of the first without the second's (-1)."""
    words = zip(*[[int(x[i : i + 8], 16) for i in range(0, len(x), 8)] for x in (a, b)], strict=True)
    return "".join(f"{(p + sign * q) & WORD:08x}" for p, q in words)


def fold(items: list[str]) -> str:
    return reduce(combine, items)
