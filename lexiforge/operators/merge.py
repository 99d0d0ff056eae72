"""Record linkage: entries of several providers that mean one lemma become one entry.

Every rule of the form "the first in order of authority" is a minimum by a place, so all of it is aggregation with partial
sums; a place is (authority downwards, input order, index in the list).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.text import norm_headword, sense_key
from lexiforge.operators.rank import join_same, place_in_groups
from lexiforge.schema import POS_UNKNOWN

KEYS = ("lemma", "pos", "homonym")
FIELDS = ("ipa", "stress_mark", "syllabification", "audio_url", "audio_mime", "audio_attribution")


def group_keys(entries: DataFrame) -> DataFrame:
    """entries (headword, part_of_speech, homonym_index) and lemma, pos, homonym: the group they belong to.

    An entry without a homonym index takes the lowest one of its lemma and part of speech, or 1.
    """
    pos = F.when(F.col("part_of_speech") == POS_UNKNOWN, "").otherwise(F.coalesce("part_of_speech", F.lit("")))
    keyed = entries.withColumns({"lemma": norm_headword(F.col("headword")), "pos": pos})
    lowest = keyed.groupBy("lemma", "pos").agg(F.min("homonym_index").alias("__low"))
    out = join_same(keyed, lowest, ["lemma", "pos"])
    return out.withColumn("homonym", F.coalesce("homonym_index", "__low", F.lit(1)).cast("int")).drop("__low")


def place(*more: str) -> Column:
    return F.struct((-F.col("authority")).alias("a"), F.col("ord").alias("o"), *[F.col(m) for m in more])


def first_known(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS, unknown: str | None = POS_UNKNOWN) -> DataFrame:
    """keys, and of each column the first value in order of place that is known."""
    rows = rows.withColumn("__at", place())
    known = lambda c: F.col(c).isNotNull() & (F.col(c) != unknown) if dict(rows.dtypes)[c] == "string" else F.col(c).isNotNull()
    return rows.groupBy(*keys).agg(*[F.min_by(F.when(known(c), F.struct(F.col(c).alias("v")))["v"], F.when(known(c), F.col("__at"))).alias(c) for c in columns])


def merge_inflections(items: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """items (keys, at, form, tags, origin, confidence): one row a form and set of tags; attested wins, the place is the first one."""
    tag_key = F.concat_ws(",", F.array_sort("tags"))
    item = F.struct("form", "tags", "origin", "confidence")
    by = F.struct((F.col("origin") == "derived").alias("d"), F.col("at").alias("p"))
    out = items.groupBy(*keys, F.col("form").alias("__form"), tag_key.alias("__tags")).agg(F.min("at").alias("at"), F.min_by(item, by).alias("item"))
    return out.select(*keys, "at", "item.*")


def merge_pronunciations(items: DataFrame, keys: Sequence[str] = KEYS, fields: Sequence[str] = FIELDS) -> DataFrame:
    """items (keys, at, fields): one row a pronunciation; of each field the last value that is given."""
    name = F.coalesce("ipa", "audio_url", "stress_mark", F.to_json(F.struct(*fields)))
    last = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("at"))).alias(f) for f in fields]
    return items.groupBy(*keys, name.alias("__name")).agg(F.min("at").alias("at"), *last).drop("__name")


def merge_senses(items: DataFrame, keys: Sequence[str] = KEYS, short: int = 12) -> DataFrame:
    """items (keys, at, text, ...; at is unique): without later repeats of a long sense. Short ones all stay.

    One aggregate gives the places that stay, and items are read again by place: the sense's key is made once, and a short
    sense, whose own place is its key, meets no other.
    """
    key = sense_key(F.col("text"))
    # bound by an array of one, so that the key is made once for each row
    kind = F.get(F.transform(F.array(key), lambda k: F.when(F.length(k) > short, F.md5(k))), F.lit(0))
    kept = items.select(*keys, "at", kind.alias("__kind")).groupBy(*keys, "__kind", F.when(F.col("__kind").isNull(), F.col("at")).alias("__alone"))
    kept = kept.agg(F.min("at").alias("__at")).select(F.col("__at").alias("at"))
    return items.join(kept, "at", "left_semi").select(*items.columns)


def union_lists(items: DataFrame, value: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys and the distinct values in order of first place."""
    once = items.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min("at").alias("at"))
    return _listed(once, keys, F.col(value), value)


def _listed(rows: DataFrame, keys: Sequence[str], item: Column, name: str) -> DataFrame:
    """The items of a merged entry in one row: that list is the result itself."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("at"), item.alias("i"))), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))
    return rows.groupBy(*keys).agg(pairs.alias("__l")).select(*keys, F.transform("__l", lambda x: x["i"]).alias(name))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for which the value is made once; inside of lambdas it would else be made for each item."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cut(items: Column, starts: Column) -> Column:
    """array<array<item>>: items from each start (a column bound before) up to the next one."""
    return F.transform(starts, lambda a, k: F.slice(items, a + 1, F.coalesce(F.get(starts, k + 1), F.size(items)) - a))


def subtrees(nodes: Column) -> Column:
    """array<array<node>>: the pre-order array of a sense tree cut at its top nodes."""
    at = F.filter(F.transform(nodes, lambda n, i: F.when(n["depth"] == 0, i)), lambda i: i.isNotNull())
    return bound(at, lambda starts: cut(nodes, starts))


def regrow(trees: Column, renumber: bool = True) -> Column:
    """One pre-order array of subtrees; top nodes are numbered from 1."""
    numbered = F.transform(trees, lambda t, k: F.transform(t, lambda n, j: n.withField("number", F.when(j == 0, k + 1).otherwise(n["number"])))) if renumber else trees
    return F.transform(F.flatten(numbered), lambda n, i: n.withField("parent_id", i - (n["node_id"] - n["parent_id"])).withField("node_id", i))


def merge_entries(entries: DataFrame) -> DataFrame:
    """Merged entries of the whole table, a row each, with contributors (provider names) and authority (the best one's).

    entries: the columns of schema.ENTRY; ord is unique. A group of one entry keeps its senses as they are.
    """
    keyed = group_keys(entries.withColumn("authority", F.col("source.authority")))
    base = keyed.withColumn("__at", place()).groupBy(*KEYS).agg(
        F.count("*").alias("n_entries"), F.max("authority").alias("authority"), F.min("ord").alias("first_ord"),
        F.min_by(F.struct("headword", "display_headword", "id", "homonym_index", "source"), F.col("__at")).alias("best"),
        F.min_by("senses", "__at").alias("__own"),
    )
    known = first_known(keyed, ["part_of_speech", "gender", "etymology", "paradigm"])

    def items(column: str) -> DataFrame:
        return keyed.select(*KEYS, "authority", "ord", F.posexplode(column).alias("i", "x")).select(*KEYS, place("i").alias("at"), "x")

    inflections = _listed(merge_inflections(items("inflections").select(*KEYS, "at", "x.*")), KEYS, F.struct("form", "tags", "origin", "confidence"), "inflections")
    said = _listed(merge_pronunciations(items("pronunciations").select(*KEYS, "at", "x.*")), KEYS, F.struct(*FIELDS), "pronunciations")
    trees = keyed.select(*KEYS, "authority", "ord", F.posexplode(subtrees(F.col("senses"))).alias("i", "x")).select(*KEYS, place("i").alias("at"), "x")
    senses = _listed(merge_senses(trees.withColumn("text", F.get("x", F.lit(0))["text"])), KEYS, F.col("x"), "__trees")
    out = base.join(known, list(KEYS))
    for part in (inflections, said, senses, *[union_lists(items(c).withColumnRenamed("x", c), c) for c in ("derived", "compounds")]):
        out = out.join(part, list(KEYS), "left")
    who = union_lists(keyed.select(*KEYS, place().alias("at"), F.col("source.provider_name").alias("contributors")), "contributors")
    out = out.join(who, list(KEYS), "left")
    none = lambda c: F.coalesce(F.col(c), F.array())
    return out.select(
        *KEYS, "best.headword", "best.display_headword", "best.id", F.col("best.homonym_index").alias("homonym_index"),
        F.coalesce("part_of_speech", F.lit(POS_UNKNOWN)).alias("part_of_speech"), "gender", none("inflections").alias("inflections"), "paradigm",
        none("pronunciations").alias("pronunciations"), F.when(F.col("n_entries") == 1, F.col("__own")).otherwise(regrow(none("__trees"))).alias("senses"),
        "etymology", none("derived").alias("derived"), none("compounds").alias("compounds"), "best.source", none("contributors").alias("contributors"),
        "authority", "first_ord", "n_entries",
    )


def in_order(merged: DataFrame, keys: Sequence[str] = ("lemma",)) -> DataFrame:
    """Merged entries with their place (from 1) among those of their lemma: authority downwards, then first appearance."""
    return place_in_groups(merged, list(keys), [F.col("authority").desc(), F.col("first_ord").asc()], "place")
