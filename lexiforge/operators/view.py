"""What a reader sees of the entries of a word: filtered, ranked, without covered entries, capped.

Entries have word, provider, source_name, authority, senses (texts of top-level senses) and ord, the input order, which is
unique in a group; further columns pass through. A group is a word and a provider.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.text import fold_key, norm_headword, sense_key
from lexiforge.operators.rank import join_same, place_in_groups
from lexiforge.schema import ORTHOGRAPHIC

GROUP = ("word", "provider")
LIMIT, SHORT = 8, 12


def _place() -> Column:
    """Entries compare by it: authority, then the number of senses, then input order."""
    return F.struct((-F.col("authority")).alias("a"), (-F.size("senses")).alias("n"), F.col("ord").alias("o"))


def drop_orthographic(entries: DataFrame, names: Sequence[str] = ORTHOGRAPHIC, group: Sequence[str] = GROUP) -> DataFrame:
    """Without spelling dictionaries, unless a group has nothing else."""
    keep = ~F.coalesce(F.col("source_name").isin(*names), F.lit(False))
    some = entries.groupBy(*group).agg(F.bool_or(keep).alias("__some"))
    return join_same(entries, some, group).filter(keep | ~F.col("__some")).drop("__some")


def only_dictionaries(entries: DataFrame, names: Sequence[str]) -> DataFrame:
    return entries.filter(F.lower("source_name").isin(*[n.lower() for n in names]))


def prune_providers(registry: DataFrame, sources: Sequence[str] = (), capabilities: Sequence[str] = ()) -> DataFrame:
    """Providers to ask. A provider named in sources counts even if it is off by default; empty lists restrict nothing."""
    out = registry.filter(F.col("provider_id").isin(*sources)) if sources else registry.filter("enabled")
    if capabilities:
        out = out.filter(F.arrays_overlap("capabilities", F.array(*[F.lit(c) for c in capabilities])))
    return out


def ranked(entries: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """With rank (long, from 1) in the group."""
    order = [F.col("authority").desc(), F.size("senses").desc(), F.col("ord").asc()]
    return place_in_groups(entries, group, order, "rank")


def drop_covered(entries: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Without entries whose long senses all stand in entries of a higher rank.

    A dropped entry shows nothing new, so what has been seen is what all entries above have. An entry therefore
    stays if it is the first of its group for some sense, which is a minimum with partial sums and needs no ranks.
    """
    keys = F.array_distinct(F.filter(F.transform("senses", sense_key), lambda k: F.length(k) > SHORT))
    keyed = entries.withColumns({"__at": _place(), "__keys": F.coalesce(keys, F.array().cast("array<string>"))})
    long = keyed.select(*group, "__at", F.explode("__keys").alias("__key"))
    first = long.groupBy(*group, F.md5("__key").alias("__key")).agg(F.min("__at").alias("__at")).select(*group, "__at").distinct()
    out = join_same(keyed, first.withColumn("__first", F.lit(True)), [*group, "__at"], "left")
    return out.filter((F.size("__keys") == 0) | F.col("__first")).drop("__at", "__keys", "__first")


def cap(entries: DataFrame, limit: int = LIMIT, group: Sequence[str] = GROUP) -> DataFrame:
    """The first entries of each group; Spark limits each partition before it deals the rows."""
    order = Window.partitionBy(*group).orderBy(_place())
    return entries.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= limit).drop("__k")


def lemma_match(entries: DataFrame, word: str = "word", headword: str = "headword", group: Sequence[str] = GROUP) -> DataFrame:
    """Entries whose headword is the word; if a group has none, those that agree without diacritics; if none, all."""
    exact = norm_headword(F.col(headword)) == norm_headword(F.col(word))
    level = F.when(exact, 0).when(fold_key(F.col(headword)) == fold_key(F.col(word)), 1).otherwise(2)
    leveled = entries.withColumn("__level", level)
    best = leveled.groupBy(*group).agg(F.min("__level").alias("__best"))
    return join_same(leveled, best, group).filter("__level = __best").drop("__level", "__best")


def apply_view(
    entries: DataFrame, *, everything: bool = False, orthographic: bool = False, dictionaries: Sequence[str] = (), limit: int = LIMIT, group: Sequence[str] = GROUP
) -> DataFrame:
    """The view of each group, with rank. everything: neither covered entries are dropped nor is the list cut."""
    if not orthographic:
        entries = drop_orthographic(entries, group=group)
    if dictionaries:
        entries = only_dictionaries(entries, dictionaries)
    if everything:
        return ranked(entries, group)
    kept = cap(drop_covered(entries, group), limit, group)
    # at most `limit` rows a group are left here
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(_place())).cast("long"))
