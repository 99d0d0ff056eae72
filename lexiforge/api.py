"""The engine's face: lookups, search, rules and import for DataFrames of words instead of single requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge import schema
from lexiforge.functions.phonetics import transcribe as transcribe_column
from lexiforge.functions.text import is_headword, norm_headword
from lexiforge.functions.verbs import conjugate as conjugate_words
from lexiforge.functions.verbs import pluralize as pluralize_column
from lexiforge.operators import adapt, merge, search, seed, store, view
from lexiforge.sources import documents
from lexiforge.sources.sqldump import read_dump


class Lexicon:
    """Entries at a path (or a DataFrame of them): word, if there, is the word that was looked up."""

    def __init__(self, spark: SparkSession, entries: DataFrame | str, access_keys: Sequence[str] = ()) -> None:
        self.spark = spark
        self.entries = spark.read.parquet(entries) if isinstance(entries, str) else entries
        self.registry = schema.providers(spark, frozenset(access_keys))

    @staticmethod
    def from_documents(spark: SparkSession, raw: DataFrame, access_keys: Sequence[str] = ()) -> Lexicon:
        """raw: provider, word, doc_kind, body. Documents of the kind "page" enrich the entries of their word."""
        pages = raw.filter("doc_kind = 'page'")
        entries = documents.read_entries(raw.filter("doc_kind IS NULL OR doc_kind <> 'page'"))
        enriched = adapt.enrich_senses(entries, documents.read_trees(pages), documents.read_paradigms(pages))
        return Lexicon(spark, enriched, access_keys)

    def lookup(
        self, words: DataFrame, *, sources: Sequence[str] = (), include: Sequence[str] = (), dictionaries: Sequence[str] = (), everything: bool = False, orthographic: bool = False, limit: int = view.LIMIT,
        merged: bool = False, flat: bool = False, phonetics: bool = True,
    ) -> DataFrame:
        """The entries of words (column word). merged: one entry a lemma, over all providers, with its place among those of the lemma. flat: the flat form."""
        if not 1 <= limit <= 200:
            raise ValueError("limit is 1 to 200")
        asked = view.prune_providers(self.registry, sources, include).select("provider_id")
        valid = words.filter(is_headword(F.col("word"))).select(norm_headword(F.trim("word")).alias("word")).distinct()
        rows = self.entries if "word" in self.entries.columns else self.entries.withColumn("word", F.col("headword"))
        rows = rows.join(F.broadcast(asked), "provider_id", "left_semi").join(valid, "word", "left_semi")
        # views compare texts of top senses; the tree is kept aside meanwhile
        tops = F.transform(F.filter("senses", lambda n: n["depth"] == 0), lambda n: n["text"])
        shaped = rows.withColumns({"provider": F.col("provider_id"), "source_name": F.coalesce("source.source_name", F.lit("")), "authority": F.coalesce("source.authority", F.lit(50)), "__tree": F.col("senses"), "senses": tops})
        out = view.apply_view(shaped, everything=everything, orthographic=orthographic, dictionaries=dictionaries, limit=limit)
        out = out.withColumn("senses", F.col("__tree")).drop("__tree", "provider", "source_name", "authority")
        if phonetics:
            out = adapt.derive_pronunciations(out)
        if merged:
            place = self.registry.select("provider_id", F.col("place").alias("__place"))
            ordered = out.join(F.broadcast(place), "provider_id", "left")
            out = merge.in_order(merge.merge_entries(ordered.withColumn("ord", F.struct("__place", "rank", "id")).drop("word", "rank", "__place")))
        return adapt.entry_to_flat(out) if flat else out

    def index(self) -> search.Index:
        """A search index of headwords and senses, built anew from the entries."""
        body = F.array_join(F.transform("senses", lambda n: n["text"]), " ")
        return search.build_index(self.entries.select("id", "headword", body.alias("text")), ["headword", "text"], "id")

    def search(self, text: str, limit: int = 20, offset: int = 0) -> DataFrame:
        body = F.array_join(F.transform("senses", lambda n: n["text"]), " ")
        return search.page(search.search(self.index(), text), self.entries.withColumn("__body", body), "id", "__body", limit, offset)

    def conjugate(self, verbs: DataFrame, seeded: DataFrame | None = None) -> DataFrame:
        """word, lemma, class_roman, forms (a map) and origin. seeded: verb form rows, which go before the rules."""
        cells = conjugate_words(verbs).groupBy("word", "lemma", "class_roman").agg(F.map_from_entries(F.collect_list(F.struct("form_key", "form"))).alias("forms"))
        if seeded is None:
            return cells.withColumn("origin", F.lit("rules"))
        told = seed.seeded_paradigms(seeded).select("lemma", F.col("class_roman").alias("__roman"), F.col("forms").alias("__forms"))
        out = cells.join(told, "lemma", "left")
        return out.select("word", "lemma", F.when(F.col("__forms").isNotNull(), F.col("__roman")).otherwise(F.col("class_roman")).alias("class_roman"),
                          F.coalesce("__forms", "forms").alias("forms"), F.when(F.col("__forms").isNotNull(), "seeded").otherwise("rules").alias("origin"))

    def pluralize(self, nouns: DataFrame) -> DataFrame:
        return nouns.withColumn("p", pluralize_column(F.col("word"))).select("word", "p.*")

    def transcribe(self, words: DataFrame) -> DataFrame:
        mark = F.col("stress_mark") if "stress_mark" in words.columns else None
        return words.withColumn("t", transcribe_column(F.col("word"), mark)).select("word", "t.*")

    def audio(self) -> DataFrame:
        return adapt.audio(self.entries)

    def sources(self, breakers: DataFrame | None = None) -> DataFrame:
        """The registry and, if states (provider_id, state) are given, each provider's breaker."""
        if breakers is None:
            return self.registry.withColumn("breaker", F.lit("closed"))
        return self.registry.join(breakers.select("provider_id", F.col("state").alias("breaker")), "provider_id", "left").fillna("closed", ["breaker"])

    def to_fetch(self, words: DataFrame, lookups: DataFrame, refresh: bool = False) -> DataFrame:
        """provider_id and headword of the documents to fetch for words: those of providers that are on, without a fresh lookup (provider_id, headword, expires_at). refresh: all."""
        valid = words.filter(is_headword(F.col("word"))).select(norm_headword(F.col("word")).alias("headword")).distinct()
        wanted = F.broadcast(self.registry.filter("enabled").select("provider_id", F.lit(1).alias("__one"))).join(valid.withColumn("__one", F.lit(1)), "__one").drop("__one")
        return store.to_fetch(wanted, lookups, F.current_timestamp(), refresh)

    def save(self, path: str) -> None:
        store.write_snapshot(self.entries, path)


def import_dump(spark: SparkSession, path: str, words: Sequence[str] | None = None, mode: str = "full") -> dict[str, DataFrame]:
    """The tables of a gzipped SQL dump as entries, senses, verb forms, lookups and a summary.

    words: only entries whose first word is among these. mode "lite": without verb forms, and if no words are given only the frequent ones.
    """
    if mode not in ("lite", "full"):
        raise ValueError('mode is "lite" or "full"')
    if mode == "lite" and words is None:
        words = seed.FREQUENT
    return seed.import_tables(read_dump(spark, path), words, mode == "full")


def to_json(entries: DataFrame) -> DataFrame:
    return entries.select(F.to_json(F.struct(*entries.columns)).alias("json"))
