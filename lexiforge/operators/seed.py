"""The bulk import: typed tables of a dictionary dump joined into entries, senses and verb forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.functions.text import det_id, norm_headword, plain_text
from lexiforge.operators.rank import place_in_groups

#: Sigils of the dump's markup and escapes, taken off in this order.
MARKUP = (
    ("@([^@\\n]+)@", "$1"), ("\\$([^$\\n]+)\\$", "$1"), ("#([^#\\n]+)#", "$1"), ("%([^%\\n]+)%", "$1"), ("\\*\\*([^*\\n]+)\\*\\*", "$1"), ("\\^([^\\^\\n]+)\\^", "$1"),
    ("\\\\[A-Za-z]+", " "), ("[@$#%^*~]+(?=\\s|$)", " "), ("[@$#%^*~](?<=\\s[@$#%^*~])[@$#%^*~]*", " "), ("[@$#%^~]", ""), ("'(?=[A-ZĂÂÎȘȚ])", ""),
)

# The frequent words that the "lite" import keeps.
FREQUENT = (
    "a", "al", "altă", "alt", "am", "an", "apă", "apoi", "are", "asa", "au", "avea", "azi", "bine", "bun", "bună", "cale", "când", "care", "cărți", "casă",
    "caz", "ce", "cei", "cele", "centru", "cer", "chiar", "cine", "copil", "corp", "cred", "cum", "cuvânt", "dă", "da", "dacă", "dar", "dat", "de", "des",
    "după", "două", "doi", "drum", "el", "ea", "face", "fac", "fără", "fel", "femeie", "fi", "fie", "foarte", "fost", "frate", "fără", "fugi", "gând", "gândi",
    "gata", "greu", "gură", "hai", "iar", "iată", "idee", "iei", "încă", "între", "între", "inima", "la", "lăsa", "lege", "lega", "lucru", "lume", "lung",
    "mâncare", "mâine", "mare", "mai", "măsură", "mama", "mână", "mea", "merg", "merge", "mergea", "mers", "mic", "mine", "minte", "minuni", "mod", "mult",
    "munte", "nou", "noua", "noi", "nu", "om", "ori", "orice", "parc", "parte", "pat", "pe", "pentru", "piatră", "piaț", "piață", "plec", "pleca", "poate",
    "pod", "pom", "porni", "punct", "pune", "puțin", "rău", "risc", "sat", "sare", "sau", "şcoală", "scrie", "sfârșit", "soare", "spre", "stiu", "știu", "sub",
    "sunet", "sus", "susține", "suni", "tată", "te", "timp", "toți", "totul", "tu", "unde", "uşa", "ușă", "vânt", "văd", "vale", "vedea", "vede", "vis", "voi",
    "vorbi", "vreo", "zi", "zile",
)


def rep_text(rep: Column) -> Column:
    """The plain text of a definition in the dump's markup."""
    out = F.coalesce(rep, F.lit(""))
    for pattern, to in MARKUP:
        out = F.regexp_replace(out, pattern, to)
    return plain_text(out)


def first_word(text: Column) -> Column:
    return norm_headword(F.get(F.split(text, "\\s"), F.lit(0)))


def linked_senses(entries: DataFrame, definitions: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """entry_id, number (long), text for each link whose entry and definition exist, numbered in link order.

    entries: entry_id. definitions: def_id, source_id, text. links: entry_id, def_id, link_ord. sources: source_id, name.
    A definition with a known source has its name in front. Spark picks the joins; an entry with very many links is
    numbered by ranges.
    """
    named = definitions.join(sources.select("source_id", "name"), "source_id", "left")
    text = F.when(F.col("name").isNotNull(), F.concat(F.lit("["), F.col("name"), F.lit("] "), F.col("text"))).otherwise(F.col("text"))
    rows = links.join(entries.select("entry_id"), "entry_id").join(named.select("def_id", text.alias("text")), "def_id")
    return place_in_groups(rows, ["entry_id"], [F.col("link_ord"), F.col("def_id")], "number").select("entry_id", "number", "text")


def verb_forms(forms: DataFrame, lexemes: DataFrame, lemmas: DataFrame) -> DataFrame:
    """lemma, form_key, form, each triple once, of lexemes whose lemma is among the seeded ones (column lemma)."""
    named = forms.join(lexemes.select("lexeme_id", norm_headword(F.col("headword")).alias("lemma")), "lexeme_id")
    kept = named.join(lemmas.select("lemma").distinct(), "lemma", "left_semi")
    return kept.select("lemma", F.concat(F.lit("inflection."), F.col("inflection_id").cast("string")).alias("form_key"), "form").distinct()


def seeded_paradigms(rows: DataFrame) -> DataFrame:
    """lemma, class_roman and forms (a map) from verb_forms rows (lemma, form_key, form, class_roman, row_id): the last row of a key counts."""
    last = rows.groupBy("lemma", "form_key").agg(F.max_by("form", "row_id").alias("form"))
    cells = last.groupBy("lemma").agg(F.map_from_entries(F.collect_list(F.struct("form_key", "form"))).alias("forms"))
    roman = rows.groupBy("lemma").agg(F.max_by("class_roman", F.when(F.col("class_roman").isNotNull(), F.col("row_id"))).alias("class_roman"))
    return cells.join(roman, "lemma").select("lemma", "class_roman", "forms")


def lite(entries: DataFrame, words: DataFrame | Sequence[str], headword: str = "headword") -> DataFrame:
    """Entries whose first word is in a list of frequent words."""
    if not isinstance(words, DataFrame):
        words = entries.sparkSession.createDataFrame([(w,) for w in words], "w string")
    keys = words.select(norm_headword(F.col(words.columns[0])).alias("__w")).distinct()
    return entries.withColumn("__w", first_word(F.col(headword))).join(keys, "__w", "left_semi").drop("__w")


def import_tables(tables: dict[str, DataFrame], words: Sequence[str] | None = None, full: bool = True) -> dict[str, DataFrame]:
    """entries, senses, verb_forms, lookups and summary of a dump read by sources.sqldump. words: only entries of these words."""
    long = lambda c: F.expr(f"try_cast({c} AS bigint)")
    entries = tables["Entry"].select(long("id").alias("entry_id"), F.col("description").alias("headword"), F.col("partOfSpeech").alias("part_of_speech"))
    entries = entries.filter("entry_id IS NOT NULL AND headword <> ''").dropDuplicates(["entry_id"])
    if words is not None:
        entries = lite(entries, words)
    entries = entries.withColumn("lemma", first_word(F.col("headword"))).withColumn("id", det_id(F.lit("dexonline"), F.col("lemma"), F.col("entry_id")))
    definitions = tables["Definition"].select(long("id").alias("def_id"), F.nullif(long("sourceId"), F.lit(0)).alias("source_id"), rep_text(F.col("internalRep")).alias("text"))
    definitions = definitions.filter("def_id IS NOT NULL AND text <> ''")
    sources = tables["Source"].select(long("id").alias("source_id"), F.coalesce("shortName", "name").alias("name")).filter("source_id IS NOT NULL")
    links = tables["EntryDefinition"].select(long("entryId").alias("entry_id"), long("definitionId").alias("def_id"), F.col("row_ord").alias("link_ord"))
    senses = linked_senses(entries, definitions, links, sources)
    out = {"entries": entries, "senses": senses}
    if full:
        lexemes = tables["Lexeme"].select(long("id").alias("lexeme_id"), F.coalesce("formUtf8General", "formNoAccent", "description").alias("headword"))
        forms = tables["InflectedForm"].select(long("lexemeId").alias("lexeme_id"), long("inflectionId").alias("inflection_id"), "form").filter("form <> '' AND inflection_id IS NOT NULL")
        out["verb_forms"] = verb_forms(forms, lexemes, entries)
    out["lookups"] = entries.select(F.lit("dexonline").alias("provider_id"), F.col("lemma").alias("headword"), F.lit("9999-12-31 23:59:59").cast("timestamp").alias("expires_at")).distinct()
    count = lambda df, name: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    summary = count(entries, "entries").unionByName(count(senses, "senses"))
    if full:
        summary = summary.unionByName(count(out["verb_forms"], "inflected_forms")).unionByName(count(lexemes, "lexemes"))
    out["summary"] = summary
    return out
