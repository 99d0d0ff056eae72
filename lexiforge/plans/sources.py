"""Queries over documents that the driver's tables are first turned into: one for each parser, and what follows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge import schema
from lexiforge.functions import text as tx
from lexiforge.functions.phonetics import espeak_notation, transcribe
from lexiforge.operators import adapt, relational, seed
from lexiforge.plans import bindings as b
from lexiforge.plans.bindings import ENTRIES_SQL, TOKENS_SQL
from lexiforge.plans.registry import _OPEN as OPEN_WORDS
from lexiforge.plans.registry import _SAID as KNOWN_WORDS
from lexiforge.plans.registry import SPOKEN_SQL, query, spoken_words
from lexiforge.sources import documents
from lexiforge.sources.spool import table


def _raw(spark: SparkSession, d: str, provider: str, body: Column) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("n", F.col("doc_id").cast("string"))
    return docs.select(F.lit(provider).alias("provider"), F.col("n").alias("word"), body.alias("body"))


def _lines() -> Column:
    """The lines of a text with nothing but letters, digits and blanks, without empty ones."""
    plain = F.split(F.regexp_replace("text", f"[^{tx.UPPER}{tx.LOWER}{tx.DIGITS} \\n]+", ""), "\n", -1)
    return F.filter(plain, lambda x: F.trim(x) != "")


_LINES_SQL = "l AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[^A-Za-z0-9 \n]', '', 'g'), chr(10)), lambda x: trim(x) <> '') AS lines FROM documents)"
_SQUEEZED = "trim(regexp_replace(x, ' +', ' ', 'g'))"


@query("SELECT doc_id, 'audio/' || doc_id || '.mp3' AS audio_url FROM documents WHERE doc_id % 3 <> 0")
def parse_audio(spark: SparkSession, d: str) -> DataFrame:
    """Lists of recordings: one with a path, unless the id is divisible by three, and one without."""
    path = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("audio/"), "n", F.lit(".mp3")))
    items = F.array(F.struct(F.col("n").alias("word"), path.alias("pathmp3")), F.struct(F.col("n").alias("word"), F.lit(None).cast("string").alias("pathmp3")))
    entries = documents.read_entries(_raw(spark, d, "forvo", F.to_json(F.struct(items.alias("items")))))
    return adapt.audio(entries).select(F.col("headword").cast("long").alias("doc_id"), "audio_url")


@query("""SELECT doc_id, 'w' || doc_id || 'ă' AS headword, 'genitive,dative,articulated=w' || doc_id || 'ei|plural=w' || doc_id || 'e' AS inflections, 'substantiv' AS part_of_speech, 'feminin' AS gender FROM documents""")
def parse_spelling(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a spelling dictionary: a lemma with two forms, and an aside that is none."""
    it = lambda end: F.concat(F.lit('<span style="font-style: italic">w'), "n", F.lit(f"{end}</span>"))
    body = F.concat(
        F.lit('<root><entry><span style="font-weight: bold">w'), "n", F.lit('<span style="text-decoration:underline">ă</span></span> s. f., g.-d. art. '), it("ei"), F.lit("; pl. "), it("e"),
        F.lit(" (dar: "), it("X"), F.lit(" s. f.)</entry></root>"),
    )
    raw = _raw(spark, d, "doom", body).withColumn("word", F.concat(F.lit("w"), "word", F.lit("ă")))
    forms = F.transform("inflections", lambda x: F.concat(F.array_join(x["tags"], ","), F.lit("="), x["form"]))
    doc_id = F.regexp_extract("headword", "[0-9]+", 0).cast("long")
    return documents.read_entries(raw).select(doc_id.alias("doc_id"), "headword", F.array_join(forms, "|").alias("inflections"), "part_of_speech", "gender")


@query("SELECT doc_id, 'w' || doc_id AS headword, CAST(doc_id % 4 + 1 AS INTEGER) AS homonym_index, source AS source_name, CAST(2 AS INTEGER) AS n_senses FROM documents")
def parse_mirror(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(
        F.lit("<div class='mydef'><strong>W"), "n", F.lit("a"), (F.col("doc_id") % 4 + 1).cast("string"), F.lit(",</strong> s. f. 1. Prima definitie. 2. A doua. (<span>Sursa: "), "source",
        F.lit("</span>)<button>Copy</button></div>"),
    )
    out = documents.read_entries(_raw(spark, d, "mdex", body))
    return out.select(F.col("word").cast("long").alias("doc_id"), F.regexp_replace("headword", "a$", "").alias("headword"), "homonym_index", "source.source_name", F.size("senses").alias("n_senses"))


@query(f"WITH {_LINES_SQL} SELECT doc_id, CAST(len(lines) AS INTEGER) AS n_senses, md5(list_aggregate(list_transform(lines, lambda x: {_SQUEEZED}), 'string_agg', chr(10))) AS senses FROM l WHERE len(lines) > 0 AND length(list_aggregate(list_transform(lines, lambda x: {_SQUEEZED}), 'string_agg', ' ')) >= 20")
def parse_thesaurus(spark: SparkSession, d: str) -> DataFrame:
    paragraphs = F.array_join(F.transform(_lines(), lambda x: F.concat(F.lit("<p class='def'>"), x, F.lit("</p>"))), " ")
    out = documents.read_entries(_raw(spark, d, "dlr", F.concat(F.lit("<article>"), paragraphs, F.lit("</article>"))))
    return out.select(F.col("word").cast("long").alias("doc_id"), F.size("senses").alias("n_senses"), F.md5(F.array_join(F.transform("senses", lambda s: s["text"]), "\n")).alias("senses"))


def _page() -> Column:
    """A rendered page: a tree with a sense for each line, an example and a synonym below each, and a paradigm of two cells."""
    node = lambda x, i: F.concat(
        F.lit('<li class="type-meaning"><div class="meaningContainer"><div class="meaning-row"><span class="bc">'), (i + 1).cast("string"), F.lit('.</span><span class="tree-def">'), x,
        F.lit('</span><span class="badge-source">S</span></div><div class="meaning-relations"><span class="tag-group"><span class="text-muted">sinonime:</span><span class="badge-relation"><a>syn'),
        i.cast("string"), F.lit('</a></span></span></div></div><ul class="meaningTree"><li class="type-example"><div class="meaningContainer"><div class="meaning-row"><span class="tree-def"><i>quoted '),
        i.cast("string"), F.lit(".</i> SOURCE</span></div></div></li></ul></li>"),
    )
    tree = F.concat(F.lit('<div><span class="tree-pos-info">unknown</span><div class="tree-body"><ul class="meaningTree">'), F.array_join(F.transform(_lines(), node), ""), F.lit("</ul></div></div>"))
    cells = F.concat(
        F.lit('<div class="paradigmDiv"><span class="lexemeName">'), "n", F.lit('</span><table class="lexeme"><tr><td class="inflection">nominativ singular articulat</td><td class="form"><ul><li>'), "n",
        F.lit('a</li></ul></td></tr><tr><td class="inflection">genitiv-dativ plural nearticulat</td><td class="form"><ul><li>'), "n", F.lit("b</li></ul></td></tr></table></div>"),
    )
    return F.concat(tree, cells)


@query(f"WITH {_LINES_SQL} SELECT doc_id, CAST(2 * len(lines) AS INTEGER) AS n_nodes, md5(list_aggregate(list_transform(lines, lambda x: {_SQUEEZED}), 'string_agg', chr(10))) AS senses FROM l WHERE len(lines) > 0")
def page_trees(spark: SparkSession, d: str) -> DataFrame:
    out = documents.read_trees(_raw(spark, d, "page", _page()))
    tops = F.transform(F.filter("nodes", lambda n: n["depth"] == 0), lambda n: n["text"])
    return out.select(F.col("word").cast("long").alias("doc_id"), F.size("nodes").alias("n_nodes"), F.md5(F.array_join(tops, "\n")).alias("senses"))


@query(f"WITH {_LINES_SQL} SELECT doc_id, CAST(len(lines) AS INTEGER) AS n_synonyms, CASE WHEN len(lines) > 0 THEN 'syn0' END AS first FROM l WHERE len(lines) > 0")
def tree_relations(spark: SparkSession, d: str) -> DataFrame:
    out = documents.read_trees(_raw(spark, d, "page", _page())).withColumn("r", adapt.collect_relations(F.col("nodes"))["synonyms"])
    return out.select(F.col("word").cast("long").alias("doc_id"), F.size("r").alias("n_synonyms"), F.get("r", F.lit(0)).alias("first"))


@query("SELECT doc_id, 'nominative,singular,articulated=' || doc_id || 'a|genitive,dative,plural,unarticulated=' || doc_id || 'b' AS cells FROM documents")
def page_paradigms(spark: SparkSession, d: str) -> DataFrame:
    out = documents.read_paradigms(_raw(spark, d, "page", _page()))
    cells = F.transform("inflections", lambda x: F.concat(F.array_join(x["tags"], ","), F.lit("="), x["form"]))
    return out.select(F.col("word").cast("long").alias("doc_id"), F.array_join(cells, "|").alias("cells"))


@query(f"""WITH {_LINES_SQL} SELECT doc_id, CAST(2 * len(lines) AS INTEGER) AS n_nodes, CAST(2 AS INTEGER) AS n_inflections, CASE WHEN len(lines) > 0 THEN 'syn0' END AS synonym FROM l""")
def enrich_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose senses are the lines of a document, with what the document's page adds."""
    pages = _raw(spark, d, "page", _page())
    e = b.nested_entries(spark, d).drop("senses").join(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), _lines().alias("lines")), "id")
    flat = lambda x, i: F.struct((i + 1).alias("number"), x.alias("text"), F.array().cast("array<string>").alias("register"), F.lit(None).cast("string").alias("domain"), F.array().cast("array<struct<text:string,citation:string>>").alias("examples"), F.array().cast("array<string>").alias("synonyms"), F.array().cast("array<string>").alias("antonyms"))
    e = e.withColumns({"senses": adapt.lift_senses(F.transform("lines", flat)), "word": F.col("id"), "headword": F.col("id")})
    out = adapt.enrich_senses(e, documents.read_trees(pages), documents.read_paradigms(pages))
    first = F.get("senses", F.lit(0))["relations"]["synonyms"]
    return out.select(F.col("id").cast("long").alias("doc_id"), F.size("senses").alias("n_nodes"), F.size("inflections").alias("n_inflections"), F.get(first, F.lit(0)).alias("synonym"))


@query(f"""WITH {ENTRIES_SQL}, f AS (SELECT doc_id, doc_id % 2 = 0 AS dex, word, hit FROM e, (VALUES (true), (false)) t(hit))
SELECT doc_id, CASE WHEN dex THEN 'GPL-2.0-or-later' ELSE 'academic' END AS license, hit AS cache_hit, CASE WHEN dex THEN 'DEXonline' ELSE 'DLR / TEZAUR' END AS provider_name,
CASE WHEN dex THEN 'DEXonline.ro contributors; aggregated from DEX, DOOM, DLR and others.' ELSE 'Dicționarul Limbii Române (Academia Română); via dlr1.solirom.ro' END AS attribution,
CASE WHEN hit THEN '' WHEN dex THEN 'https://dexonline.ro/definitie/' || doc_id || '%20' || url_encode(regexp_extract(word, '[a-zé]*')) || '/json' ELSE 'https://dlr1.solirom.ro/index.php?cuv=' || doc_id || '%20' || url_encode(regexp_extract(word, '[a-zé]*')) END AS url FROM f""")
def stamp_source(spark: SparkSession, d: str) -> DataFrame:
    """Entries as they are fetched, and the same as they are found again."""
    word = F.concat(F.col("id"), F.lit(" "), F.regexp_extract("headword", "[a-zé]*", 0))
    e = b.nested_entries(spark, d).withColumns({"provider_id": F.when(F.col("ord") % 2 == 0, "dexonline").otherwise("dlr"), "word": word})
    both = [adapt.stamp_source(e, schema.providers(spark), hit) for hit in (False, True)]
    return both[0].unionByName(both[1]).select(F.col("id").cast("long").alias("doc_id"), "source.license", "source.cache_hit", "source.provider_name", "source.attribution", "source.url")


@query(f"WITH {ENTRIES_SQL} SELECT doc_id, 'k1=' || word || '|k2=' || provider AS forms, CASE WHEN doc_id % 2 = 0 THEN 'seeded' ELSE 'rules' END AS origin FROM e")
def conjugation_map(spark: SparkSession, d: str) -> DataFrame:
    cell = lambda k, v: F.struct(F.array(F.lit(k)).alias("tags"), F.array(v).alias("forms"))
    # the last cell of a tag counts
    cells = F.array(cell("k1", F.col("provider_id")), cell("k2", F.col("provider_id")), cell("k1", F.col("display_headword")))
    paradigm = F.struct(F.lit(None).cast("string").alias("model_code"), F.lit("I").alias("class_roman"), cells.alias("cells"))
    url = F.when(F.col("ord") % 2 == 0, "x/seeded").otherwise("x")
    e = b.nested_entries(spark, d).withColumns({"paradigm": paradigm, "source": F.col("source").withField("url", url), "headword": F.col("id")})
    pairs = F.array_sort(F.transform(F.map_entries("forms"), lambda x: F.concat(x["key"], F.lit("="), x["value"])))
    return adapt.conjugation_map(e).select(F.col("headword").cast("long").alias("doc_id"), F.array_join(pairs, "|").alias("forms"), "origin")


@query("SELECT id AS provider_id, name, CAST(ttl AS INTEGER) AS ttl_days, enabled FROM (VALUES " + ", ".join("('{}', '{}', {}, {})".format(p[0], p[1].replace("'", "''"), p[4], p[7]) for p in schema.PROVIDERS) + ") t(id, name, ttl, enabled)")
def sources_list(spark: SparkSession, d: str) -> DataFrame:
    return schema.providers(spark).select("provider_id", "name", "ttl_days", "enabled")


@query(rf"WITH {TOKENS_SQL}, m AS (SELECT word || CASE length(word) % 3 WHEN 0 THEN '.' WHEN 1 THEN '' ELSE '1' END AS word FROM w UNION SELECT CAST(length(word) AS VARCHAR) FROM w) SELECT word FROM m WHERE regexp_matches(word, '^([a-zăâîșț]{{1,6}}\.|[0-9]+)$')")
def abbreviations(spark: SparkSession, d: str) -> DataFrame:
    w = b.tokens(spark, d)
    n = F.length("word")
    marked = w.select(F.concat("word", F.when(n % 3 == 0, ".").when(n % 3 == 1, "").otherwise("1")).alias("word")).union(w.select(n.cast("string"))).distinct()
    return marked.filter(tx.is_abbreviation(F.col("word")))


@query(rf"WITH {_LINES_SQL} SELECT doc_id, md5(trim(regexp_replace('BOLD ' || coalesce(list_aggregate(lines, 'string_agg', ' '), '') || ' s. f.', '\s+', ' ', 'g'))) AS body FROM l")
def dump_text(spark: SparkSession, d: str) -> DataFrame:
    """Definitions of a dump: sigils around a headword, the lines of the document and a label."""
    rep = F.concat(F.lit("@BOLD@ $"), F.array_join(_lines(), "$ $"), F.lit("$ #s. f.#"))
    rep = F.when(F.size(_lines()) > 0, rep).otherwise("@BOLD@ #s. f.#")
    return table(spark, d, "documents").select("doc_id", F.md5(seed.rep_text(rep)).alias("body"))


@query(rf"""WITH {SPOKEN_SQL}, n AS (SELECT a.word, coalesce(k.ipa, o.ipa) AS ipa FROM a LEFT JOIN k ON k.word = a.word LEFT JOIN o ON o.word = a.word)
SELECT word, replace(replace(replace(replace(replace(replace(replace(replace(replace(trim(ipa, '/'), 't͡ʃ', 'tS'), 't͡s', 'ts'), 'ʃ', 'S'), 'ə', '@'), 'ɨ', 'i"'), 'ɡ', 'g'), 'o̯', 'o'), 'ˈ', chr(39)), 'ʲ', ';') AS notation, true AS plain FROM n""")
def espeak(spark: SparkSession, d: str) -> DataFrame:
    """The synthesizer's notation of all words: shown where SQL can tell it; in no word a sign of the transcription may be left."""
    said = spoken_words(spark, d).withColumn("x", espeak_notation(transcribe(F.col("word"))["ipa"]))
    shown = F.col("word").isin(*[w for w, _ in KNOWN_WORDS]) | F.col("word").rlike(OPEN_WORDS)
    return said.select("word", F.when(shown, F.col("x")).alias("notation"), (~F.col("x").rlike("[ʃʒəɨɡˈʲ͡/]|^/|/$")).alias("plain"))


@query(f"WITH {ENTRIES_SQL} SELECT CAST(doc_id AS VARCHAR) AS id, source_name AS work_title, CAST(len(senses) AS INTEGER) AS n_senses, word || ':' || provider AS form FROM e")
def flat_entries(spark: SparkSession, d: str) -> DataFrame:
    form = F.get("inflections", F.lit(0))
    return adapt.entry_to_flat(b.nested_entries(spark, d)).select("id", "source.work_title", F.size("senses").alias("n_senses"), F.concat(form["form"], F.lit(":"), F.get(form["tags"], F.lit(0))).alias("form"))


@query(f"WITH {ENTRIES_SQL} SELECT CAST(doc_id AS VARCHAR) AS id, CAST(len(senses) AS INTEGER) AS n_senses, md5(coalesce(list_aggregate(senses, 'string_agg', chr(10)), '')) AS senses_md5, word || ':' || provider AS form FROM e")
def relational_round_trip(spark: SparkSession, d: str) -> DataFrame:
    out = relational.from_tables(relational.to_tables(b.nested_entries(spark, d)))
    form = F.get("inflections", F.lit(0))
    return out.select("id", F.size("senses").alias("n_senses"), F.md5(F.array_join(F.transform("senses", lambda s: s["text"]), "\n")).alias("senses_md5"), F.concat(form["form"], F.lit(":"), F.get(form["tags"], F.lit(0))).alias("form"))


@query("SELECT doc_id, 'https://files/' || doc_id AS url, CASE WHEN doc_id % 2 = 0 THEN 'CC0' ELSE 'unknown' END AS license, 'Ro-' || doc_id || '.ogg' AS file FROM documents WHERE doc_id % 5 <> 0")
def parse_recordings(spark: SparkSession, d: str) -> DataFrame:
    """Replies of a media archive: two pages each, the first of which is missing; the second has a file unless the id is divisible by five."""
    meta = F.struct(F.struct(F.when(F.col("doc_id") % 2 == 0, "<b>CC0</b>").alias("value")).alias("LicenseShortName"))
    info = F.struct(F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("https://files/"), "n")).alias("url"), meta.alias("extmetadata"))
    page = lambda missing: F.struct(F.concat(F.lit("Ro-"), "n", F.lit(".ogg")).alias("title"), F.lit(missing).cast("boolean").alias("missing"), F.array(info).alias("imageinfo"))
    body = F.to_json(F.struct(F.struct(F.array(page(True), page(None)).alias("pages")).alias("query")))
    return documents.read_recordings(_raw(spark, d, "media", body)).select(F.col("word").cast("long").alias("doc_id"), "url", "license", "file")
