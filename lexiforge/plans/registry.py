"""Queries over the driver's tables, one for each operator, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge import schema
from lexiforge.functions import text as tx
from lexiforge.functions import verbs
from lexiforge.functions.phonetics import transcribe
from lexiforge.operators import adapt, merge, search, seed, store, view
from lexiforge.operators.rank import place_in_groups
from lexiforge.plans import bindings as b
from lexiforge.plans.bindings import ENTRIES_SQL, LINKED_SQL, TOKENS_SQL, sense_key_sql
from lexiforge.sources import documents
from lexiforge.sources.spool import table
from lexiforge.streaming import limits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


# ---- text -------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(lower(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)))) AS headword FROM documents")
def norm_headword(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(tx.norm_headword(F.col("text"))).alias("headword"))


@query(rf"""WITH {TOKENS_SQL}, m AS (SELECT word, replace(replace(replace(word, 'é', 'e' || chr(769)), 'ñ', 'n' || chr(771)), 'ç', 'c' || chr(807)) AS loose FROM w)
SELECT word, nfc_normalize(loose) AS headword, loose <> word AS decomposed FROM m""")
def decomposed_headwords(spark: SparkSession, d: str) -> DataFrame:
    """Words in decomposed spelling, brought to composed headwords."""
    loose = F.col("word")
    for letter, spelled in (("é", "e\u0301"), ("ñ", "n\u0303"), ("ç", "c\u0327")):
        loose = F.replace(loose, F.lit(letter), F.lit(spelled))
    return b.tokens(spark, d).withColumn("loose", loose).select("word", tx.norm_headword(F.col("loose")).alias("headword"), (F.col("loose") != F.col("word")).alias("decomposed"))


@query("SELECT doc_id, md5(lower(strip_accents(text))) AS folded FROM documents")
def ascii_fold(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(F.lower(tx.strip_marks(F.col("text")))).alias("folded"))


@query(f"SELECT doc_id, md5({sense_key_sql('text')}) AS sense_key FROM documents")
def sense_key(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(tx.sense_key(F.col("text"))).alias("sense_key"))


@query("SELECT p_partkey, substr(sha256('part' || chr(1) || lower(p_name) || chr(1) || p_partkey), 1, 26) AS id FROM part")
def det_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", tx.det_id(F.lit("part"), F.lower("p_name"), F.col("p_partkey")).alias("id"))


@query(r"WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents) SELECT word FROM w WHERE length(word) BETWEEN 1 AND 64 AND regexp_matches(word, '^[\p{L}\p{M}''\-\s]+$')")
def headword_filter(spark: SparkSession, d: str) -> DataFrame:
    words = _docs(spark, d).select(F.explode(F.split("text", " ", -1)).alias("word")).distinct()
    return words.filter(tx.is_headword(F.col("word")))


@query(rf"""WITH {TOKENS_SQL}, m AS (SELECT word || CASE WHEN length(word) % 3 = 0 THEN '' ELSE CAST(length(word) % 3 AS VARCHAR) END || ',' AS marked, word FROM w)
SELECT marked, word, CAST(nullif(length(word) % 3, 0) AS INTEGER) AS homonym FROM m""")
def split_homonym(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("word") % 3
    marked = b.tokens(spark, d).select(F.concat("word", F.when(n == 0, "").otherwise(n.cast("string")), F.lit(",")).alias("marked"))
    return marked.withColumn("x", tx.split_homonym(F.col("marked"))).select("marked", "x.word", "x.homonym")


@query("SELECT p_partkey, 'https://words/' || url_encode(p_name) AS url FROM part")
def word_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", tx.url_of("https://words/", F.col("p_name")).alias("url"))


@query("""SELECT p_partkey, list_aggregate(list_filter(list_transform(string_split(p_type || ', ' || p_name, ','), lambda x: lower(trim(x))), lambda x: x IN ('economy', 'small', 'red widget')), 'string_agg', '|') AS kept,
  lower(p_brand) IN ('', '1', 'true') AS flag FROM part""")
def request_params(spark: SparkSession, d: str) -> DataFrame:
    listed = tx.list_param(F.lower(F.concat_ws(", ", "p_type", "p_name")), ["economy", "small", "red widget"])
    kept = F.when(F.size(listed) > 0, F.array_join(listed, "|"))
    return table(spark, d, "part").select("p_partkey", kept.alias("kept"), F.coalesce(tx.truthy(F.col("p_brand")), F.lit(False)).alias("flag"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'view' THEN 'quota_exceeded' WHEN 'click' THEN 'robots_disallowed' ELSE 'upstream_error' END AS kind FROM events")
def error_kinds(spark: SparkSession, d: str) -> DataFrame:
    told = {"error": "Request Timeout", "view": "daily quota used up", "click": "blocked by robots.txt"}
    message = F.coalesce(F.create_map(*[F.lit(x) for kv in told.items() for x in kv])[F.col("event_type")], F.lit("broken pipe"))
    return table(spark, d, "events").select("event_id", tx.error_kind(message).alias("kind"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'),
  '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '[\s ]+', ' ', 'g'))) AS body FROM pages""")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(tx.plain_text(F.col("html"))).alias("body"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'),
  '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', '', 'g'), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '[\s ]+', ' ', 'g'))) AS body FROM pages""")
def html_dom_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(documents.html_text(F.col("html"))).alias("body"))


@query("""WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages)
SELECT page_id, CAST(unnest(range(len(hrefs))) AS INTEGER) AS pos, unnest(hrefs) AS href FROM l""")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("pos", "href"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# ---- views ------------------------------------------------------------------------------------------------------

_SPELLING = ("src0", "src1")
_RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY word, provider ORDER BY authority DESC, len(senses) DESC, ord) AS rank FROM e)"
_COVER = f"""x AS (SELECT DISTINCT doc_id, word, provider, rank, key FROM (SELECT *, {sense_key_sql('s')} AS key FROM (SELECT doc_id, word, provider, rank, unnest(senses) AS s FROM r)) WHERE length(key) > 12),
f AS (SELECT doc_id, bool_or(rank = low) AS fresh FROM (SELECT *, min(rank) OVER (PARTITION BY word, provider, key) AS low FROM x) GROUP BY doc_id),
kept AS (SELECT r.* FROM r LEFT JOIN f USING (doc_id) WHERE coalesce(fresh, true))"""


@query(f"""WITH {ENTRIES_SQL}, s AS (SELECT *, bool_or(source_name NOT IN ('src0', 'src1')) OVER (PARTITION BY word, provider) AS others FROM e)
SELECT doc_id, word, provider, source_name FROM s WHERE source_name NOT IN ('src0', 'src1') OR NOT others""")
def ortho_filter(spark: SparkSession, d: str) -> DataFrame:
    return view.drop_orthographic(b.entries(spark, d), _SPELLING).select("doc_id", "word", "provider", "source_name")


@query(f"WITH {ENTRIES_SQL} SELECT doc_id, source_name FROM e WHERE lower(source_name) IN ('src3', 'src7')")
def dict_filter(spark: SparkSession, d: str) -> DataFrame:
    return view.only_dictionaries(b.entries(spark, d), ["SRC3", "src7"]).select("doc_id", "source_name")


_VALUES = ", ".join(f"('{p[0]}', {p[7]}, {[*p[3]]!r}, {i})" for i, p in enumerate(schema.PROVIDERS))


@query(f"SELECT id AS provider_id, CAST(place AS INTEGER) AS place FROM (VALUES {_VALUES}) t(id, enabled, caps, place) WHERE enabled AND list_has_any(caps, ['definitions', 'conjugation'])")
def provider_prune(spark: SparkSession, d: str) -> DataFrame:
    return view.prune_providers(schema.providers(spark), (), ["definitions", "conjugation"]).select("provider_id", "place")


@query(f"WITH {ENTRIES_SQL}, {_RANKED} SELECT doc_id, word, provider, rank FROM r")
def view_rank(spark: SparkSession, d: str) -> DataFrame:
    return view.ranked(b.entries(spark, d)).select("doc_id", "word", "provider", "rank")


@query(f"WITH {ENTRIES_SQL}, {_RANKED}, {_COVER} SELECT doc_id, word, provider, authority FROM kept")
def view_dedup(spark: SparkSession, d: str) -> DataFrame:
    return view.drop_covered(b.entries(spark, d)).select("doc_id", "word", "provider", "authority")


@query(f"""WITH {ENTRIES_SQL}, {_RANKED}, {_COVER},
c AS (SELECT *, row_number() OVER (PARTITION BY word, provider ORDER BY rank) AS place FROM kept) SELECT doc_id, word, provider, place AS rank FROM c WHERE place <= 2""")
def view_cap(spark: SparkSession, d: str) -> DataFrame:
    return view.apply_view(b.entries(spark, d), orthographic=True, limit=2).select("doc_id", "word", "provider", "rank")


@query(f"""WITH {ENTRIES_SQL}, p AS (SELECT *, CASE WHEN word = strip_accents(word) THEN 0 ELSE 1 END AS level, strip_accents(word) AS probe FROM e),
m AS (SELECT *, min(level) OVER (PARTITION BY probe, provider) AS best FROM p) SELECT doc_id, word, probe FROM m WHERE level = best""")
def lemma_match(spark: SparkSession, d: str) -> DataFrame:
    e = b.entries(spark, d).withColumns({"headword": F.col("word"), "word": tx.strip_marks(F.col("word"))})
    return view.lemma_match(e).select("doc_id", F.col("headword").alias("word"), F.col("word").alias("probe"))


_NAMES = list(schema.AUTHORITY)
# Written out again, so that a wrong value on either side is seen.
_KNOWN = """('DOOM 3', 98, 2021), ('DOOM 2', 80, 2005), ('DEX ''09', 95, 2009), ('DEXI', 92, 2007), ('MDA2', 90, 2010), ('DEX ''98', 78, 1998), ('DEX ''96', 76, 1996),
('MDN ''00', 74, 2000), ('MDN', 74, NULL), ('NODEX', 72, 2002), ('DN', 70, NULL), ('Ortografic', 68, NULL), ('MDO', 66, NULL), ('DLRLC', 60, 1957), ('DLRM', 58, 1958),
('DER', 52, 1966), ('DE', 50, NULL), ('DCR2', 45, 2013), ('DCR', 44, NULL), ('DRAM 2021', 42, 2021), ('DRAM 2015', 40, 2015), ('DRAM', 38, NULL), ('DGS', 36, NULL),
('DTM', 34, NULL), ('D.Religios', 32, NULL), ('Onomastic', 30, NULL), ('CECC', 28, NULL), ('IVO-III', 26, NULL), ('Sinonime', 24, NULL), ('Sinonime82', 22, 1982),
('Argou', 20, NULL), ('CADE', 18, 1926), ('Scriban', 14, 1939), ('Șăineanu, ed. VI', 12, 1929)"""


@query(f"""WITH t AS (SELECT *, row_number() OVER () - 1 AS i FROM (VALUES {_KNOWN}) t(name, a, y)), s AS (SELECT s_suppkey, CAST(s_suppkey % 35 AS INTEGER) AS i FROM supplier)
SELECT s_suppkey, coalesce(name, 'other') AS source_name, CAST(coalesce(a, 25) AS INTEGER) AS authority, CAST(y AS INTEGER) AS year FROM s LEFT JOIN t USING (i)""")
def authority_lookup(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in (*_NAMES, "other")])
    named = table(spark, d, "supplier").select("s_suppkey", F.get(names, (F.col("s_suppkey") % (len(_NAMES) + 1)).cast("int")).alias("source_name"))
    return named.withColumns({"authority": schema.authority_of(F.col("source_name")), "year": schema.year_of(F.col("source_name"))})


# ---- merging ----------------------------------------------------------------------------------------------------


@query(f"WITH {LINKED_SQL} SELECT ord, lemma, pos, homonym FROM g")
def merge_group(spark: SparkSession, d: str) -> DataFrame:
    return merge.group_keys(b.linked(spark, d)).select("ord", "lemma", "pos", "homonym")


@query(f"""WITH {LINKED_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY lemma, pos, homonym ORDER BY gender IS NULL, authority DESC, ord) AS i FROM g)
SELECT lemma, pos, homonym, gender FROM p WHERE i = 1""")
def merge_scalars(spark: SparkSession, d: str) -> DataFrame:
    return merge.first_known(merge.group_keys(b.linked(spark, d)), ["gender"])


@query(f"""WITH {LINKED_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY lemma, pos, homonym, contributor ORDER BY authority DESC, ord) AS i FROM g)
SELECT lemma, pos, homonym, string_agg(contributor, '|' ORDER BY authority DESC, ord) AS contributors FROM p WHERE i = 1 GROUP BY ALL""")
def merge_contributors(spark: SparkSession, d: str) -> DataFrame:
    rows = merge.group_keys(b.linked(spark, d)).withColumn("at", merge.place())
    return merge.union_lists(rows, "contributor").select("lemma", "pos", "homonym", F.array_join("contributor", "|").alias("contributors"))


@query("""WITH i AS (SELECT l_partkey, strftime(l_shipdate, '%Y-%m') AS form, least(l_returnflag, l_linestatus) || ',' || greatest(l_returnflag, l_linestatus) AS tags, l_linenumber % 2 = 1 AS derived,
  CAST(l_quantity AS INTEGER) AS confidence, l_orderkey, l_linenumber, l_suppkey, l_extendedprice FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, form, tags ORDER BY derived, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, confidence) AS n,
  min(l_orderkey) OVER (PARTITION BY l_partkey, form, tags) AS first_order FROM i)
SELECT l_partkey, form, tags, CASE WHEN derived THEN 'derived' ELSE 'attested' END AS origin, confidence, first_order FROM r WHERE n = 1""")
def merge_inflections(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity")
    items = table(spark, d, "lineitem").select(
        "l_partkey", at.alias("at"), F.date_format("l_shipdate", "yyyy-MM").alias("form"), F.array("l_returnflag", "l_linestatus").alias("tags"),
        F.when(F.col("l_linenumber") % 2 == 1, "derived").otherwise("attested").alias("origin"), F.col("l_quantity").cast("int").alias("confidence"),
    )
    out = merge.merge_inflections(items, ["l_partkey"])
    return out.select("l_partkey", "form", F.array_join(F.array_sort("tags"), ",").alias("tags"), "origin", "confidence", F.col("at.l_orderkey").alias("first_order"))


@query("""WITH p AS (SELECT user_id, event_id AS pos, CASE WHEN value < 20 THEN event_type END AS ipa, CASE WHEN value < 50 THEN props END AS audio_url, 's' || CAST(floor(value / 10) AS INTEGER) AS stress_mark FROM events),
n AS (SELECT *, coalesce(ipa, audio_url, stress_mark) AS name FROM p)
SELECT user_id, name, min(pos) AS first_at, arg_max(ipa, pos) FILTER (WHERE ipa IS NOT NULL) AS ipa, arg_max(audio_url, pos) FILTER (WHERE audio_url IS NOT NULL) AS audio_url, arg_max(stress_mark, pos) AS stress_mark
FROM n GROUP BY user_id, name""")
def merge_pronunciations(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "events").select(
        "user_id", F.col("event_id").alias("at"), F.when(F.col("value") < 20, F.col("event_type")).alias("ipa"), F.when(F.col("value") < 50, F.col("props")).alias("audio_url"),
        F.concat(F.lit("s"), F.floor(F.col("value") / 10).cast("int").cast("string")).alias("stress_mark"),
    )
    out = merge.merge_pronunciations(items, ["user_id"], ["ipa", "audio_url", "stress_mark"])
    return out.select("user_id", F.coalesce("ipa", "audio_url", "stress_mark").alias("name"), F.col("at").alias("first_at"), "ipa", "audio_url", "stress_mark")


@query(f"""WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents), k AS (SELECT *, {sense_key_sql('line')} AS key FROM l),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, key ORDER BY doc_id, pos) AS i FROM k)
SELECT lang, doc_id, CAST(pos AS INTEGER) AS pos, row_number() OVER (PARTITION BY lang ORDER BY doc_id, pos) AS number FROM m WHERE i = 1 OR length(key) <= 12""")
def merge_senses(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    kept = merge.merge_senses(lines.withColumn("at", F.struct("doc_id", "pos")), ["lang"])
    return place_in_groups(kept.select("lang", "doc_id", "pos"), ["lang"], [F.col("doc_id"), F.col("pos")], "number")


@query()
def merge_entries(spark: SparkSession, d: str) -> DataFrame:
    out = merge.merge_entries(b.nested_entries(spark, d))
    return out.select(
        "lemma", "pos", "homonym", "id", "n_entries", "authority", F.size("senses").alias("n_senses"), F.size("inflections").alias("n_inflections"),
        F.array_join("contributors", "|").alias("contributors"), F.array_join("compounds", "|").alias("compounds"),
        F.md5(F.array_join(F.transform("senses", lambda s: s["text"]), "\n")).alias("senses_md5"),
    )


SQL["merge_entries"] = f"""WITH {ENTRIES_SQL}, s AS (SELECT doc_id, word, authority, unnest(senses) AS line, unnest(range(len(senses))) AS pos FROM e), n AS (SELECT word, count(*) AS n FROM e GROUP BY word),
k AS (SELECT s.*, n.n, {sense_key_sql('line')} AS key FROM s JOIN n USING (word)),
m AS (SELECT *, row_number() OVER (PARTITION BY word, key ORDER BY authority DESC, doc_id, pos) AS i FROM k),
t AS (SELECT word, count(*) AS n_senses, string_agg(line, chr(10) ORDER BY authority DESC, doc_id, pos) AS body FROM m WHERE n = 1 OR i = 1 OR length(key) <= 12 GROUP BY word),
c AS (SELECT word, string_agg(source_name, '|' ORDER BY authority DESC, ord) AS contributors FROM (SELECT *, row_number() OVER (PARTITION BY word, source_name ORDER BY authority DESC, ord) AS i FROM e) WHERE i = 1 GROUP BY word),
f AS (SELECT word, count(DISTINCT provider) AS n_inflections, arg_min(CAST(doc_id AS VARCHAR), doc_id - 1000000000000 * authority) AS id, count(*) AS n_entries, max(authority) AS authority FROM e GROUP BY word)
SELECT word AS lemma, '' AS pos, 1 AS homonym, id, n_entries, authority, CAST(coalesce(n_senses, 0) AS INTEGER) AS n_senses, CAST(n_inflections AS INTEGER) AS n_inflections, contributors, contributors AS compounds, md5(coalesce(body, '')) AS senses_md5
FROM f JOIN c USING (word) LEFT JOIN t USING (word)"""


@query(f"""WITH {LINKED_SQL}, m AS (SELECT lemma, pos, homonym, max(authority) AS authority, min(ord) AS first_ord FROM g GROUP BY lemma, pos, homonym)
SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY authority DESC, first_ord) AS place FROM m""")
def merge_order(spark: SparkSession, d: str) -> DataFrame:
    merged = merge.group_keys(b.linked(spark, d)).groupBy(*merge.KEYS).agg(F.max("authority").alias("authority"), F.min("ord").alias("first_ord"))
    return merge.in_order(merged)


# ---- search -----------------------------------------------------------------------------------------------------


def _found(spark: SparkSession, d: str, text: str) -> DataFrame:
    e = table(spark, d, "documents").select("doc_id", F.regexp_extract("text", "[^ \\t\\n]+", 0).alias("headword"), "text")
    return search.search(search.build_index(e, ["headword", "text"], "doc_id"), text)


def _search_sql(*phrases: list[str], tail: str = "") -> str:
    """BM25 over postings that SQL makes itself."""
    words = lambda c: f"regexp_extract_all(lower(strip_accents({c})), '[\\p{{L}}\\p{{N}}]+')"
    ctes = [
        f"d AS (SELECT doc_id, {words('regexp_extract(text, $$[^ \t\n]+$$, 0)')} AS h, {words('text')} AS t FROM documents)",
        "tok AS (SELECT doc_id, 0 AS c, unnest(h) AS w, unnest(range(len(h))) AS i FROM d UNION ALL SELECT doc_id, 1, unnest(t), unnest(range(len(t))) FROM d)",
        "st AS (SELECT doc_id, len(h) + len(t) AS size, avg(len(h) + len(t)) OVER () AS mean, count(*) OVER () AS n FROM d)",
    ]
    for p, phrase in enumerate(phrases):
        joins = " ".join(f"JOIN tok t{j} ON t{j}.doc_id = t0.doc_id AND t{j}.c = t0.c AND t{j}.i = t0.i + {j}" for j in range(1, len(phrase)))
        conds = " AND ".join(f"starts_with(t{j}.w, '{w}')" if j == len(phrase) - 1 else f"t{j}.w = '{w}'" for j, w in enumerate(phrase))
        ctes.append(f"p{p} AS (SELECT t0.doc_id, count(*) AS f FROM tok t0 {joins} WHERE {conds} GROUP BY t0.doc_id)")
        ctes.append(f"i{p} AS (SELECT CASE WHEN x <= 0 THEN 1e-6 ELSE x END AS idf FROM (SELECT ln((n - k + 0.5) / (k + 0.5)) AS x FROM (SELECT count(*) AS k FROM p{p}), (SELECT count(*) AS n FROM d)))")
    score = " + ".join(f"i{p}.idf * p{p}.f * 2.2 / (p{p}.f + 1.2 * (0.25 + 0.75 * size / mean))" for p in range(len(phrases)))
    source = " ".join(f"JOIN p{p} USING (doc_id)" for p in range(len(phrases))) + "".join(f", i{p}" for p in range(len(phrases)))
    return f"WITH {', '.join(ctes)} SELECT doc_id AS doc, round(-({score}), 6) AS score FROM st {source}{tail}"


@query(r"""WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')) AS term FROM conversations)
SELECT term, count(*) AS n, count(DISTINCT (conv_id, turn)) AS n_docs FROM t GROUP BY term""")
def fts_index(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), "text")
    postings = search.build_index(turns, ["text"], "id").postings
    per_doc = postings.groupBy("term", "doc").agg(F.count("*").alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


@query(_search_sql(["tion"]))
def search_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, "Tion").select("doc", F.round("score", 6).alias("score"))


@query(_search_sql(["der"], ["sch"]))
def search_multi(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, "der sch").select("doc", F.round("score", 6).alias("score"))


@query(_search_sql(["de", "la"], ["que"]))
def search_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, "de-la qué").select("doc", F.round("score", 6).alias("score"))


@query("WITH s AS (" + _search_sql(["les"]).replace("round(-(", "(-(").replace(", 6)", ")") + ") SELECT s.doc, round(score, 6) AS score, substr(text, 1, 200) AS preview FROM (SELECT * FROM s ORDER BY score, doc LIMIT 20 OFFSET 5) s JOIN documents ON doc_id = doc")
def search_page(spark: SparkSession, d: str) -> DataFrame:
    found = _found(spark, d, "les")
    return search.page(found, table(spark, d, "documents"), "doc_id", "text", 20, 5).withColumn("score", F.round("score", 6))


# ---- rules ------------------------------------------------------------------------------------------------------

_q = lambda *xs: "(" + ", ".join("'" + x + "'" for x in xs) + ")"
_ENDS = ", ".join(_q(*x) for x in verbs.endings())
_ODD = ", ".join(_q(*x) for x in verbs.irregular())


@query(rf"""WITH {TOKENS_SQL}, u AS (SELECT word FROM w UNION SELECT 'a ' || lemma FROM (VALUES {_ODD}) o(lemma, roman, slot, form)),
v AS (SELECT word, regexp_replace(word, '^a +', '') AS lemma FROM u),
c AS (SELECT *, CASE WHEN lemma LIKE '%ea' THEN 'II' WHEN lemma LIKE '%a' THEN 'I' WHEN lemma LIKE '%e' THEN 'III' WHEN lemma LIKE '%i' THEN 'IVi' WHEN lemma LIKE '%î' THEN 'IVa' END AS k FROM v WHERE length(lemma) >= 2),
s AS (SELECT *, left(lemma, length(lemma) - CASE k WHEN 'II' THEN 2 ELSE 1 END) AS stem FROM c WHERE k IS NOT NULL),
ends AS (SELECT * FROM (VALUES {_ENDS}) t(k, roman, slot, prefix, suffix)), odd AS (SELECT * FROM (VALUES {_ODD}) t(lemma, roman, slot, form)),
rule AS (SELECT word, lemma, roman, slot, prefix || stem || suffix AS form FROM s JOIN ends USING (k) UNION ALL SELECT word, lemma, CASE k WHEN 'IVi' THEN 'IV' WHEN 'IVa' THEN 'IV' ELSE k END, 'inf', lemma FROM s),
named AS (SELECT DISTINCT lemma, roman FROM odd),
every AS (SELECT coalesce(r.word, s.word) AS word, coalesce(r.lemma, o.lemma) AS lemma, coalesce(n.roman, r.roman) AS class_roman, coalesce(r.slot, o.slot) AS form_key, coalesce(o.form, r.form) AS form
  FROM rule r FULL JOIN (SELECT s.word, odd.* FROM odd JOIN s USING (lemma)) o ON o.word = r.word AND o.slot = r.slot LEFT JOIN s ON s.word = o.word LEFT JOIN named n ON n.lemma = coalesce(r.lemma, o.lemma))
SELECT word, lemma, class_roman, form_key, form FROM every""")
def conjugate(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([(f"a {x}",) for x in sorted({x[0] for x in verbs.irregular()})], "word string")
    return verbs.conjugate(b.tokens(spark, d).unionByName(known))


@query(rf"""WITH {TOKENS_SQL}, c AS (SELECT word, right(word, 1) AS z, left(word, length(word) - 1) AS cut FROM w)
SELECT word, CASE WHEN z = 'ă' THEN cut || 'e' WHEN z = 'a' THEN cut || 'ale' WHEN word LIKE '%ie' THEN left(word, length(word) - 2) || 'ii' WHEN z IN ('e', 'u') THEN cut || 'i' WHEN regexp_matches(word, '[aăâeiîou]r$') THEN word || 'i'
  WHEN regexp_matches(word, '(al|iu|ol)$') THEN cut || 'e' ELSE word || 'uri' END AS plural,
  CASE WHEN z IN ('ă', 'a', 'e') THEN 'f' WHEN z = 'u' THEN 'm' WHEN regexp_matches(word, '[aăâeiîou]r$') THEN NULL ELSE 'n' END AS gender, CASE WHEN z IN ('ă', 'e') THEN 'high' ELSE 'low' END AS confidence FROM c""")
def pluralize(spark: SparkSession, d: str) -> DataFrame:
    return b.tokens(spark, d).withColumn("p", verbs.pluralize(F.col("word"))).select("word", "p.plural", "p.gender", "p.confidence")


# Known transcriptions, stated apart from the rules.
_SAID = [
    ("copil", "/koˈpil/"), ("ceas", "/t͡ʃas/"), ("ghiozdan", "/ɡjozˈdan/"), ("floare", "/ˈflo̯a.re/"), ("ou", "/ow/"), ("lui", "/luj/"), ("tablou", "/taˈblow/"), ("știință", "/ʃtiˈin.t͡sə/"),
    ("lupi", "/lupʲ/"), ("pomi", "/pomʲ/"),
]
_SAID_SQL = ", ".join(f"('{w}', '{x}')" for w, x in _SAID)
#: Words of open syllables, a plain consonant and a plain vowel each: their transcription follows letter by letter.
_OPEN = "^([bdfklmnprstvz][aăâî]){2,}$"


def spoken_words(spark: SparkSession, d: str) -> DataFrame:
    """All words of the documents, and those whose transcription is known."""
    known = spark.createDataFrame([(w,) for w, _ in _SAID], "word string")
    return b.tokens(spark, d).unionByName(known).distinct()


#: In SQL: the known transcriptions, and those of words of open syllables (stress on the last but one).
SPOKEN_SQL = rf"""{TOKENS_SQL}, k(word, ipa) AS (VALUES {_SAID_SQL}), a AS (SELECT word FROM w UNION SELECT word FROM k),
u AS (SELECT word, list_transform(regexp_extract_all(word, '..'), lambda x: translate(x, 'ăâî', 'əɨɨ')) AS syl FROM a WHERE regexp_matches(word, '{_OPEN}')),
o AS (SELECT word, '/' || array_to_string(list_transform(syl, lambda x, i: CASE WHEN i = len(syl) - 1 THEN 'ˈ' || x WHEN i > 1 THEN '.' || x ELSE x END), '') || '/' AS ipa,
  array_to_string(regexp_extract_all(word, '..'), '-') AS syllabification FROM u)"""


@query(rf"""WITH {SPOKEN_SQL} SELECT a.word, coalesce(k.ipa, o.ipa) AS ipa, o.syllabification, translate(a.word, 'şţ', 'șț') AS letters, 'derived' AS origin, 'low' AS confidence
FROM a LEFT JOIN k ON k.word = a.word LEFT JOIN o ON o.word = a.word""")
def transcribe_words(spark: SparkSession, d: str) -> DataFrame:
    """Transcriptions of all words; ipa and syllabification are shown where SQL can tell them, the letters of the syllables for every word."""
    t = spoken_words(spark, d).withColumn("t", transcribe(F.col("word")))
    known, plain = F.col("word").isin(*[w for w, _ in _SAID]), F.col("word").rlike(_OPEN)
    return t.select("word", F.when(known | plain, F.col("t.ipa")).alias("ipa"), F.when(plain, F.col("t.syllabification")).alias("syllabification"),
                    F.replace("t.syllabification", F.lit("-"), F.lit("")).alias("letters"), "t.origin", "t.confidence")


# ---- import -----------------------------------------------------------------------------------------------------


@query("""WITH j AS (SELECT l_orderkey AS entry_id, l_linenumber, l_partkey, CASE WHEN s_name IS NULL THEN p_name ELSE '[' || s_name || '] ' || p_name END AS text
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = p_size)
SELECT entry_id, row_number() OVER (PARTITION BY entry_id ORDER BY l_linenumber, l_partkey) AS number, text FROM j""")
def import_senses(spark: SparkSession, d: str) -> DataFrame:
    return seed.linked_senses(
        table(spark, d, "orders").select(F.col("o_orderkey").alias("entry_id")),
        table(spark, d, "part").select(F.col("p_partkey").alias("def_id"), F.col("p_size").cast("long").alias("source_id"), F.col("p_name").alias("text")),
        table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entry_id"), F.col("l_partkey").alias("def_id"), F.col("l_linenumber").alias("link_ord")),
        table(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name")),
    )


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')")
def lite_semi(spark: SparkSession, d: str) -> DataFrame:
    return seed.lite(table(spark, d, "customer"), ["Building", "MACHINERY"], "c_mktsegment").select("c_custkey", "c_mktsegment")


@query("""SELECT DISTINCT lower(p_name) AS lemma, 'inflection.' || l_linenumber AS form_key, l_returnflag AS form FROM lineitem JOIN part ON p_partkey = l_partkey WHERE lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_size <= 25)""")
def verb_forms_dedup(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    forms = table(spark, d, "lineitem").select(F.col("l_partkey").alias("lexeme_id"), F.col("l_linenumber").alias("inflection_id"), F.col("l_returnflag").alias("form"))
    lemmas = part.filter("p_size <= 25").select(tx.norm_headword(F.col("p_name")).alias("lemma"))
    return seed.verb_forms(forms, part.select(F.col("p_partkey").alias("lexeme_id"), F.col("p_name").alias("headword")), lemmas)


@query("""WITH r AS (SELECT user_id, event_type, CAST(value AS VARCHAR) AS form, CASE WHEN value < 50 THEN props END AS roman, event_id FROM events),
f AS (SELECT user_id, event_type, arg_max(form, event_id) AS form FROM r GROUP BY ALL), c AS (SELECT user_id, arg_max(roman, event_id) FILTER (WHERE roman IS NOT NULL) AS class_roman FROM r GROUP BY ALL)
SELECT user_id AS lemma, class_roman, string_agg(event_type || '=' || form, '|' ORDER BY event_type) AS forms FROM f JOIN c USING (user_id) GROUP BY ALL""")
def seeded_verbs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(
        F.col("user_id").alias("lemma"), F.col("event_type").alias("form_key"), F.col("value").cast("string").alias("form"), F.when(F.col("value") < 50, F.col("props")).alias("class_roman"), F.col("event_id").alias("row_id")
    )
    pairs = F.array_sort(F.transform(F.map_entries("forms"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return seed.seeded_paradigms(rows).select("lemma", "class_roman", F.array_join(pairs, "|").alias("forms"))


# ---- store ------------------------------------------------------------------------------------------------------

_TTL = {"view": 7, "click": 2, "error": 1, "purchase": 20}
_TTL_SQL = ", ".join(f"('{k}', {v})" for k, v in _TTL.items())
_LATEST = f"""v AS (SELECT user_id, event_type, event_id, ts AS fetched_at FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1),
x AS (SELECT v.*, CASE WHEN days IS NULL THEN TIMESTAMP '9999-12-31 23:59:59' ELSE fetched_at + to_days(CAST(days AS INTEGER)) END AS expires_at FROM v LEFT JOIN (VALUES {_TTL_SQL}) t(kind, days) ON kind = event_type)"""
_NOW = "2024-01-28 12:00:00"


def _stamped(spark: SparkSession, d: str) -> DataFrame:
    last = store.latest(table(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"])
    ttl = F.broadcast(spark.createDataFrame([(k, v * 86400) for k, v in _TTL.items()], "event_type string, ttl_s long"))
    return store.stamp(last.withColumnRenamed("ts", "fetched_at"), ttl, "event_type")


def _now(rows: DataFrame):
    return F.lit(_NOW).cast(dict(rows.dtypes)["fetched_at"])


@query("""SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return store.latest(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""WITH n AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-20') SELECT event_id, user_id, event_type FROM events o WHERE ts < TIMESTAMP '2024-01-20' AND NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = o.user_id AND n.event_type = o.event_type)
UNION ALL SELECT event_id, user_id, event_type FROM n""")
def upsert_replace(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    late = F.col("ts") >= F.lit("2024-01-20").cast(dict(e.dtypes)["ts"])
    return store.upsert(e.filter(~late), e.filter(late), ["user_id", "event_type"]).select("event_id", "user_id", "event_type")


@query(f"WITH {_LATEST} SELECT user_id, event_type, event_id, expires_at FROM x WHERE expires_at > TIMESTAMP '{_NOW}'")
def ttl_fresh(spark: SparkSession, d: str) -> DataFrame:
    rows = _stamped(spark, d)
    return store.fresh(rows, _now(rows)).select("user_id", "event_type", "event_id", "expires_at")


@query(f"WITH {_LATEST} SELECT user_id, event_type FROM x WHERE expires_at >= TIMESTAMP '{_NOW}'")
def ttl_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = _stamped(spark, d)
    return store.sweep(rows, _now(rows)).select("user_id", "event_type")


@query(f"""WITH {_LATEST}, n AS (SELECT user_id, event_type, max(ts) + INTERVAL 90 DAY AS until FROM events WHERE value < 10 GROUP BY ALL)
SELECT user_id, event_type, coalesce(until, expires_at) AS expires_at FROM x LEFT JOIN n USING (user_id, event_type)""")
def revalidate(spark: SparkSession, d: str) -> DataFrame:
    replies = table(spark, d, "events").select("user_id", "event_type", F.when(F.col("value") < 10, 304).otherwise(200).alias("status"), (F.col("ts") + F.expr("INTERVAL 90 DAYS")).alias("new_expires_at"))
    return store.revalidate(_stamped(spark, d), replies, ["user_id", "event_type"]).select("user_id", "event_type", "expires_at")


@query("SELECT event_type AS provider, count(*) FILTER (WHERE value >= 30) AS hits, count(*) FILTER (WHERE value < 30) AS misses FROM events GROUP BY event_type")
def cache_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("provider")).agg(F.count_if(F.col("value") >= 30).alias("hits"), F.count_if(F.col("value") < 30).alias("misses"))


# ---- limits -----------------------------------------------------------------------------------------------------

_FAILED = "event_type IN ('error', 'view', 'signup')"


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Events as calls on a clock that runs 600 times slower, so that limits bite."""
    return table(spark, d, "events").select("user_id", "event_id", F.expr("unix_micros(cast(ts AS timestamp)) DIV 600000").alias("t"), F.expr(_FAILED).alias("failed"))


_CALLS = f"e AS (SELECT user_id, event_id, epoch_us(ts) // 600000 AS t, {_FAILED} AS failed, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 600000, event_id) AS n FROM events)"


@query("SELECT event_id, user_id, used FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS used FROM events) WHERE used <= 2")
def daily_quota(spark: SparkSession, d: str) -> DataFrame:
    return limits.daily_quota(table(spark, d, "events"), "user_id", "ts", "event_id", 2).select("event_id", "user_id", "used")


@query(f"""WITH RECURSIVE {_CALLS}, r AS (SELECT user_id, event_id, t, n, CAST(0 AS BIGINT) AS have, true AS allowed FROM e WHERE n = 1
UNION ALL SELECT user_id, event_id, t, n, h - CASE WHEN h >= 60000 THEN 60000 ELSE 0 END, h >= 60000 FROM (SELECT e.*, least(60000, r.have + e.t - r.t) AS h FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id, event_id, allowed FROM r""")
def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    return limits.token_bucket(_calls(spark, d), "user_id", "t", "event_id", 1).select("user_id", "event_id", "allowed")


@query(f"""WITH RECURSIVE {_CALLS}, s AS (SELECT user_id, event_id, t, n, CAST(CASE WHEN failed THEN 1 ELSE 0 END AS INTEGER) AS run, CAST(-1 AS BIGINT) AS opened, 'closed' AS state FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.event_id, e.t, e.n,
  CASE WHEN s.opened >= 0 AND e.t - s.opened < 60000 THEN s.run WHEN NOT e.failed THEN 0 WHEN s.opened >= 0 OR s.run + 1 >= 5 THEN 5 ELSE s.run + 1 END,
  CASE WHEN s.opened >= 0 AND e.t - s.opened < 60000 THEN s.opened WHEN NOT e.failed THEN -1 WHEN s.opened >= 0 OR s.run + 1 >= 5 THEN e.t ELSE -1 END,
  CASE WHEN s.opened < 0 THEN 'closed' WHEN e.t - s.opened < 60000 THEN 'open' ELSE 'half-open' END FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT user_id, event_id, state FROM s""")
def breaker_states(spark: SparkSession, d: str) -> DataFrame:
    return limits.circuit_breaker(_calls(spark, d), "user_id", "t", "event_id", "failed").select("user_id", "event_id", "state")


@query(f"""WITH {_CALLS}, m AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, failed ORDER BY n) AS run FROM e)
SELECT user_id, min(n) AS first, count(*) AS n FROM m WHERE failed GROUP BY user_id, run HAVING count(*) >= 5""")
def breaker_runs(spark: SparkSession, d: str) -> DataFrame:
    return limits.failure_runs(_calls(spark, d), "user_id", [F.col("t"), F.col("event_id")], F.col("failed")).select("user_id", "first", "n")


@query(f"WITH {_CALLS} SELECT user_id, event_id, max(t - n * 60000) OVER (PARTITION BY user_id ORDER BY n) + n * 60000 AS start_ms FROM e")
def pacing(spark: SparkSession, d: str) -> DataFrame:
    return limits.pace(_calls(spark, d), "user_id", "t", "event_id", 60_000).select("user_id", "event_id", "start_ms")


@query(f"""WITH RECURSIVE {SQL["breaker_states"].split("RECURSIVE ")[1].replace("SELECT user_id, event_id, state FROM s", "")}
SELECT count(*) FILTER (WHERE state = 'open') AS n_open, count(*) AS n_users, count(*) FILTER (WHERE state = 'open') = 0 AS ok FROM (SELECT user_id, arg_max(state, n) AS state FROM s GROUP BY user_id)""")
def health(spark: SparkSession, d: str) -> DataFrame:
    states = limits.circuit_breaker(_calls(spark, d), "user_id", "t", "event_id", "failed")
    last = states.groupBy("user_id").agg(F.max_by("state", F.struct("t", "event_id")).alias("state"))
    return last.agg(F.count_if(F.col("state") == "open").alias("n_open"), F.count("*").alias("n_users"), F.bool_and(F.col("state") != "open").alias("ok"))


# ---- trees and adapters -----------------------------------------------------------------------------------------

_KIND = "CASE l_returnflag WHEN 'N' THEN 'sub-meaning' WHEN 'R' THEN 'example' ELSE 'expression' END"
_LINES = f"""l AS (SELECT l_orderkey, {_KIND} AS type, CAST(l_partkey AS VARCHAR) AS text, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_extendedprice) AS n FROM lineitem),
p AS (SELECT *, CASE WHEN n % 2 = 0 THEN n - 1 ELSE 0 END AS parent FROM l)"""


def _order_trees(spark: SparkSession, d: str) -> DataFrame:
    """An order is a top sense, its odd lines stand below it, an even line below the odd one before it."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice").alias("x"))
    listed = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    none, text = F.array().cast("array<string>"), F.lit(None).cast("string")
    rel = F.struct(*[none.alias(n) for n in ("synonyms", "antonyms", "diminutives", "augmentatives", "hypernyms")])
    node = lambda i, parent, depth, words, kind: F.struct(
        i.cast("int").alias("node_id"), parent.cast("int").alias("parent_id"), depth.cast("int").alias("depth"), F.lit(None).cast("int").alias("number"), words.alias("text"), kind.alias("type"), none.alias("register"),
        text.alias("domain"), text.alias("citation"), none.alias("sources"), rel.alias("relations"),
    )
    kind = lambda x: F.when(x["l_returnflag"] == "N", "sub-meaning").when(x["l_returnflag"] == "R", "example").otherwise("expression")
    below = F.transform("xs", lambda x, i: node(i + 1, F.when(i % 2 == 1, i).otherwise(0), F.when(i % 2 == 1, 2).otherwise(1), x["l_partkey"].cast("string"), kind(x)))
    return listed.select("l_orderkey", F.concat(F.array(node(F.lit(0), F.lit(None), F.lit(0), F.col("l_orderkey").cast("string"), F.lit("meaning"))), below).alias("nodes"))


@query(f"""WITH {_LINES}, k AS (SELECT p.l_orderkey, p.n, p.text FROM p LEFT JOIN p q ON q.l_orderkey = p.l_orderkey AND q.n = p.parent WHERE p.type = 'sub-meaning' AND (p.parent = 0 OR q.type = 'sub-meaning')
  UNION ALL SELECT DISTINCT l_orderkey, 0, CAST(l_orderkey AS VARCHAR) FROM lineitem),
x AS (SELECT l_orderkey, parent AS n, string_agg(text, ',' ORDER BY n) AS examples FROM p WHERE type <> 'sub-meaning' GROUP BY ALL)
SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY k.n) AS INTEGER) AS number, text, coalesce(examples, '') AS examples FROM k LEFT JOIN x USING (l_orderkey, n)""")
def tree_flatten(spark: SparkSession, d: str) -> DataFrame:
    flat = _order_trees(spark, d).select("l_orderkey", F.explode(adapt.flatten_senses(F.col("nodes"))).alias("s"))
    return flat.select("l_orderkey", "s.number", "s.text", F.array_join(F.transform("s.examples", lambda e: e["text"]), ",").alias("examples"))


@query(f"WITH {_LINES} SELECT l_orderkey, n AS node_id, parent AS parent_id, text, type FROM p UNION ALL SELECT DISTINCT l_orderkey, 0, NULL, CAST(l_orderkey AS VARCHAR), 'meaning' FROM lineitem")
def tree_walk(spark: SparkSession, d: str) -> DataFrame:
    out = _order_trees(spark, d).select("l_orderkey", F.explode("nodes").alias("n"))
    return out.select("l_orderkey", F.col("n.node_id").cast("long").alias("node_id"), F.col("n.parent_id").cast("long").alias("parent_id"), "n.text", "n.type")


@query(f"WITH {ENTRIES_SQL} SELECT doc_id AS id, CAST(len(senses) AS INTEGER) AS n_senses, md5(coalesce(list_aggregate(senses, 'string_agg', chr(10)), '')) AS senses_md5 FROM e".replace("doc_id AS id", "CAST(doc_id AS VARCHAR) AS id"))
def lift_round_trip(spark: SparkSession, d: str) -> DataFrame:
    flat = adapt.entry_to_flat(adapt.lift_entries(adapt.entry_to_flat(b.nested_entries(spark, d))))
    return flat.select("id", F.size("senses").alias("n_senses"), F.md5(F.array_join(F.transform("senses", lambda s: s["text"]), "\n")).alias("senses_md5"))


@query(rf"""WITH {ENTRIES_SQL}, {SPOKEN_SQL.replace(TOKENS_SQL, "w AS (SELECT DISTINCT word FROM e)", 1)}
SELECT CAST(doc_id AS VARCHAR) AS id, CAST(CASE WHEN regexp_matches(word, '[a-zăâîșțşţ]') OR regexp_matches(word, '[^\s-][\s-]+[^\s-]') THEN 1 ELSE 0 END AS INTEGER) AS n, o.ipa, o.syllabification
FROM e LEFT JOIN o USING (word)""")
def derive_pronunciations(spark: SparkSession, d: str) -> DataFrame:
    """Entries without a transcription get one; shown is whether, and what it is for words of open syllables."""
    bare = b.nested_entries(spark, d).withColumn("pronunciations", F.filter("pronunciations", lambda p: F.lit(False)))
    said, plain = F.get("pronunciations", F.lit(0)), F.col("display_headword").rlike(_OPEN)
    return adapt.derive_pronunciations(bare).select("id", F.size("pronunciations").alias("n"), F.when(plain, said["ipa"]).alias("ipa"), F.when(plain, said["syllabification"]).alias("syllabification"))


# ---- parsers ----------------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, 'w' || doc_id AS headword, CAST(2 AS INTEGER) AS n_senses, 'substantiv' AS part_of_speech, 'feminin' AS gender, CAST(doc_id % 3 + 1 AS INTEGER) AS homonym_index FROM documents""")
def parse_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Definitions in sigil markup made from documents: a headword with homonym, grammar and two senses of one word each."""
    n = F.col("doc_id").cast("string")
    rep = F.concat(F.lit("@W"), n, F.lit("^"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit(",@ #s. f.# @1.@ Prima. @2.@ A doua."))
    body = F.to_json(F.struct(F.array(F.struct(n.alias("id"), rep.alias("internalRep"), F.col("source").alias("sourceName"))).alias("definitions")))
    raw = table(spark, d, "documents").select(F.lit("dexonline").alias("provider"), n.alias("word"), body.alias("body"))
    return documents.read_entries(raw).select(F.col("word").cast("long").alias("doc_id"), "headword", F.size("senses").alias("n_senses"), "part_of_speech", "gender", "homonym_index")


@query("""WITH l AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '[^A-Za-z0-9 \n]', '', 'g'), chr(10)), lambda x: trim(x) <> '') AS lines FROM documents)
SELECT doc_id, CAST(len(lines) AS INTEGER) AS n_senses FROM l WHERE len(lines) > 0""")
def parse_wiki(spark: SparkSession, d: str) -> DataFrame:
    """Wiki pages made from documents: each line is a sense."""
    n = F.col("doc_id").cast("string")
    lines = F.transform(F.split(F.regexp_replace("text", f"[^{tx.UPPER}{tx.LOWER}{tx.DIGITS} \\n]+", ""), "\n", -1), lambda x: F.concat(F.lit("# "), x))
    wiki = F.concat(F.lit("== {{limba|ron}} ==\n{{-substantiv-|ron}}\n"), F.array_join(lines, "\n"))
    body = F.to_json(F.struct(F.struct(n.alias("title"), wiki.alias("wikitext")).alias("parse")))
    raw = table(spark, d, "documents").select(F.lit("wiktionary").alias("provider"), n.alias("word"), body.alias("body"))
    return documents.read_entries(raw).select(F.col("word").cast("long").alias("doc_id"), F.size("senses").alias("n_senses"))
