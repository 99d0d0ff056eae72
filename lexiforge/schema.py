"""The entry schema and the small dimension tables that queries broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RELATIONS = "struct<synonyms:array<string>,antonyms:array<string>,diminutives:array<string>,augmentatives:array<string>,hypernyms:array<string>>"
#: A sense tree is an array in pre-order: node_id is the place in it, parent_id the place of the node above (null: top).
NODE = (
    "struct<node_id:int,parent_id:int,depth:int,number:int,text:string,type:string,register:array<string>,"
    f"domain:string,citation:string,sources:array<string>,relations:{RELATIONS}>"
)
INFLECTION = "struct<form:string,tags:array<string>,origin:string,confidence:string>"
PRONUNCIATION = "struct<ipa:string,stress_mark:string,syllabification:string,audio_url:string,audio_mime:string,audio_attribution:string>"
PARADIGM = "struct<model_code:string,class_roman:string,cells:array<struct<tags:array<string>,forms:array<string>>>>"
SOURCE = (
    "struct<provider_id:string,provider_name:string,source_name:string,work_title:string,authority:int,url:string,"
    "license:string,attribution:string,cache_hit:boolean>"
)
ENTRY = (
    "provider_id string, headword string, id string, ord int, display_headword string, homonym_index int, part_of_speech string, gender string, "
    f"inflections array<{INFLECTION}>, paradigm {PARADIGM}, pronunciations array<{PRONUNCIATION}>, senses array<{NODE}>, "
    f"etymology struct<text:string,languages:array<string>>, derived array<string>, compounds array<string>, source {SOURCE}"
)
#: The flat form: one list of senses with their examples.
FLAT_SENSE = (
    "struct<number:int,text:string,register:array<string>,domain:string,examples:array<struct<text:string,citation:string>>,"
    "synonyms:array<string>,antonyms:array<string>>"
)


def entry_type() -> StructType:
    return StructType.fromDDL(ENTRY)


# Dictionaries and their authority, 0 to 100.
AUTHORITY = {
    "DOOM 3": 98, "DOOM 2": 80, "DEX '09": 95, "DEXI": 92, "MDA2": 90, "DEX '98": 78, "DEX '96": 76, "MDN '00": 74, "MDN": 74,
    "NODEX": 72, "DN": 70, "Ortografic": 68, "MDO": 66, "DLRLC": 60, "DLRM": 58, "DER": 52, "DE": 50, "DCR2": 45, "DCR": 44,
    "DRAM 2021": 42, "DRAM 2015": 40, "DRAM": 38, "DGS": 36, "DTM": 34, "D.Religios": 32, "Onomastic": 30, "CECC": 28, "IVO-III": 26,
    "Sinonime": 24, "Sinonime82": 22, "Argou": 20, "CADE": 18, "Scriban": 14, "Șăineanu, ed. VI": 12,
}
DEFAULT_AUTHORITY = 25
# Years of dictionaries, of those that have one.
YEAR = {
    "DOOM 3": 2021, "DOOM 2": 2005, "DEX '09": 2009, "DEXI": 2007, "MDA2": 2010, "DEX '98": 1998, "DEX '96": 1996, "MDN '00": 2000, "NODEX": 2002,
    "DLRLC": 1957, "DLRM": 1958, "DER": 1966, "DCR2": 2013, "DRAM 2021": 2021, "DRAM 2015": 2015, "Sinonime82": 1982, "CADE": 1926, "Scriban": 1939,
    "Șăineanu, ed. VI": 1929,
}
# Dictionaries of spelling only.
ORTHOGRAPHIC = ("DOOM 3", "DOOM 2", "DOOM", "Ortografic", "MDO")
# Id, name, license, capabilities, time to live in days, least interval in ms, concurrency, enabled, authority.
PROVIDERS = [
    ("doom", "DOOM 3", "CC-BY-NC-SA-4.0", ["inflections", "pronunciation_text"], 30, 1500, 1, True, 98),
    ("dexonline", "DEXonline", "GPL-2.0-or-later", ["definitions", "etymology", "examples", "inflections", "register_notes"], 7, 2000, 1, True, 25),
    ("mdex", "m.dex.ro", "GPL-2.0-or-later", ["definitions", "examples"], 7, 2000, 1, False, 40),
    ("wiktionary", "Wikționar (Wiktionary RO)", "CC-BY-SA-4.0", ["definitions", "etymology", "pronunciation_text", "inflections", "examples"], 3, 250, 4, True, 65),
    ("forvo", "Forvo", "proprietary-attribution", ["pronunciation_audio"], 90, 200, 2, False, 55),
    ("dlr", "DLR / TEZAUR", "academic", ["definitions", "etymology", "examples"], 60, 3000, 1, False, 60),
    ("conjugare", "Conjugare RO (rules + seed)", "MIT", ["conjugation", "inflections"], 365, 0, 999, True, 20),
    ("pluralro", "plural-ro (rule-based)", "MIT", ["pluralization", "inflections"], 365, 0, 999, True, 30),
]
# How a provider's entries are credited.
ATTRIBUTION = {
    "doom": "Institutul de Lingvistică „Iorgu Iordan – Al. Rosetti\", DOOM 3",
    "dexonline": "DEXonline.ro contributors; aggregated from DEX, DOOM, DLR and others.",
    "mdex": "m.dex.ro (mirror of DEXonline)",
    "wiktionary": "Wikționar contributors, ro.wiktionary.org (CC BY-SA 4.0)",
    "forvo": "Forvo Pronunciation API; per-clip credit to user.",
    "dlr": "Dicționarul Limbii Române (Academia Română); via dlr1.solirom.ro",
    "conjugare": "Romanian verb-conjugation rules and seed forms from DEX dump.",
    "pluralro": "Romanian pluralization rules; deterministic, no network.",
}
# Where a provider's document on a word lies; {} stands for the word.
URL = {
    "doom": "https://doom.lingv.ro/cautare/q/{}",
    "dexonline": "https://dexonline.ro/definitie/{}/json",
    "mdex": "https://m.dex.ro/?word={}",
    "wiktionary": "https://ro.wiktionary.org/w/api.php?action=parse&page={}&prop=wikitext%7Csections&format=json&formatversion=2&redirects=1",
    "dlr": "https://dlr1.solirom.ro/index.php?cuv={}",
    "conjugare": "urn:local:conjugare:rules",
    "pluralro": "urn:local:pluralro",
}
POS_UNKNOWN = "unknown"


def providers(spark: SparkSession, keys: frozenset[str] = frozenset()) -> DataFrame:
    """The registry; keys: providers that an access key enables."""
    rows = [(*p[:7], p[7] or p[0] in keys, p[8], i, ATTRIBUTION[p[0]], URL.get(p[0])) for i, p in enumerate(PROVIDERS)]
    names = "provider_id string, name string, license string, capabilities array<string>, ttl_days int, min_interval_ms int, concurrency int, enabled boolean, authority int, place int, attribution string, url string"
    return spark.createDataFrame(rows, names)


def authority_of(source_name: Column) -> Column:
    pairs = [F.lit(x) for kv in AUTHORITY.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[source_name], F.lit(DEFAULT_AUTHORITY))


def year_of(source_name: Column) -> Column:
    """The year of a dictionary; null where none is known."""
    return F.create_map(*[F.lit(x) for kv in YEAR.items() for x in kv])[source_name]
