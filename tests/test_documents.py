"""Documents of each kind to entries, and what is done with the entries."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from lexiforge.api import Lexicon, import_dump, to_json
from lexiforge.operators import adapt, merge, search
from lexiforge.sources import documents, parsers, sqldump

DEX = json.dumps({"definitions": [
    {"id": "1", "sourceName": "DEX '09", "internalRep": "@C'ASĂ^1,@ $case,$ #s. f.# @1.@ Clădire care servește drept locuință. * #Expr.# A da în casă, @2.@ Încăpere specială pentru oaspeți."},
    {"id": "2", "sourceName": "DLRLC", "internalRep": "@CASĂ@ #s. f.# @1.@ Clădire care servește drept locuință."},
    {"id": "3", "sourceName": "DOOM 3", "internalRep": "@casă@ #s. f.# forma casei este aceasta"},
    {"id": "4", "sourceName": "MDA2", "internalRep": ""},
]})
DOOM = """<html><root><entry><span style="font-weight: bold">c<span style="text-decoration:underline">a</span>să<sup>2</sup></span> s. f., g.-d. art.
<span style="font-style: italic;">c<u>a</u>sei</span>; pl. <span style="font-style: italic;">case</span> (dar:<span style="font-style:italic"> Casa Corpului, Casa Regală</span> s. f.)</entry>
<entry><span style="font-weight:bold">a merge</span> vb., ind. prez. 1 sg. <span style="font-style:italic">merg</span>, perf. s. 1 sg. <span style="font-style:italic">mersei</span>, 1 pl. <span style="font-style:italic">merserăm</span>;
conj. prez. 3 <span style="font-style:italic">să meargă</span></entry></root></html>"""
WIKI = json.dumps({"parse": {"title": "casă", "wikitext": "=={{limba|ron}}==\n{{-etimologie-}}\nDin latină ''casa''.\n{{-pronunție-}}\n* {{AFI|/'ka.sə/}}\n{{-substantiv-|ron}}\n{{substantiv-ron|gen={{f}}|nom-sg=casă|nom-pl=case}}\n# [[clădire]] de locuit\n#: ''casă mare''\n# familie\n{{-sin-}}\n* locuință, cămin\n=={{limba|eng}}==\n{{AFI|/x/}}"}})
PAGE = """<div class="card"><h3 class="tree-pos-info">substantiv feminin</h3><div class="tree-body"><ul class="meaningTree"><li class="type-meaning depth-0"><div class="meaningContainer"><div class="meaning-row"><span class="bc">1.</span>
<span class="tree-def html">Clădire care servește drept locuință.</span><span class="badge badge-source">DEX '09</span></div><div class="meaning-relations"><span class="tag-group"><span class="text-muted">diminutive:</span><span class="badge-relation"><a>căscioară</a></span></span>
<span class="tag-group"><span class="text-muted">Sinonime:</span><span class="badge-relation"><a>locuință</a></span></span></div></div>
<ul class="meaningTree"><li class="type-example depth-1"><div class="meaningContainer"><div class="meaning-row"><span class="tree-def html"><i>Casa e așezată.</i> STANCU, D. 19. </span></div></div></li></ul></li></ul></div></div>
<div class="paradigmDiv"><div class="card-header">Intrare: <strong>casă (clădire)</strong></div><span class="lexemeName">casă</span><span class="tag"><a>substantiv feminin</a></span><table class="lexeme">
<tr><td class="inflection">nominativ-acuzativ singular nearticulat (<a href="/model-flexiune/F1">F1</a>)</td><td class="form"><ul><li>casă</li></ul></td></tr><tr><td class="inflection">genitiv-dativ plural articulat</td><td class="form"><ul><li>caselor</li></ul></td></tr></table></div>
<div class="paradigmDiv"><span class="lexemeName">x</span><div class="noParadigm"></div></div>"""
VERB = """<table class="lexeme"><tr><td class="inflection" colspan="2" rowspan="3">VT1</td><td class="inflection">infinitiv</td><td class="inflection" colspan="2">imperativ pers. a II-a</td></tr>
<tr><td class="form" rowspan="2"><ul><li>casa</li></ul></td><td class="inflection">singular</td><td class="inflection">plural</td></tr><tr><td class="form"><ul><li>casează</li></ul></td><td class="form"><ul><li>casați</li></ul></td></tr>
<tr><td class="inflection">numărul</td><td class="inflection">persoana</td><td class="inflection">prezent</td></tr><tr><td class="inflection" rowspan="2">singular</td><td class="inflection">I (eu)</td><td class="form"><ul><li>casez</li></ul></td></tr>
<tr><td class="inflection">a II-a (tu)</td><td class="form"><ul><li>casezi</li></ul></td></tr></table>"""
MDEX = "<div class='mydef'><strong>CÁSĂ1,</strong> s. f. <b>1.</b> Clădire mare. 2. Familie <i>de oameni buni</i> (<span>Sursa: DEX '98</span>)<button>Copy</button></div><div class='mydef'>x</div>"
DLR = "<article><h1>casă sf</h1><p class='def'>Clădire de locuit, mare.</p><p class='sens'>Familie.</p></article><article>scurt</article>"
FORVO = json.dumps({"items": [{"word": "casă", "pathmp3": "http://x/1.mp3", "username": "u"}, {"word": "casă"}]})


@pytest.fixture(scope="module")
def raw(spark):
    rows = [("dexonline", "casă", "json", DEX), ("doom", "casă", "html", DOOM), ("wiktionary", "casă", "json", WIKI), ("mdex", "casă", "html", MDEX), ("dlr", "casă", "html", DLR), ("forvo", "casă", "json", FORVO),
            ("dexonline", "casă", "page", PAGE), ("dexonline", "rău", "json", "{"), ("dexonline", "gol", "json", None), (None, None, None, None), ("wiktionary", "lipsă", "json", json.dumps({"error": {"code": "x"}}))]
    return spark.createDataFrame(rows, "provider string, word string, doc_kind string, body string")


def test_each_parser():
    dex = parsers.dexonline(DEX, "casă")
    assert [(e["headword"], e["homonym_index"], e["part_of_speech"], e["gender"], e["source"]["authority"]) for e in dex] == [("casă", 1, "substantiv", "feminin", 95), ("casă", None, "substantiv", "feminin", 60), ("casă", None, "unknown", None, 98)]
    assert [(n["depth"], n["type"]) for n in dex[0]["senses"]] == [(0, "meaning"), (1, "expression"), (0, "meaning")]
    assert dex[0]["pronunciations"][0]["stress_mark"] == "CÁSĂ"
    doom = parsers.doom(DOOM, "casă")
    assert [(i["form"], i["tags"]) for i in doom[0]["inflections"]] == [("casei", ["genitive", "dative", "articulated"]), ("case", ["plural"])]
    assert doom[0]["pronunciations"][0]["stress_mark"] == "cásă"
    verb = parsers.doom(DOOM, "a merge")[0]
    assert [(i["form"], i["tags"][-2:]) for i in verb["inflections"]] == [("merg", ["person:1", "singular"]), ("mersei", ["person:1", "singular"]), ("merserăm", ["person:1", "plural"]), ("meargă", ["present", "person:3"])]
    wiki = parsers.wiktionary(WIKI, "casă")[0]
    assert [n["text"] for n in wiki["senses"]] == ["clădire de locuit", "casă mare", "familie"]
    assert wiki["senses"][0]["relations"]["synonyms"] == ["locuință", "cămin"]
    assert [p["ipa"] for p in wiki["pronunciations"]] == ["/ˈka.sə/"]
    assert (wiki["gender"], [i["form"] for i in wiki["inflections"]], wiki["etymology"]["languages"]) == ("feminin", ["casă", "case"], ["latină"])
    mdex = parsers.mdex(MDEX, "casă")
    assert [(e["display_headword"], e["homonym_index"], e["source"]["source_name"], [n["number"] for n in e["senses"]]) for e in mdex] == [("CÁSĂ", 1, "DEX '98", [1, None, 2])]
    assert [[n["text"] for n in e["senses"]] for e in parsers.dlr(DLR, "casă")] == [["Clădire de locuit, mare.", "Familie."]]
    assert [len(e["pronunciations"]) for e in parsers.forvo(FORVO, "casă")] == [1]
    for f in parsers.PARSERS.values():
        for bad in ("", "{", "[]", "<", "null", "<entry></entry>", "<div class='mydef'>"):
            assert f(bad, "casă") == []


def test_pages_and_tables():
    (tree,) = parsers.meaning_trees(PAGE)
    assert tree["pos_info"] == "substantiv feminin"
    assert [(n["text"], n["citation"]) for n in tree["nodes"]] == [("Clădire care servește drept locuință.", None), ("Casa e așezată.", "STANCU, D. 19.")]
    assert tree["nodes"][0]["relations"]["diminutives"] == ["căscioară"]
    (p,) = parsers.paradigms(PAGE)
    assert (p["lexeme"], p["paradigm"]["model_code"], p["label"]) == ("casă", "F1", "casă (clădire)")
    assert [i["tags"] for i in p["inflections"]] == [["nominative", "accusative", "singular", "unarticulated"], ["genitive", "dative", "plural", "articulated"]]
    cells, _ = parsers.read_table(parsers.parse(VERB).first("table"))
    assert {c["forms"][0]: c["tags"] for c in cells} == {"casa": ["infinitive"], "casează": ["imperative", "singular", "person:2"], "casați": ["imperative", "plural", "person:2"], "casez": ["present", "singular", "person:1"], "casezi": ["present", "singular", "person:2"]}


def test_lookup(spark, raw):
    lex = Lexicon.from_documents(spark, raw, ["forvo"])
    words = spark.createDataFrame([("casă",), ("<x>",), (None,)], "word string")
    rows = lex.lookup(words).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        by.setdefault(r["provider_id"], []).append(r)
    assert set(by) == {"dexonline", "doom", "wiktionary", "forvo"}  # mirrors are off by default
    assert [r["source"]["source_name"] for r in by["dexonline"]] == ["DEX '09"]  # spelling filtered, the covered one dropped
    assert len(by["doom"]) == 1  # nothing else there, so it stays
    top = by["dexonline"][0]  # places of marks are those before the accent is taken out, hence the 2 below
    assert [(n["text"], n["type"]) for n in top["senses"]][1:3] == [("Expr. A da în casă, 2", "expression"), ("Casa e așezată.", "example")]
    assert top["senses"][0]["relations"]["diminutives"] == ["căscioară"]
    assert [n["parent_id"] for n in top["senses"]] == [None, 0, 0, None]
    assert [i["form"] for i in top["inflections"]] == ["casă", "caselor"]
    assert top["pronunciations"][0]["ipa"] == "/ˈka.sə/"
    assert [p["ipa"] for p in by["wiktionary"][0]["pronunciations"]] == ["/ˈka.sə/"]
    assert {r["provider_id"] for r in lex.lookup(words, sources=["mdex"]).collect()} == {"mdex"}
    assert [r["source"]["source_name"] for r in lex.lookup(words, sources=["dexonline"], everything=True, orthographic=True).orderBy("rank").collect()] == ["DOOM 3", "DEX '09", "DLRLC"]
    assert [r["source"]["source_name"] for r in lex.lookup(words, dictionaries=["dlrlc"]).collect()] == ["DLRLC"]
    flat = lex.lookup(words, sources=["dexonline"], flat=True).collect()
    assert [e["text"] for e in flat[0]["senses"][0]["examples"]] == ["Expr. A da în casă, 2", "Casa e așezată."]
    merged = lex.lookup(words, merged=True).collect()
    assert {(r["lemma"], r["pos"], r["homonym"]) for r in merged} == {("casă", "substantiv", 1), ("casă", "", 1)}
    one = next(r for r in merged if r["pos"])
    assert one["contributors"] == ["DOOM 3", "DEXonline", "Wikționar (Wiktionary RO)"]
    assert [n["number"] for n in one["senses"] if n["depth"] == 0] == [1, 2, 3, 4]
    assert all(n["parent_id"] is None or n["parent_id"] < n["node_id"] for n in one["senses"])
    assert to_json(lex.lookup(words)).count() == len(rows)
    assert documents.errors(raw).count() == 0
    assert {r["audio_url"] for r in lex.audio().collect()} == {"http://x/1.mp3"}
    assert lex.sources().count() == 8


def test_search_folds_and_ranks(spark):
    docs = spark.createDataFrame([(1, "casă", "Clădire pentru locuință"), (2, "masă", "Obiect în casă"), (3, "de casă", None)], "id long, headword string, text string")
    index = search.build_index(docs, ["headword", "text"], "id")
    found = lambda q: {r["doc"] for r in search.search(index, q).collect()}
    assert found("casa") == {1, 2, 3}
    assert found("LOCUIN") == {1}
    assert found("de-cas") == {3}
    assert found("casa obiect") == {2}
    for q in ("^^^", "AND OR NOT", '"', "-", "***"):
        assert found(q) == set()


def test_merging_rules(spark):
    items = spark.createDataFrame([("k", 1, "case", ["plural", "x"], "derived", "low"), ("k", 2, "case", ["x", "plural"], "attested", "high"), ("k", 3, "casă", ["x"], "derived", "low")], "lemma string, at int, form string, tags array<string>, origin string, confidence string")
    got = merge.merge_inflections(items, ["lemma"]).orderBy("at").collect()
    assert [(r["at"], r["form"], r["origin"]) for r in got] == [(1, "case", "attested"), (3, "casă", "derived")]
    said = spark.createDataFrame([("k", 1, "a", "s1", None), ("k", 2, "a", "s2", None), ("k", 3, "b", None, "u"), ("k", 4, None, None, "u")], "lemma string, at int, ipa string, stress_mark string, audio_url string")
    got = merge.merge_pronunciations(said, ["lemma"], ["ipa", "stress_mark", "audio_url"]).orderBy("at").collect()
    assert [(r["ipa"], r["stress_mark"], r["audio_url"]) for r in got] == [("a", "s2", None), ("b", None, "u"), (None, None, "u")]


def test_flat_form_round_trip(spark):
    flat = spark.createDataFrame([(
        [(1, "unu", ["reg"], None, [("ex", "cit"), ("ex2", None)], ["s"], []), (2, "doi", [], "d", [], [], ["a"])],
    )], "senses array<struct<number:int,text:string,register:array<string>,domain:string,examples:array<struct<text:string,citation:string>>,synonyms:array<string>,antonyms:array<string>>>")
    nodes = flat.select(adapt.lift_senses(F.col("senses")).alias("n"))
    assert [(n["node_id"], n["parent_id"], n["depth"]) for n in nodes.first()["n"]] == [(0, None, 0), (1, 0, 1), (2, 0, 1), (3, None, 0)]
    back = nodes.select(adapt.flatten_senses(F.col("n")).alias("senses"))
    assert back.first()["senses"] == flat.first()["senses"]


def test_dump(spark, tmp_path):
    sql = (
        "-- x\nCREATE TABLE `Entry` (\n  `id` int,\n  `description` varchar(9),\n  `partOfSpeech` text\n);\nINSERT INTO `Entry` VALUES (1,'casă; (a)','substantiv'),(2,'O\\'Brien',NULL),(3,'merge x',NULL);\n"
        "CREATE TABLE `Secret` (\n `id` int\n);\nINSERT INTO `Secret` VALUES (1);\nINSERT INTO `Source` VALUES (7,'DEX','d',NULL,2009);\n"
        "INSERT INTO `Definition` VALUES (10,7,'@CASĂ@ $f.$ clădire',NULL,0,''),(11,0,'familie''s',NULL,0,''),(12,7,'',NULL,0,'');\nINSERT INTO `EntryDefinition` VALUES (1,11),(1,10),(9,10),(2,12);\n"
        "INSERT INTO `Lexeme` VALUES (5,'merge','merge','merge','V',1);\nINSERT INTO `InflectedForm` VALUES (1,5,60,'merg','merg'),(2,5,60,'merg','merg'),(3,6,1,'x','x');"
    )
    path = tmp_path / "dump.sql.gz"
    path.write_bytes(gzip.compress(sql.encode()))
    out = import_dump(spark, str(path))
    assert {(r["entry_id"], r["lemma"], r["part_of_speech"]) for r in out["entries"].collect()} == {(1, "casă;", "substantiv"), (2, "o'brien", None), (3, "merge", None)}
    assert [(r["entry_id"], r["number"], r["text"]) for r in out["senses"].orderBy("number").collect()] == [(1, 1, "familie's"), (1, 2, "[DEX] CASĂ f. clădire")]
    assert [tuple(r) for r in out["verb_forms"].collect()] == [("merge", "inflection.60", "merg")]
    assert {r["name"]: r["n"] for r in out["summary"].collect()} == {"entries": 3, "senses": 2, "inflected_forms": 1, "lexemes": 1}
    assert import_dump(spark, str(path), ["Merge"])["entries"].count() == 1
    with pytest.raises(Exception, match="table is one of"):
        spark.read.format("sqldump").option("table", "Secret").load(str(path))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_statements_in_pieces(size):
    text = "a 'x;''y\\';' b; c \"d;\" `e;`;f"
    assert list(sqldump.statements(text[i : i + size] for i in range(0, len(text), size))) == ["a 'x;''y\\';' b", 'c "d;" `e;`', "f"]
    assert list(sqldump.tuples("INSERT INTO `t` VALUES (1,'a\\n(b)',NULL),(-2.5,'',x)")) == [["1", "a\n(b)", None], ["-2.5", "", "x"]]


def test_titles_of_recordings(spark):
    hits = spark.createDataFrame([("casă", "File:LL-ron-x-casandra.wav", 0), ("casă", "File:LL-ron-x-Casă.wav", 1), ("casă", "File:Ro_casă.ogg", 2), ("ou", "File:ou", 0)], "word string, title string, place int")
    assert [tuple(r) for r in documents.exact_titles(hits).collect()] == [("casă", "File:LL-ron-x-Casă.wav")]
