"""Page texts and trees by the fast reader, grammar labels, and work that grows with the input."""

import time

from pyspark.sql import functions as F

from lexiforge.functions import dom, markup
from lexiforge.operators import adapt
from lexiforge.sources import documents


def test_a_reference_without_its_semicolon_is_text(spark):
    rows = [("<p>a&amp</p><p>b&amp;c&amp;lt &copy 2&nbsp;x &#39;</p><style>&amp</style>",), (None,), ("&ampx; &nosuch; & &",)]
    got = spark.createDataFrame(rows, "html string").coalesce(1).select(documents.html_text(F.col("html"))).collect()
    assert [r[0] for r in got] == ["a&ampb&c&lt &copy 2 x '", None, "&ampx; &nosuch; & &"]


def test_labels_are_searched_only_where_their_letters_stand():
    assert markup.read_register("(pop. și fig.) rar x") == ["figurat", "popular", "rar"]
    assert markup.read_grammar("s. f. pl.")[:2] == ("substantiv", "feminin") and markup.read_grammar("xart artx")[0] == "unknown"
    text = "lorem ipsum dolor sit amet " * 8
    began = time.process_time()
    for _ in range(1000):
        markup.read_grammar(text)
    assert time.process_time() - began < 0.5


def _nodes(n):
    """n top senses with an example below each, in pre-order."""
    rel = "struct(array('y') as synonyms, cast(array() as array<string>) as antonyms, cast(array() as array<string>) as diminutives, cast(array() as array<string>) as augmentatives, cast(array() as array<string>) as hypernyms)"
    none = "cast(array() as array<string>) as register, cast(null as string) as domain, cast(null as string) as citation, cast(array() as array<string>) as sources"
    top = f"struct(cast(2 * i as int) as node_id, cast(null as int) as parent_id, 0 as depth, cast(i + 1 as int) as number, concat('s', i) as text, 'meaning' as type, {none}, {rel} as relations)"
    low = f"struct(cast(2 * i + 1 as int) as node_id, cast(2 * i as int) as parent_id, 1 as depth, cast(null as int) as number, concat('e', i) as text, 'example' as type, {none}, {rel} as relations)"
    return F.expr(f"flatten(transform(sequence(0, {n - 1}), i -> array({top}, {low})))")


def test_long_trees_are_enriched_and_flattened_in_time(spark):
    one = spark.range(1).select(_nodes(800).alias("tree")).withColumn("senses", F.filter("tree", lambda x: x["depth"] == 0))
    nodes = F.transform("senses", lambda x, i: x.withField("node_id", i))
    one = one.withColumn("senses", nodes).localCheckpoint()
    began = time.time()
    out = one.select(adapt._enriched(F.col("senses"), F.col("tree")).alias("x"), adapt.flatten_senses(F.col("tree")).alias("f")).collect()[0]
    assert time.time() - began < 40
    assert [(n["node_id"], n["parent_id"], n["text"]) for n in out["x"]] == [r for i in range(800) for r in ((2 * i, None, f"s{i}"), (2 * i + 1, 2 * i, f"e{i}"))]
    assert [(s["number"], s["text"], [e["text"] for e in s["examples"]]) for s in out["f"]] == [(i + 1, f"s{i}", [f"e{i}"]) for i in range(800)]


def test_plain_pages_get_the_tree_of_the_standard_parser():
    flat = lambda n: (n.tag, n.attrs, n.classes, [c if isinstance(c, str) else flat(c) for c in n.children])
    for html in ("<ul><li class='a b'>x &amp y<li>z</ul><br>t<p/><P>u<p>v</p ></q>&lt;", "<td a><th b=\"1\" b='2'>x</td></div>"):
        b = dom._Builder()
        b.feed(html)
        b.close()
        assert flat(dom._plain(html)) == flat(b.root)
    for odd in ("<a title='x>y'>", "a < b", "<!-- c -->", "<script>a</script>", "<a b=c>", "</>"):
        assert dom._plain(odd) is None
