"""Ranks, views, stores and limits on small tables, hot groups and streams."""

import random

import pandas as pd
from pyspark.sql import functions as F

from lexiforge.operators import store, view
from lexiforge.operators.rank import place_in_groups
from lexiforge.streaming import limits

VIEW = "word string, provider string, source_name string, authority int, senses array<string>, ord long"


def _fold(rows):
    """The rule as a loop: in order of rank, an entry stays if it has no long sense or a new one."""
    from collections import defaultdict

    groups, out = defaultdict(list), set()
    for r in rows:
        groups[r[0], r[1]].append(r)
    for g in groups.values():
        seen = set()
        for r in sorted(g, key=lambda r: (-r[3], -len(r[4]), r[5])):
            keys = [k for k in r[4] if len(k) > 12]
            if not keys or set(keys) - seen:
                seen |= set(keys)
                out.add(r[5])
    return out


def test_covered_entries_are_those_of_the_loop(spark):
    rng = random.Random(1)
    texts = [f"a sense that is long {i}" for i in range(6)] + ["short"]
    rows = [(rng.choice(["w", None]), rng.choice("pq"), f"S{rng.randint(0, 3)}", rng.randint(0, 4), rng.choices(texts, k=rng.randint(0, 3)), i) for i in range(600)]
    df = spark.createDataFrame(rows, VIEW)
    assert {r["ord"] for r in view.drop_covered(df).collect()} == _fold(rows)


def test_view_of_the_known_corpus(spark):
    long = ["o clădire de locuit", "o familie întreagă"]
    rows = [("casă", "d", "Șăineanu, ed. VI", 12, ["altceva mult mai vechi"], 0), ("casă", "d", "DEX '09", 95, long, 1), ("casă", "d", "DOOM 3", 98, [], 2), ("casă", "d", "DLRLC", 90, long[:1], 3), ("unic", "d", "DOOM 3", 98, [], 4)]
    df = spark.createDataFrame(rows, VIEW)
    names = lambda **o: [r["source_name"] for r in view.apply_view(df.filter("word = 'casă'"), **o).orderBy("rank").collect()]
    assert names() == ["DEX '09", "Șăineanu, ed. VI"]
    assert names(orthographic=True)[0] == "DOOM 3"
    assert names(everything=True) == ["DEX '09", "DLRLC", "Șăineanu, ed. VI"]
    assert names(limit=1) == ["DEX '09"]
    assert view.apply_view(df.filter("word = 'unic'")).count() == 1
    assert view.apply_view(df.limit(0)).count() == 0


def test_places_in_a_hot_group(spark):
    rows = [("hot" if i % 3 else None, i * 7 % 5, i) for i in range(500)]
    got = place_in_groups(spark.createDataFrame(rows, "g string, a int, i int"), ["g"], [F.col("a").desc(), F.col("i").asc()]).collect()
    for g in ("hot", None):
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [r["i"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["place"])] == [r[2] for r in want]
        assert sorted(r["place"] for r in got if r["g"] == g) == list(range(1, len(want) + 1))


def test_steps():
    step, state, out = limits.bucket_step(60), None, []
    for _ in range(61):
        state, ok = step(state, 0, None)
        out.append(ok)
    assert out == [True] * 60 + [False]
    assert step(state, 999, None)[1] is False
    assert step(state, 1000, None)[1] is True
    step, state, out = limits.breaker_step(), None, []
    for at, failed in [(0, True)] * 4 + [(1, False)] + [(2, True)] * 5 + [(3, False), (60_001, True), (60_002, False), (120_001, False), (120_002, True)]:
        state, s = step(state, at, failed)
        out.append(s)
    assert out == ["closed"] * 10 + ["open", "open", "half-open", "closed", "closed"]


def test_scans_carry_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = spark.createDataFrame([("a", i * 10, i) for i in range(20)] + [("b", 0, 99), (None, 1, 100)], "k string, t long, i long")
        got = {r["i"]: r["start_ms"] for r in limits.pace(df, "k", "t", "i", 50).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: i * 50 for i in range(20)} | {99: 0}


def test_stream_token_bucket(spark, tmp_path):
    source = tmp_path / "in"
    pd.DataFrame({"k": ["a"] * 3 + ["b"], "t": [0, 1, 2, 0]}).to_parquet(tmp_path / "x.parquet")
    spark.read.parquet(str(tmp_path / "x.parquet")).write.parquet(str(source))
    stream = spark.readStream.schema("k string, t long").parquet(str(source))
    q = limits.stream_token_bucket(stream, "k", "t", 2).writeStream.format("memory").queryName("buckets").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["k"], r["t"], r["allowed"]) for r in spark.table("buckets").collect())
    assert got == [("a", 0, True), ("a", 1, True), ("a", 2, False), ("b", 0, True)]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    make = lambda rows: spark.createDataFrame(rows, "provider_id string, headword string, ord int, x string")
    store.write_snapshot(make([("p", "a", 0, "old"), ("p", "a", 1, "old"), ("p", "b", 0, "old"), ("q", "a", 0, "old")]), path)
    store.merge_into_snapshot(spark, make([("p", "a", 0, "new")]), path)
    got = {(r["provider_id"], r["headword"], r["ord"], r["x"]) for r in spark.read.parquet(path).collect()}
    assert got == {("p", "a", 0, "new"), ("p", "b", 0, "old"), ("q", "a", 0, "old")}
    assert [r["x"] for r in store.lookup(spark, path, "p", "a").collect()] == ["new"]
