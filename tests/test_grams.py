"""The trigram index against a scan of all rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quarrylark.operators import select
from quarrylark.operators.grams import GramIndex, grams_of

SAY = ["maps", "Geodésie", "remote sensing", "GIS analyst", "ab", "c++ and", "é", "ging", "Zürich", "mapsmaps"]


def some(rng, k):
    return (k, rng.choice([None, "", " ".join(rng.choices(SAY, k=rng.randint(1, 6)))]) if rng.random() < 0.2 else " ".join(rng.choices(SAY, k=rng.randint(1, 8))))


def test_search_is_the_scan(spark, tmp_path):
    rng = random.Random(1)
    index, state = GramIndex(spark, f"file://{tmp_path}/grams", 8), {}
    assert index.search(spark.createDataFrame([(1, "maps")], "id long, text string"), "maps").count() == 0  # nothing is indexed
    for step in range(3):
        new = dict(some(rng, k) for k in rng.sample(range(60), 40))
        gone = set(rng.sample(sorted(state), 5)) - set(new) if state else set()
        old = {k: v for k, v in state.items() if k in new or k in gone}
        frame = lambda rows: spark.createDataFrame(list(rows.items()), "id long, text string")
        index.update(frame(new), frame(old) if old else None)
        state = {k: v for k, v in {**state, **new}.items() if k not in gone}
        rows = frame(state)
        for query in ("maps", "GEODESIE zurich", "sensing  gis", "ab", "mapsmap", "nobody", "", "an c++", "ging é"):
            want = {r.id for r in select.search(rows, query, ["text"]).collect()}
            assert {r.id for r in index.search(rows, query).collect()} == want, query


def test_candidates_are_few_and_buckets_pruned(spark, tmp_path):
    index = GramIndex(spark, f"file://{tmp_path}/grams", 16)
    rows = spark.range(3000).select("id", F.concat(F.lit("posting number "), "id").alias("text"))
    index.update(rows)
    index.table.compact(index.table.etag())
    found = index.candidates("number 1234")
    plan = index.table.where_in("gram", ["123", "234"])._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in found.collect()] == [1234] and [r.id for r in index.search(rows, "number 1234").collect()] == [1234]
    assert "PartitionFilters" in plan and "In(gram" in plan.replace("IN(", "In(")


def test_grams_of_long_texts_take_linear_time(spark):
    """A gram by its place in the text took the square of the length."""
    texts = [None, "", "ab", "abc", "aaaa", "né 😀 c", "0123456789 é" * 40_000]
    began = time.monotonic()
    got = [r.g for r in spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", grams_of(F.col("text")).alias("g")).orderBy("id").collect()]
    assert time.monotonic() - began < 20
    assert [set(g) for g in got] == [{t[k : k + 3] for k in range(len(t) - 2)} if t else set() for t in texts] and all(len(g) == len(set(g)) for g in got)


def test_updates_write_changes_only_and_refuse_ids_twice(spark, tmp_path):
    index = GramIndex(spark, f"file://{tmp_path}/grams", 4)
    frame = lambda *rows: spark.createDataFrame(list(rows), "id long, text string")
    index.update(frame((1, "abcd"), (2, "same"), (3, "gone"), (4, None)))
    index.update(frame((1, "bcde"), (2, "Same "), (5, "ab")), frame((1, "abcd"), (2, "same"), (3, "gone")))
    assert {(r.gram, r.id, r.deleted) for r in index.table.deltas().where("version = 2").collect()} == {("cde", 1, False), ("abc", 1, True), ("gon", 3, True), ("one", 3, True)}
    assert {(r.gram, r.id) for r in index.table.load().collect()} == {("bcd", 1), ("cde", 1), ("sam", 2), ("ame", 2)}
    for bad in ((1, "x y z"), (None, "abc")):
        with pytest.raises(ValueError, match="null or stand twice"):
            index.update(frame((1, "other"), bad))
