"""Merge-on-read state against a plain dictionary."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quarrylark.operators import state
from quarrylark.operators.keyed import KeyedTable, merge_run

KIND = "k string, v int, w array<int>"


def rows_of(df):
    return {r.k: (r.v, r.w) for r in df.collect()}


def files(folder):
    return sum(f.endswith(".parquet") for _, _, names in os.walk(folder) for f in names)


def test_commits_deletions_and_compaction_are_a_dictionary(spark, tmp_path):
    rng, want, seen = random.Random(4), {}, []
    t = KeyedTable(spark, f"file://{tmp_path}/t", ["k"], 4)
    assert t.load() is None and t.matching(spark.createDataFrame([("a",)], "k string")) is None and t.grown() == []
    for version in range(1, 7):
        changed = {f"k{rng.randint(0, 40)}": (rng.choice([None, version]), [version]) for _ in range(12)}
        gone = {f"k{rng.randint(0, 40)}" for _ in range(4)} - set(changed)
        df = spark.createDataFrame([(k, *v) for k, v in changed.items()], KIND)
        assert t.commit(df, t.etag(), spark.createDataFrame([(k,) for k in gone], "k string")) == t.etag()
        assert t.manifest()["sizes"][-1] == len(changed) + len(gone)  # a commit writes its changes only
        want = {k: v for k, v in {**want, **changed}.items() if k not in gone}
        assert rows_of(t.load()) == want
        seen.append((t.etag(), dict(want)))
        if version in (3, 5):
            assert t.compact(t.etag(), t.grown(0.5) if version == 5 else [0, 2]) == t.etag()
            assert rows_of(t.load()) == want
    for version, then in seen:
        assert rows_of(t.load(version)) == then
    asked = spark.createDataFrame([("k1",), ("k2",), ("nobody",), ("k1",)], "k string")
    assert rows_of(t.matching(asked)) == {k: v for k, v in want.items() if k in ("k1", "k2")}
    t.compact(t.etag())
    assert t.manifest()["deltas"] == [] and rows_of(t.load()) == want
    old = KeyedTable(spark, t.folder, ["k"], 4, grace=0.0)
    before = files(f"{tmp_path}/t")
    assert old.retain(1) and files(f"{tmp_path}/t") < before and rows_of(old.load()) == want and len(old.versions()) == 1


def test_conflicts_and_refusals(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", ["k"], 2)
    one = spark.createDataFrame([("a", 1, [1])], KIND)
    t.commit(one, 0)
    for refused in ([("a", 1, []), ("a", 2, [])], [(None, 1, [])]):
        with pytest.raises(ValueError):
            t.commit(spark.createDataFrame(refused, KIND), 1)
    with pytest.raises(ValueError):
        t.commit(one.drop("w"), 1)
    with pytest.raises(ValueError):
        t.commit(one.withColumn("v", F.col("v").cast("long")), 1)
    with pytest.raises(ValueError):
        KeyedTable(spark, t.folder, ["k"], 3).load()
    assert t.commit(spark.createDataFrame([("b", 2, [])], KIND), 1) == 2
    with pytest.raises(state.Conflict):
        t.commit(spark.createDataFrame([("c", 3, [])], KIND), 1)
    with pytest.raises(state.Conflict):
        t.compact(1)
    assert rows_of(t.load()) == {"a": (1, [1]), "b": (2, [])}
    assert t.commit(one.limit(0), 2) == 3 and len(t.manifest()["deltas"]) == 2  # nothing changed: no delta
    assert t.commit(one.limit(0), 3, spark.createDataFrame([("a",), ("nobody",)], "k string")) == 4 and rows_of(t.load()) == {"b": (2, [])}


def test_only_asked_buckets_are_read(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", ["k"], 16)
    t.commit(spark.range(2000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(1).alias("v"), F.array(F.lit(1)).alias("w")), 0)
    t.compact(1)
    read = t.matching(spark.createDataFrame([("k7",), ("k7",)], "k string"))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert rows_of(read) == {"k7": (1, [1])} and any("PartitionFilters" in x and "(bucket" in x.split("PartitionFilters")[1].split("PushedFilters")[0] for x in plan.split("\n"))


def test_a_run_is_merged_like_a_whole_state(spark, tmp_path):
    """Three runs through the table are three full merges."""
    kind = "canonical_id string, title string, description string, priority int, last_seen timestamp"
    empty = spark.createDataFrame([], kind + ", first_seen timestamp, changes array<struct<at:timestamp,fields:array<string>>>")
    t, whole = KeyedTable(spark, f"file://{tmp_path}/t", ["canonical_id"], 4), empty
    for run in range(3):
        at = F.lit(f"2026-09-1{run} 12:00:00").cast("timestamp")
        seen = spark.createDataFrame([(f"j{k}", f"title {(k * run) % 5}", "x" * (k * 40 * (run + 1)), 40 + k % 3, None) for k in range(run * 5, run * 5 + 12)], kind).withColumn("last_seen", at)
        version, rows = merge_run(t, seen, at, ["title", "description"], empty)
        assert version == run + 1 and t.manifest()["sizes"][-1] == 12
        whole = spark.createDataFrame(state.upsert(whole, seen, at, ["title", "description"]).drop("action").select(*empty.columns).collect(), empty.schema)
        assert sorted(map(str, t.load().select(*empty.columns).collect())) == sorted(map(str, whole.collect()))
