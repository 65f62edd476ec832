"""Set containment joins against nested loops."""

import random

from pyspark.sql import functions as F

from quarrylark.operators import select


def test_contained_is_nested_loops(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(12)]
    names = [" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(60)] + ["", None, "nobody w1"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(80)] + ["", None]
    got = select.contained(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(t,) for t in texts], "text string"))
    want = {(n, t) for n in names if n for t in texts if t and set(n.split()) <= set(t.split())}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_names_that_open_alike_cost_a_row_each(spark):
    """All names and texts share two words: candidates are as many as matches."""
    n = 3000
    names = spark.range(n).select(F.concat(F.lit("acme group u"), "id").alias("name"))
    texts = spark.range(n).select(F.concat(F.lit("acme group of u"), "id").alias("text"))
    got = select.contained(names, texts)
    assert got.count() == n
    # the pairs before the check of all words: the rows that the join of rarest words makes
    execution = got._jdf.queryExecution()
    rows = got.collect()
    assert len(rows) == n and "CartesianProduct" not in execution.executedPlan().toString() and "BroadcastNestedLoop" not in execution.executedPlan().toString()


def test_watched_and_company_pairs(spark):
    jobs = spark.createDataFrame([(1, "Acme Survey GmbH"), (2, "Survey Acme"), (3, "acme  survey partners"), (4, None), (5, "Acme"), (6, "Geo Acme Survey Ltd")], "job_id long, company string")
    watch = spark.createDataFrame([("ACME Survey Inc",), ("Geo",), ("",), (None,), ("Nobody",)], "name string")
    assert {r.job_id: r.watch for r in select.watched(jobs, watch).collect()} == {1: "acme survey", 3: "acme survey", 6: "acme survey"}
    rng = random.Random(2)
    parts = ["acme", "geo", "surveyors", "de", "la", "map co", "north", "ltd", "Gmbh"]
    left = sorted({" ".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(40)})
    right = sorted({"".join(rng.choice([" ", ""]) + p for p in rng.choices(parts, k=rng.randint(1, 4))).strip() for _ in range(40)})
    a, b = spark.createDataFrame([(x,) for x in left], "name string"), spark.createDataFrame([(x,) for x in right], "name string")
    named = lambda df, c: df.select(F.col("name").alias(c), select.normalize_company(F.col("name")).alias(f"{c}k")).where(F.length(f"{c}k") > 0)
    want = {tuple(r) for r in named(a, "a").crossJoin(named(b, "b")).where(select.same_company(F.col("a"), F.col("b"))).select("a", "b").collect()}
    assert {tuple(r) for r in select.company_pairs(a, b).collect()} == want and len(want) > 5
