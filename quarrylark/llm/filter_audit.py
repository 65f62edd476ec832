"""Filter interaction audit: which filter removes what, under every order.

The orders of n filters form a trie. It is walked depth first: the survivors
of a state are filtered out of those of the state before and persisted, and at
every edge the rows that the next filter removes are counted among them, by
part. What a set of filters leaves doesn't depend on their order, so a state
is a set: the first path that reaches one computes it, later ones find it done
(2**n states for n! orders). At most n survivors are persisted at a time. A
state's counts are written to the shared folder; the report joins them to the
orders.

Conditions are computed once, before the walk; survivors hold the verdicts,
the part and the two labels, never a text. A survivor frame that an executor
loses is filtered again from the one before, the first is read from a table.

Rows that are repeated count as often as they stand in the table. Null
conditions count as passed, null parts as the empty part, labels that are
missing or null as neither. A document is good or toxic if any row of the
labels says so. An empty table gives an empty report.

The query's conditions on a text (null: empty) are Spark expressions: fewer
than 200 words; fewer distinct words than half; more than 3 % capitals; a
character of `#$%&*|`; the text of a smaller doc_id. Equal texts are those of
equal SHA-256; a document without doc_id is never removed as a copy, and rows
that share a doc_id don't make each other copies. Very long texts cost one
array of their words. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylark.llm.shared import cut, shared_folder, table

WHITE = "\t\n\x0b\x0c\r "
MIN_WORDS, DISTINCT, CAPITALS, SIGNS = 200, 50, 3, "[#$%&*|]"


def orders_of(names: list[str]) -> list[tuple[str, ...]]:
    """All orders of the filters; the report has one row a step of each."""
    if len(names) > 6:
        raise ValueError("the orders of at most six filters are reported")
    return list(permutations(names))


def edge_counts(facts: DataFrame, names: list[str]) -> DataFrame:
    """part, state (the filters applied, sorted, joined), filter, before,
    removed, good_lost, toxic_lost of every edge. facts: part, good, toxic and
    a boolean for each filter, true where it removes the row."""
    spark = facts.sparkSession
    folder = f"{shared_folder(spark)}/edges-{uuid.uuid4().hex}"
    done: set[frozenset[str]] = set()

    # every state counts all filters, those applied remove nothing more: so the compiled code is the same for all
    removed = [
        F.struct(F.lit(f).alias("filter"), F.count_if(f).alias("removed"), F.count_if(F.col(f) & F.col("good")).alias("good_lost"), F.count_if(F.col(f) & F.col("toxic")).alias("toxic_lost"))
        for f in names
    ]

    def count(state: frozenset[str], survivors: DataFrame) -> None:
        found = survivors.groupBy("part").agg(F.count("*").alias("before"), F.array(*removed).alias("edges"))
        found.write.parquet(f"{folder}/state={''.join(sorted(state))}_")

    def walk(state: frozenset[str], survivors: DataFrame) -> None:
        done.add(state)
        survivors = survivors.persist()
        count(state, survivors)
        for f in names:
            following = state | {f}
            if f not in state and len(following) < len(names) and following not in done:
                walk(following, survivors.where(~F.col(f)))
        survivors.unpersist()

    walk(frozenset(), facts.select("part", "good", "toxic", *names))
    kinds = "part string, before long, edges array<struct<filter:string,removed:long,good_lost:long,toxic_lost:long>>, state string"
    found = spark.read.schema(kinds).parquet(folder).withColumn("state", F.rtrim(F.col("state"), F.lit("_")))
    return found.select("part", "state", "before", F.inline("edges")).where(~F.contains("state", "filter"))


def audit(facts: DataFrame, names: list[str]) -> DataFrame:
    """part, filter_order, step, filter and, within the part: kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley (removals of the
    step's filter over all orders)."""
    names = sorted(names)
    if any(len(n) != 1 for n in names):
        raise ValueError("filters are named by one letter each")
    flags = [F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c) for c in ("good", "toxic", *names)]
    facts = cut(facts.select(F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), *flags))
    edges = cut(edge_counts(facts, names))
    # how many orders pass an edge: those of the filters before times those after
    depth = F.length("state")
    ways = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(names) - 1 - k)) for k in range(len(names))]), depth + 1)
    whole = F.when(depth == 0, F.col("removed"))
    last = F.when(depth == len(names) - 1, F.col("removed"))
    totals = edges.groupBy("part", "filter").agg(F.sum(whole).alias("fails"), F.coalesce(F.sum(last), F.lit(0)).alias("unique_fails"), F.sum(F.col("removed") * ways).alias("shapley"))
    steps = [(("".join(o)), k + 1, o[k], "".join(sorted(o[:k]))) for o in orders_of(names) for k in range(len(names))]
    step = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(f).alias("filter"), F.lit(s).alias("state")) for o, k, f, s in steps])
    grid = edges.where("state = ''").select("part").distinct().select("part", F.inline(step))
    counted = {c: F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("before", "removed", "good_lost", "toxic_lost")}
    out = grid.join(edges, ["part", "state", "filter"], "left").join(totals, ["part", "filter"]).select("part", "filter_order", "step", "filter", "fails", "unique_fails", "shapley", *counted.values())
    return out.select(
        "part", "filter_order", "step", "filter", (F.col("before") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


def text_conditions(text: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """What the conditions need of a text, and the conditions A to D over it."""
    needs = {"words": F.split(F.btrim(text, F.lit(WHITE)), r"[\x20\x09-\x0D]+"), "capitals": F.regexp_count(text, F.lit("[A-Z]")), "points": F.length(text), "D": text.rlike(SIGNS)}
    none = F.element_at("words", 1) == ""
    n, distinct = F.when(none, 0).otherwise(F.size("words")), F.when(none, 0).otherwise(F.size(F.array_distinct("words")))
    return needs, {"A": n < MIN_WORDS, "B": 100 * distinct < DISTINCT * n, "C": 100 * F.col("capitals").cast("long") > CAPITALS * F.col("points").cast("long"), "D": F.col("D")}


def document_facts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, A to E of every document; one pass over the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    needs, conditions = text_conditions(F.col("said"))
    read = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("said"))
    read = read.select("doc_id", "part", F.sha2(F.col("said"), 256).alias("digest"), *[c.alias(k) for k, c in needs.items()])
    read = cut(read.select("doc_id", "part", F.unhex("digest").alias("digest"), *[c.alias(k) for k, c in conditions.items()]))
    # only texts that stand more than once go to the join, cut so that a hot text's side is split
    first = cut(read.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    return read.join(first, "digest", "left").withColumn("E", F.col("doc_id") > F.col("first")).join(said, "doc_id", "left").select("part", "good", "toxic", *"ABCDE")


def op12(spark, sf_dir: str) -> DataFrame:
    return audit(document_facts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), list("ABCDE"))


SQL = r"""
WITH said AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM said),
first AS (SELECT t, min(doc_id) AS least FROM said GROUP BY t),
label AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
fact AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        (len(w) < 200)::int AS a, (100 * len(list_distinct(w)) < 50 * len(w))::int AS b,
        (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::int AS c,
        regexp_matches(t, '[#$%&*|]')::int AS d, coalesce(doc_id > least, false)::int AS e
    FROM worded JOIN first USING (t) LEFT JOIN label USING (doc_id)),
grouped AS (SELECT part, good, toxic, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n FROM fact GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
    SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
    FROM letter p, letter q, letter r, letter s, letter t WHERE (p.bit | q.bit | r.bit | s.bit | t.bit) = 31),
steps AS (SELECT filter_order, k::int AS step, bits[k] AS bit, list_sum(bits[1:k - 1]) AS before FROM orders, range(1, 6) AS g(k)),
counted AS (
    SELECT part, filter_order, step, bit,
        sum(n) FILTER (mask & (coalesce(before, 0)::int | bit) = 0) AS kept,
        sum(n) FILTER (mask & coalesce(before, 0)::int = 0 AND mask & bit > 0) AS removed,
        sum(n) FILTER (mask & coalesce(before, 0)::int > 0 AND mask & bit > 0) AS redundant,
        sum(n) FILTER (mask = bit) AS unique_fails,
        sum(n) FILTER (good AND mask & coalesce(before, 0)::int = 0 AND mask & bit > 0) AS good_lost,
        sum(n) FILTER (toxic AND mask & coalesce(before, 0)::int = 0 AND mask & bit > 0) AS toxic_lost
    FROM grouped, steps GROUP BY ALL)
SELECT part, filter_order, step, f AS "filter", coalesce(kept, 0)::bigint AS kept, coalesce(removed, 0)::bigint AS removed, coalesce(redundant, 0)::bigint AS redundant,
    coalesce(unique_fails, 0)::bigint AS unique_fails, coalesce(good_lost, 0)::bigint AS good_lost, coalesce(toxic_lost, 0)::bigint AS toxic_lost,
    coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::bigint AS shapley
FROM counted JOIN letter USING (bit)
"""
