"""Queries of state that outlives a run, over the events."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import functions as F

from quarrylark.operators import state
from quarrylark.operators.grams import GramIndex
from quarrylark.operators.keyed import KeyedTable
from quarrylark.plans.bindings import sql_fold, table
from quarrylark.plans.registry import query
from quarrylark.session import cut, shared_folder
from quarrylark.streaming import pipelines, timers


def _users_by_run(spark, sf):
    """The events of a user in each of five runs of six days, as rows of a state."""
    e = table(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    run = F.floor(F.datediff("ts", F.lit("2024-01-01")) / 6).cast("int")
    return e.groupBy(run.alias("run"), "user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count("*").alias("n"), F.max("ts").alias("last_seen"))


def _run_state(spark, sf, compacted):
    """Runs committed one after the other: users whose last event of a run was
    an error are deleted by it."""
    runs = cut(_users_by_run(spark, sf))
    t = KeyedTable(spark, f"{shared_folder(spark)}/keyed-{uuid.uuid4().hex}", ["user_id"], 8)
    for k in range(5):
        rows, gone = runs.where(F.col("run") == k), F.col("last_type") == "error"
        version = t.commit(rows.where(~gone).drop("run"), t.etag(), rows.where(gone).select("user_id"))
        if compacted and k in (1, 3):
            t.compact(version, t.grown() if k == 3 else [0, 3, 5])
    return t


_RUNS = "r AS (SELECT datediff('day', DATE '2024-01-01', ts::DATE) // 6 AS run, user_id, arg_max(event_type, [epoch_us(ts), event_id]) AS last_type, count(*) AS n, max(ts) AS last_seen FROM events GROUP BY 1, 2)"


@query("keyed_state", f"WITH {_RUNS} SELECT user_id, last_type, n, floor(epoch(last_seen))::BIGINT AS last_seen, run AS newest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY run DESC) AS k FROM r) WHERE k = 1 AND last_type <> 'error'")
def keyed_state(spark, sf):
    """STA-01, SNK-01, STA-16: five runs as deltas with deletions, two
    compactions between, one commit that loses; the newest row of each user."""
    t = _run_state(spark, sf, True)
    with contextlib.suppress(state.Conflict):
        t.commit(t.load().limit(0), 1)
    at = F.floor(F.datediff("last_seen", F.lit("2024-01-01")) / 6)
    return t.load().select("user_id", "last_type", "n", F.unix_seconds("last_seen").alias("last_seen"), at.alias("newest"))


@query("keyed_commits", f"WITH {_RUNS} SELECT (run + 1)::BIGINT AS version, last_type = 'error' AS deleted, count(*) AS n FROM r GROUP BY 1, 2")
def keyed_commits(spark, sf):
    """SNK-01: what commits wrote: the rows that a run changed, no others."""
    t = _run_state(spark, sf, False)
    return t.deltas().groupBy("version", "deleted").agg(F.count("*").alias("n"))


@query("keyed_version", f"WITH {_RUNS} SELECT user_id, last_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY run DESC) AS k FROM r WHERE run < 3) WHERE k = 1 AND last_type <> 'error'")
def keyed_version(spark, sf):
    """SRC-41: the state as of the third run, read after the fifth."""
    return _run_state(spark, sf, False).load(3).select("user_id", "last_type", "n")


def _events(spark, sf):
    return pipelines.read_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_watch", """
WITH e AS (SELECT user_id, ts, event_type = 'error' AS failed FROM events),
p AS (SELECT *, lag(ts) OVER w AS before, count(*) FILTER (NOT failed) OVER w AS oks FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
f AS (SELECT *, count(*) FILTER (failed) OVER (PARTITION BY user_id, oks ORDER BY ts) AS streak FROM p),
r AS (SELECT *, lag(streak) OVER (PARTITION BY user_id ORDER BY ts) AS ended FROM f),
last AS (SELECT user_id, max(ts) AS ts FROM e GROUP BY 1)
SELECT user_id, epoch_us(ts)::BIGINT AS at, event FROM (
  SELECT user_id, ts, 'down' AS event FROM r WHERE failed AND streak = 3
  UNION ALL SELECT user_id, ts, 'recovered' FROM r WHERE NOT failed AND ended >= 3
  UNION ALL SELECT user_id, before + INTERVAL 36 HOUR, 'silent' FROM p WHERE ts > before + INTERVAL 36 HOUR
  UNION ALL SELECT user_id, ts, 'back' FROM p WHERE ts > before + INTERVAL 36 HOUR
  UNION ALL SELECT user_id, ts + INTERVAL 36 HOUR, 'silent' FROM last WHERE ts + INTERVAL 36 HOUR <= (SELECT max(ts) FROM e) - INTERVAL 1 HOUR)""")
def stream_watch(spark, sf):
    """STA-08, STA-17, WIN-07: each user as a source, errors as failed runs:
    streaks, recoveries and silences of 36 hours, by state and timers."""
    told = timers.watch_runs(_events(spark, sf), "user_id", "ts", F.col("event_type") == "error", 3, 36.0)
    return pipelines.collect_stream(told, "append").select("user_id", F.unix_micros("at").alias("at"), "event")


@query("stream_reminders", """
WITH o AS (SELECT user_id, min(ts) AS opened FROM events WHERE event_type = 'signup' GROUP BY 1),
c AS (SELECT o.user_id, any_value(opened) AS opened, min(ts) FILTER (ts > opened AND event_type = 'purchase') AS closed, max(ts) AS last FROM o JOIN events e USING (user_id) GROUP BY 1),
d AS (SELECT *, opened + n * INTERVAL 1 DAY AS due FROM c, (VALUES (1), (2), (4)) s(n))
SELECT user_id, epoch_us(due)::BIGINT AS at, 'day ' || n AS event FROM d WHERE (closed IS NULL OR due <= closed) AND due <= greatest(last, (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)""")
def stream_reminders(spark, sf):
    """STA-09, STA-10: a user's first signup opens, the next purchase closes."""
    kind = F.col("event_type")
    told = timers.remind(_events(spark, sf), "user_id", "ts", kind == "signup", kind == "purchase", (1, 2, 4))
    return pipelines.collect_stream(told, "append").select("user_id", F.unix_micros("at").alias("at"), "event")


@query("gram_search", f"SELECT doc_id FROM documents WHERE contains({sql_fold('text')}, 'ation') AND contains({sql_fold('text')}, 'the') AND lang <> 'de'")
def gram_search(spark, sf):
    """FLT-12, VIEW-03, SNK-01: whole texts in the index, those in German taken
    out again, the others changed and changed back; then two words."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    other = docs.withColumn("text", F.when(F.col("lang") == "de", F.col("text")).otherwise(F.lit("nothing of that nation the")))
    index = GramIndex(spark, f"{shared_folder(spark)}/grams-{uuid.uuid4().hex}", 16)
    index.update(other)
    index.update(docs.where("lang <> 'de'"), other)
    return index.search(docs, "The ation").select(F.col("id").alias("doc_id"))
