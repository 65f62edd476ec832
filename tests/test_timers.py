"""Timers over streams against the same rules in plain code, whatever the batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quarrylark.streaming import pipelines, timers

T0 = dt.datetime(2026, 9, 1, tzinfo=dt.timezone.utc)


def rows_of(seed, keys=6, n=160):
    rng, at, out = random.Random(seed), T0, []
    for _ in range(n):
        at += dt.timedelta(minutes=rng.choice([1, 40, 200, 700]))
        out.append((rng.choice("abcdefgh"[:keys]), at, rng.choice(["ok", "error", "error", "open", "close"])))
    return out


def stream_of(spark, folder, rows, files):
    folder.mkdir(parents=True, exist_ok=True)
    size = -(-len(rows) // files)
    for k in range(0, len(rows), size):
        part = spark.createDataFrame(rows[k : k + size], "k string, at timestamp, what string")
        part.coalesce(1).write.mode("append").parquet(f"file://{folder}/{k:05d}")
    return spark.readStream.schema("k string, at timestamp, what string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{folder}")


def told(df):
    return sorted((r.k, r.at.astimezone(dt.timezone.utc) if r.at.tzinfo else r.at, r.event) for r in df.select("k", F.col("at"), "event").collect())


def plain_watch(rows, limit, stale, late):
    out = []
    end = max(at for _, at, _ in rows) - late
    for key in {k for k, _, _ in rows}:
        mine = [(at, what == "error") for k, at, what in rows if k == key]
        streak, alarmed, last = 0, False, None
        for at, failed in mine:
            if last and at > last + stale:
                out += [(key, last + stale, "silent"), (key, at, "back")]
            streak = streak + 1 if failed else 0
            if streak == limit:
                out.append((key, at, "down"))
                alarmed = True
            if not failed and alarmed:
                out.append((key, at, "recovered"))
                alarmed = False
            last = at
        if last + stale <= end:
            out.append((key, last + stale, "silent"))
    return sorted(out)


def naive(events):
    return sorted((k, at.replace(tzinfo=None), e) for k, at, e in events)


@pytest.mark.parametrize("files", [1, 5])
def test_watched_runs(spark, tmp_path, files):
    rows = rows_of(1)
    stream = timers.watch_runs(stream_of(spark, tmp_path / "in", rows, files), "k", "at", F.col("what") == "error", 2, 30.0)
    got = naive(told(pipelines.collect_stream(stream, "append")))
    want = plain_watch(rows, 2, dt.timedelta(hours=30), dt.timedelta(hours=1))
    assert got == naive(want) and {e for *_, e in got} == {"down", "recovered", "silent", "back"}


def test_a_restart_goes_on_from_its_state(spark, tmp_path):
    """Two runs over one checkpoint tell what one run over all tells."""
    rows = rows_of(2)
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    write = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    for part in (rows[:90], rows[90:]):
        size = len(list(folder.iterdir())) if folder.exists() else 0
        stream_of(spark, folder / f"run{size}", part, 2)
        stream = spark.readStream.schema("k string, at timestamp, what string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{folder}")
        watched = timers.watch_runs(stream, "k", "at", F.col("what") == "error", 2, 30.0)
        pipelines.run_once(watched, write, f"file://{tmp_path}/checkpoint")
    want = plain_watch(rows, 2, dt.timedelta(hours=30), dt.timedelta(hours=1))
    assert naive(told(spark.read.parquet(out))) == naive(want)


def test_reminders(spark, tmp_path):
    rows = rows_of(3, 8)
    stream = timers.remind(stream_of(spark, tmp_path / "in", rows, 3), "k", "at", F.col("what") == "open", F.col("what") == "close", (1, 3))
    got = naive(told(pipelines.collect_stream(stream, "append")))
    want, end = [], max(at for _, at, _ in rows) - dt.timedelta(hours=1)
    for key in {k for k, _, _ in rows}:
        mine = [(at, what) for k, at, what in rows if k == key]
        opened = next((at for at, what in mine if what == "open"), None)
        closed = next((at for at, what in mine if what == "close" and opened and at > opened), None)
        for days in (1, 3):
            due = opened + dt.timedelta(days=days) if opened else None
            if due and (not closed or due <= closed) and due <= max(end, mine[-1][0]):
                want.append((key, due, f"day {days}"))
    assert got == naive(want) and len(got) > 2


def test_late_rows_change_nothing(spark, tmp_path):
    h = lambda n: T0 + dt.timedelta(hours=n)
    rows = [("a", h(1), "error"), ("a", h(5), "ok"), ("b", h(40), "ok"), ("a", h(2), "error"), ("a", h(41), "error"), ("a", h(42), "error")]
    stream = timers.watch_runs(stream_of(spark, tmp_path / "in", rows, 6), "k", "at", F.col("what") == "error", 2, 100.0)
    assert naive(told(pipelines.collect_stream(stream, "append"))) == naive([("a", h(42), "down")])
