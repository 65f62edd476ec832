"""The landing folder: only what is asked for is opened, streams resume."""

import datetime as dt
import os
import time

import pytest

from quarrylark.sources.landing import LandingFolder, landed
from quarrylark.streaming import pipelines

AGO = time.time() - 100


def put(folder, source, day, name, body, at=0.0):
    path = folder / f"source={source}" / f"day={day}"
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_bytes(body)
    os.utime(path / name, (AGO + at,) * 2)


@pytest.fixture()
def landing(spark, tmp_path):
    spark.dataSource.register(LandingFolder)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    folder = tmp_path / "landing"
    for k in range(4):
        put(folder, "a", f"2026-09-0{k + 1}", f"f{k}", f"a {k}".encode(), k)
        put(folder, "bad", f"2026-09-0{k + 1}", "broken", b"\xff\xfe\xff", k)  # raises when it is opened
    put(folder, "a", "2026-09-02", "_SUCCESS", b"\xff")
    (folder / "other").mkdir()
    (folder / "source=a" / "day=never").mkdir()
    yield folder
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_only_asked_files_are_opened(spark, landing):
    read = lambda: landed(spark, f"file://{landing}")
    got = read().where("source = 'a' AND day >= DATE '2026-09-02' AND day < DATE '2026-09-04' AND body <> 'a 1'").collect()
    assert [tuple(r) for r in got] == [("a", dt.date(2026, 9, 3), "f2", "a 2")]
    assert read().where("source IN ('a', 'none')").count() == 4 and read().where("source = 'none'").count() == 0
    with pytest.raises(Exception, match="utf-8"):
        read().collect()


def test_an_interrupted_stream_resumes(spark, landing, tmp_path):
    folder = tmp_path / "stream"
    for k in range(3):
        put(folder, "a", "2026-09-01", f"f{k}", b"x", k)
    stream = lambda: spark.readStream.format("landing").option("folder", f"file://{folder}").load()
    seen, fail = [], [True]

    def handle(batch, epoch):
        seen.append((epoch, sorted(r.name for r in batch.collect())))
        if fail and fail.pop():
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        pipelines.run_once(stream(), handle, f"file://{tmp_path}/checkpoint")
    pipelines.run_once(stream(), handle, f"file://{tmp_path}/checkpoint")
    assert {tuple(names) for _, names in seen if names} == {("f0", "f1", "f2")} and len([n for _, n in seen if n]) == 2
    put(folder, "a", "2026-08-01", "late", b"y", 50)  # an older day that lands later
    put(folder, "a", "2026-08-01", "young", b"y", 200)  # may still be followed by others of its time
    pipelines.run_once(stream(), handle, f"file://{tmp_path}/checkpoint")
    assert [n for _, n in seen if n][-1] == ["late"]
