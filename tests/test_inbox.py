"""Messages handled once: expired, repeated, late, over failures and restarts."""

import os
import time

import pytest

from quarrylark.streaming.inbox import Inbox

NOW = time.time()


def put(folder, name, text, hours_ago=0.0):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)
    os.utime(folder / name, (NOW - hours_ago * 3600,) * 2)


def left(folder):
    return sorted(p.name for p in folder.rglob("*") if p.is_file() and not p.name.startswith("."))


@pytest.fixture()
def box(spark, tmp_path):
    clock = [NOW]
    make = lambda: Inbox(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/memory", per_batch=2, clock=lambda: clock[0])
    return tmp_path / "in", make, clock


def test_messages_are_handled_once_and_deleted(box):
    folder, make, clock = box
    got = {}
    put(folder, "m1", "/mute a", 1)
    put(folder, "m2", "line\nline", 2)
    put(folder, "old", "/mute b", 7)
    put(folder / "again", "m1", "/mute a", 0.5)
    make().consume(lambda rows, epoch: got.update({(epoch, r.id): r.text for r in rows.collect()}))
    assert sorted(k for _, k in got) == ["m1", "m2"] and set(got.values()) == {"/mute a", "line\nline"}
    assert left(folder) == []
    # a later run: the same id within the hours, a late message, a new one
    put(folder / "third", "m1", "/mute a")
    put(folder / "late", "m9", "/mute z", 6.5)
    put(folder, "m3", "/unmute a")
    more = {}
    inbox = make()
    inbox.consume(lambda rows, epoch: more.update({r.id: r.text for r in rows.collect()}))
    assert more == {"m3": "/unmute a"} and left(folder) == []
    assert {(r.id, r.action) for r in inbox.decided().collect()} >= {("m3", "fresh"), ("m9", "expired"), ("m1", "repeated"), ("m1", "fresh")}
    clock[0] = NOW + 9 * 3600
    inbox.consume(lambda rows, epoch: None)
    assert inbox.decided().count() == 0  # forgotten with their expiry


def test_a_failed_batch_is_run_again_as_it_was_decided(box):
    folder, make, clock = box
    for k in range(5):
        put(folder, f"m{k}", f"text {k}", 5.5)
    seen = []

    def handle(rows, epoch):
        names = sorted(r.id for r in rows.collect())
        seen.append((epoch, names))
        if len(seen) == 2:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        make().consume(handle)
    assert len(left(folder)) == 3  # the first batch was committed before the second began
    clock[0] = NOW + 3600  # what was decided before the failure does not expire now
    make().consume(handle)
    assert seen[1] == seen[2] and len(seen[1][1]) == 2
    assert seen[3][1] == []  # the last message was decided after its hours
    assert left(folder) == []


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    inbox = Inbox(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/memory")
    inbox.consume(lambda rows, epoch: None)
    assert inbox.decided().collect() == []
