"""The snapshot store, pushed to and read again; caps found by counting."""

import json
import random

import pytest
from test_recordings import END, START, line, target

from spoor.operators import descriptors
from spoor.sources.store import SnapshotStore


def contents(spark, rows):
    return spark.createDataFrame(rows, "recording_id string, package string, version string, content string")


def text(*lines):
    return "\n".join(json.dumps(x) for x in lines)


def test_pushes(spark, tmp_path, monkeypatch):
    write = lambda p: line("fs_write", target=target(p), kind="write")
    a, b, c = (text(START, write(p), END) for p in ("/w/p/a", "/w/p/b", "/w/p/c"))
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    assert store.index().count() == 0 and store.verify().count() == 0
    first = store.push(contents(spark, [("1", "p", "1", a), ("2", "p", "2", a), ("3", "p", "3", text(START))]), "2026-01-01")
    assert {r.recording_id: (r.accepted, r.stored) for r in first.collect()} == {"1": (True, True), "2": (True, False), "3": (False, False)}

    # A push that dies before its commit leaves nothing that is read, and nothing at all once it is cleared.
    monkeypatch.setattr(SnapshotStore, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    monkeypatch.setattr(SnapshotStore, "_abort", lambda *_: None)
    with pytest.raises(OSError, match="lost"):
        store.push(contents(spark, [("4", "p", "4", b)]), "2026-01-02")
    monkeypatch.undo()
    assert store.index().count() == 2 and store.clear_aborted() == 2 and store.clear_aborted() == 0

    # Another push comes first: this one starts again and knows what that brought.
    other, won = SnapshotStore(spark, store.root), []

    def beaten(number, text):
        if not won:
            won.append(1)
            other.push(contents(spark, [("5", "q", "1", b)]), "2026-01-03")
        return SnapshotStore._commit(store, number, text)

    monkeypatch.setattr(store, "_commit", beaten)
    last = store.push(contents(spark, [("6", "q", "2", b), ("7", "q", "3", c)]), "2026-01-04")
    assert {r.recording_id: r.stored for r in last.collect()} == {"6": False, "7": True}
    rows = store.index().orderBy("append_pos").collect()
    assert [(r.append_pos, r.recording_id, r.recorded_at[-1]) for r in rows] == [(1, "1", "1"), (2, "2", "1"), (3, "5", "3"), (4, "6", "4"), (5, "7", "4")]
    assert sorted(r.content for r in store.blobs().collect()) == sorted([a, b, c])
    assert all(r.error is None and r.observations == 1 for r in store.verify().collect()) and store.verify().count() == 5


def test_cap_by_counting(spark, monkeypatch):
    monkeypatch.setattr(descriptors, "BINS", 4)
    rng = random.Random(8)
    rows = [(r, k, rng.choice([None, 5, 5, 7, rng.randrange(-(10**6), 10**12)])) for r, n in ((1, 300), (2, 40), (3, 41), (4, 1), (5, 120)) for k in range(n)]
    rows += [(6, k, 9) for k in range(90)] + [(7, k, None) for k in range(60)]
    events = spark.createDataFrame(rows, "recording_id long, arrival long, us long")
    cap = 40
    want = set()
    for r in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == r), key=lambda x: (x[2] is not None, x[2] or 0, x[1]))
        want |= {(*x, len(own) > cap) for x in own[:cap]}
    out = descriptors.capped_events(events, cap)
    assert {(r.recording_id, r.arrival, r.us, r.is_partial) for r in out.collect()} == want and out.count() == len(want)
    assert "Window" not in out._jdf.queryExecution().toString()
    assert {r.recording_id: (r.kept, r.capped) for r in descriptors.event_cap(events, cap).collect()} == {r: (min(cap, n), n > cap) for r, n in ((1, 300), (2, 40), (3, 41), (4, 1), (5, 120), (6, 90), (7, 60))}
