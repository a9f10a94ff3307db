"""Pushing recordings into a store, and scores while they arrive."""

import hashlib
import json

from test_recordings import CRITICAL, END, START, analysed, drop, line, target

from spoor.operators import corpus, rules
from spoor.plans import registry
from spoor.streaming import live


def text(*lines):
    return "\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines)


def test_what_is_refused_and_what_is_new(spark):
    write = line("fs_write", target=target("/w/p/a"), kind="write")
    stop = lambda *why: line("session_end", complete=False, incomplete_reasons=list(why))
    a, b = text(START, write, END), text(START, END)
    pushed = {1: a, 2: a, 3: b, 4: text(START, write), 5: text(START, stop("interrupted", {"event_cap_reached": {"cap": 7}})), 6: text(START, "{", END), 7: text(START, stop()), 8: ""}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = spark.createDataFrame([(k, "p", str(k), v) for k, v in pushed.items()], "recording_id long, package string, version string, content string")
    known = spark.createDataFrame([(digest(b),)], "digest string")
    got = {r.recording_id: (r.accepted, r.stored, r.digest, r.events, r.bytes, r.reasons) for r in corpus.snapshot_push(rows, known).collect()}
    none = "the recording has no session_end event"
    assert got == {
        1: (True, True, digest(a), 1, len(a), None),
        2: (True, False, digest(a), 1, len(a), None),
        3: (True, False, digest(b), 0, len(b), None),
        4: (False, False, None, 1, len(pushed[4]), none),
        5: (False, False, None, 0, len(pushed[5]), "recording interrupted; event cap of 7 reached; stream is truncated"),
        6: (False, False, None, 0, len(pushed[6]), "line 2: malformed line"),
        7: (False, False, None, 0, len(pushed[7]), none),
        8: (False, False, None, 0, 0, none),
    }


def test_push_of_all_recordings(spark, sf_dir):
    pushed = {r.recording_id: r for r in registry.QUERIES["snapshot_push_recordings"](spark, sf_dir).collect()}
    analysis = {r.recording_id: r for r in registry.QUERIES["evaluate"](spark, sf_dir).collect()}
    assert set(pushed) == set(analysis)
    for k, r in pushed.items():
        assert r.accepted == (not analysis[k].is_partial) and r.events == analysis[k].observations
        assert r.stored == (r.accepted and r.version != "1.2.0") and (r.digest is None) == (r.reasons is not None)


def test_score_and_partial_state_as_events_arrive(spark, tmp_path):
    drop(tmp_path / "r", "a", CRITICAL)
    drop(tmp_path / "r", "b", [START, line("fs_write", target=target("/etc/z"), kind="write"), END])
    drop(tmp_path / "r", "c", [START, line("fs_write", target=target("/w/p/z"), kind="write"), line("session_end", complete=False)])
    events = analysed(spark, tmp_path / "r").drop("has_end")

    def state(until):
        folder = f"{tmp_path}/{until}"
        for k in range(1, until):
            events.where(f"seq = {k}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
        return {r.recording_id: (r.value, r.raw, r.is_partial) for r in live.live_scores(live.run_once(live.live_state(stream), "complete", folder)).collect()}

    assert state(3) == {"a": (40, 40, True), "b": (40, 40, True), "c": (0, 0, True)}
    assert state(20) == {"a": (100, 220, False), "b": (40, 40, False), "c": (0, 0, True)}
