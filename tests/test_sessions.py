"""Pulses of sessions, and reports that repeat safely."""

import json

from test_recordings import CRITICAL, END, START, analysed, drop, line, target

from spoor.operators import rules
from spoor.streaming import sessions
from spoor.streaming.sessions import Pulse


def test_pulse():
    pulse, out = Pulse(), []
    for us, end in ((0, False), (10, False), (20, False), (2000, False), (2001, False), (9000, False), (9001, True)):
        out += pulse.step(us, end, every=3, every_us=1500, limit_us=5000)
    assert out == [("heartbeat", 1, 3, 20), ("heartbeat", 2, 4, 2000), ("dead", 2, 5, 2001), ("heartbeat", 3, 6, 9000), ("ended", 3, 6, 9001)]
    assert Pulse(events=1, last_us=7_000).due_ms(3_000) == 11


def test_reports_equal_evaluate_and_repeat_safely(spark, tmp_path):
    drop(tmp_path / "r", "1", CRITICAL)
    drop(tmp_path / "r", "2", [START, *[line("fs_write", target=target("/etc/z"), kind="write") for _ in range(8)], END])
    drop(tmp_path / "r", "3", [START, line("fs_write", target=target("/w/p/z"), kind="write")])
    events = analysed(spark, tmp_path / "r").withColumn("recording_id", rules.F.col("recording_id").cast("long"))
    found = rules.findings(events)
    want = {r.recording_id: (r.value, r.raw, r.verdict, r.is_partial, r.observations) for r in rules.evaluate(events, found=found).collect()}
    folder = f"{tmp_path}/s"
    for k in range(0, 32, 8):
        events.drop("has_end").where(f"seq >= {k} and seq < {k + 8}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.drop("has_end").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    keep, batches = sessions.upserts(f"{folder}/out"), []

    def twice(batch, number):
        """Every batch is delivered again, as after a failure."""
        batch = batch.persist()
        keep(batch, number)
        keep(batch, number)
        batches.append(number)
        batch.unpersist()

    sessions.live_reports(stream).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(twice).start().awaitTermination()
    state = sessions.latest(spark, f"{folder}/out")
    assert len(batches) > 1
    assert {r.recording_id: (r.value, r.raw, r.verdict, r.is_partial, r.observations) for r in sessions.reports(state).collect()} == want
    pieces = lambda rows: {(r.recording_id, r.rule_id, r.subject): (r.occurrences, r.title, json.dumps([list(e) for e in r.evidence])) for r in rows}
    assert pieces(state.where("rule_id is not null").collect()) == pieces(found.collect())
