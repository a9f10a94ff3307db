"""The SARIF text of every recording against a plain version."""

import json
from collections import defaultdict

from test_recordings import CRITICAL, END, START, analysed, drop, line, target

from spoor.operators import rules

LEVEL = {"critical": ("error", 100), "high": ("error", 70), "medium": ("warning", 40), "low": ("note", 10)}


def brute(analysis, found, skipped, reasons):
    by, left_out = defaultdict(list), defaultdict(list)
    for f in sorted(found, key=lambda f: (f.sev_rank, -f.occurrences, f.rule_id, f.subject)):
        by[f.recording_id].append(f)
    for s in skipped:
        left_out[s.recording_id].append((s.rule_id, s.reason))
    for a in analysis:
        fs, notes = by[a.recording_id], []
        first = {f.rule_id: f for f in reversed(fs)}
        if a.is_partial:
            notes.append(("warning", "The recording is incomplete, so these results are not the whole picture: " + reasons[a.recording_id], "partial_recording"))
        if a.backend == "aya":
            notes.append(("warning", "Not checked by the aya backend: credential reads, DNS queries. Absence of these findings is not evidence they did not happen.", "backend_coverage"))
        notes += [("note", f"Rule `{r}` did not run on this backend: {why}", "rule_not_run") for r, why in sorted(left_out[a.recording_id])]
        if a.unresolved:
            notes.append(("note", f"{a.unresolved} path(s) could not be resolved to an absolute location and were not checked against the expected directories", "unresolved_paths"))
        yield a.recording_id, {
            "results": [{"ruleId": f.rule_id, "level": LEVEL[f.severity][0], "rank": LEVEL[f.severity][1], "message": f.title, "occurrences": f.occurrences} for f in fs],
            "rules": [{"id": r, "shortDescription": f.title, "help": "See the rule catalog.", "severity": f.severity} for r, f in sorted(first.items())],
            "notifications": [{"level": x, "message": m, "id": i} for x, m, i in notes],
        }


def test_against_a_plain_version(spark, tmp_path):
    drop(tmp_path, "critical", CRITICAL)
    drop(tmp_path, "clean", [START, line("fs_write", target=target("/w/p/a"), kind="write"), END])
    drop(tmp_path, "noend", [START, line("fs_write", target=target("/w/p/a"), kind="write")])
    drop(tmp_path, "timeout", [START, line("fs_write", target=target("/w/p/a"), kind="write"), line("session_end", complete=False, incomplete_reasons=[{"timeout": {"limit_secs": 120}}, "interrupted"])])
    drop(tmp_path, "silent", [START, line("fs_write", target=target("/etc/z"), kind="write"), line("session_end", complete=False)])
    drop(tmp_path, "blind", [START | {"backend": "aya"}, line("fs_write", backend="aya", target=target("rel", "unresolved"), kind="open"), END | {"backend": "aya"}])
    events = analysed(spark, tmp_path)
    found, analysis, skipped = rules.findings(events), rules.evaluate(events), rules.skipped_rules(events)
    reasons = {"noend": "the recording has no session_end event; it may have been truncated", "timeout": "exceeded 120s time limit; recording interrupted", "silent": "no reason recorded"}
    got = {r.recording_id: json.loads(r.sarif_json) for r in rules.sarif_rows(events, found, analysis, skipped).collect()}
    assert got == dict(brute(analysis.collect(), found.collect(), skipped.collect(), reasons))
    assert set(got) == {"critical", "clean", "noend", "timeout", "silent", "blind"}
