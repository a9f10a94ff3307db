"""Numbered lines of files that are read in byte ranges."""

import random

from spoor.sources import trace
from spoor.sources.lines import numbered_lines
from spoor.sources.recordings import read_lines


def test_numbers_over_many_ranges(spark, tmp_path):
    """Ranges far smaller than files, lines longer than ranges, blank lines, carriage returns, files without a last line feed."""
    rng = random.Random(4)
    want = {}
    for f in range(3):
        folder = tmp_path / f"recording_id=r{f}"
        folder.mkdir()
        lines = [rng.choice(["", "x", "y" * rng.randrange(200), "é\r", "z" * 5000 if k % 97 == 0 else "w"]) for k in range(800)]
        (folder / "trace.7").write_bytes("\n".join(lines).encode() + (b"\n" if f else b""))
        want |= {(f"r{f}", k + 1): line for k, line in enumerate(lines)}
        if not f and not lines[-1]:
            want.pop((f"r{f}", len(lines)))
    (tmp_path / "recording_id=r0" / "other").write_text("not a trace")
    conf = {"spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.openCostInBytes": "10"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert spark.read.text(str(tmp_path / "recording_id=r1")).rdd.getNumPartitions() > 15
        got = {(r.recording_id, r.line_no): r.line for r in trace.trace_lines(spark, str(tmp_path)).collect()}
        seqs = {(r.recording_id, r.seq): r.line for r in read_lines(spark, str(tmp_path / "recording_id=r1")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want
    assert {k: v for (_, k), v in seqs.items()} == {k: v.rstrip("\r") for (r, k), v in want.items() if r == "r1" and v.strip()}


def test_nothing(spark, tmp_path):
    (tmp_path / "empty").write_text("")
    assert numbered_lines(spark, str(tmp_path)).count() == 0
    assert "wholetext" not in numbered_lines(spark, str(tmp_path))._jdf.queryExecution().toString()
