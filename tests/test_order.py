"""Order of versions, descriptors of processes, late events, empty recordings and pairs, directories made."""

from pyspark.sql import functions as F

from spoor.operators import behavior, descriptors, parity, rules


def test_versions_in_order_of_first_appearance(spark):
    rows = [("p", v, k, k) for k, v in enumerate(["1.2.0", "1.9.0", "1.10.0", "1.9.0", "0.9.0"])]
    pairs = behavior.version_pairs(spark.createDataFrame(rows, "package string, version string, recording_id long, append_pos long"))
    assert sorted((r.before_version, r.after_version, r.before_id, r.after_id) for r in pairs.collect()) == [("1.10.0", "0.9.0", 2, 4), ("1.2.0", "1.9.0", 0, 3), ("1.9.0", "1.10.0", 3, 2)]


def test_descriptors_belong_to_processes(spark):
    rows = [(1, 10, 3, 1, "open", "a", 0, 1), (1, 11, 3, 2, "open", "b", 0, 2), (1, 10, 3, 3, "write", None, 5, 3), (1, 11, 3, 4, "write", None, 7, 4), (1, 10, 3, 5, "close", None, 0, 5), (1, 11, 3, 6, "write", None, 1, 6)]
    activity = spark.createDataFrame(rows, "recording_id long, pid long, fd long, seq long, act string, path string, bytes long, us long")
    assert sorted((r.pid, r.path, r.bytes) for r in descriptors.write_volume(activity).collect()) == [(10, "a", 5), (11, "b", 8)]


def late(spark, times, window):
    rows = spark.createDataFrame([(1, a, u) for a, u in enumerate(times)], "recording_id long, arrival long, us long")
    return [r.late for r in descriptors.late_events(rows, window).orderBy("arrival").collect()]


def test_late_is_behind_what_was_released(spark):
    assert late(spark, [0, 1000, 900], 50) == [False, False, False]
    assert late(spark, [10, 30, 20, 100, 15, 110, 90, 5, 200], 50) == [False, False, False, False, True, False, False, True, False]
    assert late(spark, [100, 100, 151, 99, 100], 50) == [False, False, False, True, False]


def test_verdict_needs_an_observation(spark):
    rows = [(1, "strace", 0, 0, True, True, True), (2, "strace", 0, 3, True, True, True), (3, "aya", 0, 3, True, True, True), (4, "strace", 1, 3, True, True, True), (5, "strace", 0, 0, False, True, True)]
    df = spark.createDataFrame(rows, "id int, backend string, unresolved int, observations int, complete boolean, has_end boolean, is_clean boolean")
    assert {r.id: r.v for r in df.select("id", rules.verdict().alias("v")).collect()} == {1: "clean_with_caveat", 2: "clean", 3: "clean_with_caveat", 4: "clean_with_caveat", 5: "partial"}


def test_pairs_without_behaviours_are_identical(spark, sf_dir):
    from spoor.plans import bridge

    events = bridge.events(spark, sf_dir).withColumns({"ok": F.lit(False), "op": F.lit("fs_write"), "complete": F.lit(True), "has_end": F.lit(True), "backend": F.lit("strace")})
    got = behavior.comparison_summary(events).collect()
    assert got and all(r.identical and r.added == r.removed == r.unchanged == 0 and r.headline == "behaved identically" and r.changed_classes == "" for r in got)
    assert any("agent_version:0.4.0>0.4.1" in r.caveats for r in got)


def test_directories_that_others_extend(spark):
    made = ["/a/b", "/a/bc", "x/y", "y", "z", "/q"]
    others = ["/a/bcd/e", "/r/x/y/f", "x/y2", "y/first", "/s/z"]
    rows = [("p", 2, "write", d, "mkdir") for d in made] + [("p", 1, "write", o, "write") for o in others]
    sides = spark.createDataFrame(rows, "pair_id string, side int, class string, path string, kind string")

    def brute(d):
        rest = [w for w in [*made, *others] if w != d]
        return any(w.startswith(d) for w in rest) if d.startswith("/") else any(f"/{d}/" in w or w.endswith(f"/{d}") for w in rest)

    assert sorted(r.path for r in parity.mkdir_ancestor(sides).collect()) == sorted(filter(brute, made))
