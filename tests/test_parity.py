"""Every recording takes part in the comparison of two recorders."""

from spoor.plans import bridge, registry


def test_every_recording_has_facts(spark, sf_dir):
    events = bridge.events(spark, sf_dir)
    usable = events.where("not (coalesce(not ok, false) and op in ('fs_write', 'fs_read', 'net_connect'))")
    want = {(r.recording_id // 2, r.recording_id % 2 + 1) for r in usable.select("recording_id").distinct().collect()}
    facts = registry.QUERIES["recorder_facts"](spark, sf_dir)
    assert {(r.pair_id, r.side) for r in facts.select("pair_id", "side").distinct().collect()} == want
    assert len({pair for pair, _ in want}) < len(want)


def test_versions_are_no_filter():
    for name in ("facts", "set_difference", "set_intersection", "relative_counterpart", "mkdir_ancestor", "parity_compare", "parity_counts"):
        assert "version IN" not in registry.ORACLE_SQL[f"recorder_{name}"]


def test_no_table_that_grows_is_broadcast(spark, sf_dir):
    from spoor.operators import parity
    from spoor.plans import parity as plans

    for rows in (plans.recorder_sides(spark, sf_dir), parity.compare(plans.recorder_sides(spark, sf_dir))):
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
