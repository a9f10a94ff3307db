"""Queries over lockfiles, runs, snapshots and descriptors, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor.operators import corpus, descriptors, lockfile
from spoor.plans import bridge

Q, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


LOCK = f"""
WITH l AS ({bridge.duckdb(bridge.LOCK)}
), e AS (SELECT side, repo, name, version, arg_min(struct_pack(i := integrity, s := source_kind, d := dev), key) AS p FROM l WHERE source_kind IN ('remote', 'git', 'unknown') GROUP BY ALL
), b AS (SELECT coalesce(x.repo, y.repo) AS repo, coalesce(x.name, y.name) AS name, coalesce(x.version, y.version) AS version, x.p AS o, y.p AS n
  FROM (SELECT * FROM e WHERE side = 'before') x FULL JOIN (SELECT * FROM e WHERE side = 'after') y ON x.repo = y.repo AND x.name = y.name AND x.version = y.version
), same AS (
  SELECT repo, name, version, 'integrity_changed' AS change_type, name || '@' || version || ' same version, different tarball hash' AS summary FROM b WHERE o IS NOT NULL AND n IS NOT NULL AND o.i <> n.i
  UNION ALL SELECT repo, name, version, 'source_changed', name || '@' || version || ' now comes from ' || n.s || ' instead of ' || o.s FROM b WHERE o IS NOT NULL AND n IS NOT NULL AND o.s <> n.s
  UNION ALL SELECT repo, name, version, 'groups_changed', name || '@' || version || ' moved from ' || CASE WHEN o.d THEN 'dev' ELSE 'prod' END || ' to ' || CASE WHEN n.d THEN 'dev' ELSE 'prod' END FROM b WHERE o IS NOT NULL AND n IS NOT NULL AND o.d <> n.d
), alone AS (SELECT repo, name, version, CASE WHEN n IS NULL THEN 'before' ELSE 'after' END AS side FROM b WHERE o IS NULL OR n IS NULL
), rk AS (SELECT *, row_number() OVER (PARTITION BY repo, name, side ORDER BY version) AS r FROM alone
), pv AS (SELECT repo, name, r, max(version) FILTER (side = 'before') AS old, max(version) FILTER (side = 'after') AS new FROM rk GROUP BY ALL
), paired AS (
  SELECT repo, name, coalesce(new, old) AS version, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'version_changed' END AS change_type,
    CASE WHEN old IS NULL THEN 'added ' || name || '@' || new WHEN new IS NULL THEN 'removed ' || name || '@' || old ELSE name || ' ' || old || ' to ' || new END AS summary FROM pv
), ch AS (SELECT *, change_type IN ('added', 'version_changed', 'integrity_changed', 'source_changed') AS introduces_code FROM (SELECT * FROM same UNION ALL SELECT * FROM paired))
"""


@query("lock_packages", bridge.duckdb(bridge.LOCK))
def packages(spark, d):
    return bridge.lock_packages(spark, d)


@query("lock_same_identity", LOCK + "SELECT * FROM same")
def _(spark, d):
    return lockfile.same_identity(lockfile.both_sides(packages(spark, d)))


@query("lock_one_sided", LOCK + "SELECT * FROM alone")
def _(spark, d):
    return lockfile.one_sided(lockfile.both_sides(packages(spark, d)))


@query("lock_pair_versions", LOCK + "SELECT * FROM paired")
def _(spark, d):
    return lockfile.pair_versions(lockfile.one_sided(lockfile.both_sides(packages(spark, d))))


@query("lock_changes", LOCK + "SELECT * FROM ch")
def _(spark, d):
    return lockfile.changes(packages(spark, d))


@query("order_changes", LOCK + "SELECT repo, CAST(row_number() OVER (PARTITION BY repo ORDER BY introduces_code DESC, name, summary, version) AS INTEGER) AS place, summary FROM ch")
def _(spark, d):
    return lockfile.order_changes(lockfile.changes(packages(spark, d))).select("repo", "place", "summary")


@query("lock_decision", LOCK + "SELECT repo, bool_or(introduces_code) AS should_record, count(*) AS changes, count(DISTINCT name || '@' || version) FILTER (introduces_code) AS recordable FROM ch GROUP BY repo")
def _(spark, d):
    return lockfile.decision(lockfile.changes(packages(spark, d)))


@query("distinct_changes", LOCK + "SELECT DISTINCT name, version FROM ch WHERE introduces_code")
def _(spark, d):
    return lockfile.changes(packages(spark, d)).where("introduces_code").select("name", "version").distinct()


RUNS = f"""
WITH r AS ({bridge.duckdb(bridge.RUNS)}
), best AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY package, version ORDER BY complete DESC, started_at DESC, path) AS n FROM r) WHERE n = 1
), t AS (SELECT (SELECT count(*) FROM r) AS results, count(*) AS kept, count(*) FILTER (complete) AS complete, count(*) FILTER (recorded AND NOT complete) AS partial, count(*) FILTER (NOT recorded) AS failed,
  count(*) FILTER (pushed) AS pushed, count(*) FILTER (NOT matches_requested) AS version_mismatch, count(DISTINCT package) AS packages FROM best
), pub AS ({bridge.duckdb(bridge.PUBLISHED)}
), rv AS (SELECT package, version, published_at, row_number() OVER (PARTITION BY package ORDER BY published_at DESC, version DESC) AS n FROM pub WHERE NOT contains(version, '-') AND NOT unpublished AND published_at IS NOT NULL)
"""
runs, published = bridge.run_results, bridge.published


@query("run_results", bridge.duckdb(bridge.RUNS))
def _(spark, d):
    return runs(spark, d)


@query("best_result", RUNS + "SELECT * FROM best")
def _(spark, d):
    return corpus.best_result(runs(spark, d))


@query("merge_totals", RUNS + "SELECT *, results - kept AS duplicates_collapsed FROM t")
def _(spark, d):
    return corpus.merge_totals(runs(spark, d))


@query("dataset_claims", RUNS + "SELECT round(complete / kept, 4) AS completion_rate, complete - pushed AS complete_not_pushed, round(complete / kept, 4) >= 0.9 AS may_claim_completion, CASE WHEN round(complete / kept, 4) < 0.9 THEN 'completion rate is under 90 %' ELSE '' END AS withheld FROM t")
def _(spark, d):
    return corpus.dataset_claims(runs(spark, d))


@query("results_vs_registry", RUNS + "SELECT package, version, started_at FROM best WHERE complete AND NOT pushed")
def _(spark, d):
    return corpus.results_vs_registry(runs(spark, d))


@query("pending_plan", RUNS + "SELECT package, version, published_at, CAST(n AS INTEGER) AS n FROM rv WHERE n <= 5 AND NOT EXISTS (SELECT 1 FROM r WHERE complete AND r.package = rv.package AND '1.' || r.version = rv.version)")
def _(spark, d):
    done = runs(spark, d).withColumn("version", F.concat(F.lit("1."), "version"))
    return corpus.pending_plan(corpus.recent_versions(published(spark, d)), done)


@query("published_versions", RUNS + "SELECT package, version, published_at FROM pub WHERE NOT contains(version, '-') AND NOT unpublished AND published_at IS NOT NULL")
def _(spark, d):
    return corpus.published_versions(published(spark, d)).drop("unpublished")


@query("version_exclusions", RUNS + "SELECT package, count(*) FILTER (contains(version, '-')) AS prerelease, count(*) FILTER (NOT contains(version, '-') AND unpublished) AS unpublished, 0::BIGINT AS no_timestamp, count(*) FILTER (NOT contains(version, '-') AND NOT unpublished) AS usable FROM pub GROUP BY package")
def _(spark, d):
    return corpus.exclusions(published(spark, d))


@query("recent_versions", RUNS + "SELECT package, version, published_at, CAST(n AS INTEGER) AS n FROM rv WHERE n <= 5")
def _(spark, d):
    return corpus.recent_versions(published(spark, d))


@query("plan_totals", RUNS + "SELECT count(DISTINCT rv.package) AS resolved, (SELECT count(DISTINCT package) FROM pub) - count(DISTINCT rv.package) AS unresolved, count(*) AS recordings_planned FROM rv WHERE n <= 5")
def _(spark, d):
    return corpus.plan_totals(published(spark, d))


@query("shard_spec", RUNS + "SELECT package, package || ':' || string_agg(version, ',' ORDER BY version) AS spec FROM rv WHERE n <= 5 GROUP BY package")
def _(spark, d):
    return corpus.shard_spec(corpus.recent_versions(published(spark, d)))


@query("shard_plan")
def _(spark, d):
    return corpus.shard_plan(corpus.recent_versions(published(spark, d)), 8)


INDEX = f"WITH x AS ({bridge.duckdb(bridge.INDEX)})"
index = bridge.snapshot_index


@query("latest_snapshot", INDEX + " SELECT package, version, append_pos, digest, recorded_at, events FROM (SELECT *, row_number() OVER (PARTITION BY package, version ORDER BY append_pos DESC) AS n FROM x) WHERE n = 1")
def _(spark, d):
    return corpus.latest_snapshot(index(spark, d))


@query("snapshot_lookup", INDEX + " SELECT package, version, first_seen, CAST(row_number() OVER (PARTITION BY package ORDER BY first_seen) AS INTEGER) AS n FROM (SELECT package, version, min(append_pos) AS first_seen FROM x GROUP BY ALL)")
def _(spark, d):
    return corpus.version_order(index(spark, d))


@query("snapshot_push", INDEX + " SELECT digest, count(*) AS pushes, min(append_pos) AS first_push FROM x GROUP BY digest")
def _(spark, d):
    return corpus.stored_once(index(spark, d))


FD = f"""
WITH a AS (SELECT * FROM ({bridge.duckdb(bridge.FD)}) WHERE act <> 'other'
), s AS (SELECT *, lag(act) OVER w AS last_act, last_value(path IGNORE NULLS) OVER (PARTITION BY recording_id, pid, fd ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_path FROM a WINDOW w AS (PARTITION BY recording_id, pid, fd ORDER BY seq)
), e AS (SELECT *, CAST(sum(CASE WHEN last_act IS NULL OR last_act = 'close' OR act = 'open' AND path IS DISTINCT FROM last_path THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, pid, fd ORDER BY seq) AS BIGINT) AS epoch FROM s
), w AS (SELECT *, last_value(path IGNORE NULLS) OVER (PARTITION BY recording_id, pid, fd, epoch ORDER BY seq) AS target FROM e)
"""
fd = bridge.fd_activity


@query("fd_epochs", FD + "SELECT recording_id, pid, fd, seq, act, epoch FROM e")
def _(spark, d):
    return descriptors.fd_epochs(fd(spark, d)).select("recording_id", "pid", "fd", "seq", "act", "epoch")


@query("fd_as_of", FD + "SELECT recording_id, pid, fd, seq, target, bytes FROM w WHERE act = 'write'")
def _(spark, d):
    return descriptors.fd_as_of(fd(spark, d)).select("recording_id", "pid", "fd", "seq", "target", "bytes")


@query("write_volume", FD + "SELECT recording_id, pid, fd, epoch, target AS path, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS writes, max(us) AS last_us FROM w WHERE act = 'write' GROUP BY recording_id, pid, fd, epoch, target")
def _(spark, d):
    return descriptors.write_volume(fd(spark, d))


HOUR = 3_600_000_000
ARRIVALS = "WITH a AS (SELECT user_id AS recording_id, event_id AS arrival, epoch_us(ts) AS us FROM events)"


def arrivals(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("user_id").alias("recording_id"), F.col("event_id").alias("arrival"), F.expr("unix_micros(CAST(ts AS TIMESTAMP))").alias("us"))


@query(
    "late_events",
    ARRIVALS
    + f""", n AS (SELECT *, max(us) OVER (PARTITION BY recording_id ORDER BY arrival) AS newest FROM a
), r AS (SELECT x.recording_id, x.arrival, x.us, min(greatest(n.arrival, x.arrival)) AS released_at FROM a x JOIN n ON n.recording_id = x.recording_id AND n.newest >= x.us + {HOUR} GROUP BY ALL
), l AS (SELECT a.recording_id, a.arrival, max(r.us) AS last_released FROM a JOIN r ON r.recording_id = a.recording_id AND r.released_at < a.arrival GROUP BY ALL)
SELECT a.recording_id, a.arrival, a.us, coalesce(a.us < last_released, false) AS late FROM a LEFT JOIN l ON l.recording_id = a.recording_id AND l.arrival = a.arrival""",
)
def _(spark, d):
    return descriptors.late_events(arrivals(spark, d), HOUR)


@query("liveness", ARRIVALS + f", g AS (SELECT recording_id, us - lag(us) OVER (PARTITION BY recording_id ORDER BY us, arrival) AS gap FROM a) SELECT recording_id, coalesce(max(gap), 0) AS longest_gap_us, count(*) AS events, coalesce(max(gap), 0) > {24 * HOUR} AS dead FROM g GROUP BY recording_id")
def _(spark, d):
    return descriptors.liveness(arrivals(spark, d), 24 * HOUR)


@query("event_cap", ARRIVALS + " SELECT recording_id, count(*) FILTER (n <= 50) AS kept, max(n) > 50 AS capped FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY us, arrival) AS n FROM a) GROUP BY recording_id")
def _(spark, d):
    return descriptors.event_cap(arrivals(spark, d), 50)


#: Fixed value: the reference's cap.
CAP = 500_000


@query("event_cap_reference", ARRIVALS + f" SELECT recording_id, least(count(*), {CAP}) AS kept, count(*) > {CAP} AS capped FROM a GROUP BY recording_id")
def _(spark, d):
    return descriptors.event_cap(arrivals(spark, d), CAP)
