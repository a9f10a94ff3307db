"""Comparable behaviours of a recording, and what changed between two versions of a package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spoor.catalog import CLASSES, UNOBSERVED
from spoor.functions import network as net, paths, process as proc
from spoor.operators.rules import placed, placed_once
from spoor.scratch import materialize

#: The columns that together are a behaviour.
IDENTITY = ["variant", "zone", "path", "kind", "qname", "port", "loopback", "private", "program", "tool"]
#: Classes in display order, and their weight for a reviewer.
CLASS_ORDER = ["writes outside expected directories", "credential reads", "network", "processes", "filesystem"]
SURPRISE = {"writes outside expected directories": 500, "credential reads": 400, "network": 300, "processes": 200, "filesystem": 1}
VERBS = {"truncate": "truncated", "mkdir": "created directory", "rename": "renamed to", "delete": "deleted", "symlink": "symlinked", "hardlink": "hardlinked", "chmod": "changed permissions on", "chown": "changed owner of"}
BLIND = ", ".join(c for c in CLASSES if ("aya", c) in UNOBSERVED)


def verb(kind: Column) -> Column:
    out = F.lit("wrote")
    for k, v in VERBS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def behavior_summary() -> Column:
    v = F.col("variant")
    scope = F.when(F.col("loopback"), " (loopback)").when(F.col("private"), " (private network)").otherwise("")
    did = verb(F.col("kind"))
    return (
        F.when(v == "wrote", F.concat(did, F.lit(" "), "zone", F.lit("/"), "path"))
        .when(v == "wrote_outside", F.concat(did, F.lit(" "), "path", F.lit(" (outside expected directories)")))
        .when(v == "wrote_runtime", F.concat(did, F.lit(" "), "path"))
        .when(v == "wrote_unresolved", F.concat(did, F.lit(" "), "path", F.lit(" (path unresolved by the recorder)")))
        .when(v == "read_credential", F.concat(F.lit("read "), "path"))
        .when(v == "resolved", F.concat(F.lit("resolved "), "qname"))
        .when(v == "connected", F.concat(F.lit("connected to port "), F.col("port").cast("string"), scope))
        .when(v == "connected_unix", F.concat(F.lit("connected to unix socket "), "path"))
        .when(v == "spawned", F.concat(F.lit("ran "), "program"))
        .when(v == "spawned_shell_pipeline", F.concat(F.lit("piped "), "tool", F.lit(" output into a shell")))
    )


def behavior_class() -> Column:
    v = F.col("variant")
    return (
        F.when(v == "wrote_outside", CLASS_ORDER[0])
        .when(v == "read_credential", CLASS_ORDER[1])
        .when(v.isin("resolved", "connected", "connected_unix"), CLASS_ORDER[2])
        .when(v.isin("spawned", "spawned_shell_pipeline"), CLASS_ORDER[3])
        .otherwise(CLASS_ORDER[4])
    )


def class_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CLASS_ORDER)), c).cast("int")


def observations(events: DataFrame) -> DataFrame:
    """A row per behaviour seen: ``recording_id, package, version`` and IDENTITY. Failed writes are no
    behaviour; failed reads, connects, questions and spawns are. One spawn can be two."""
    c = F.col
    failed = F.coalesce(~c("ok"), F.lit(False))
    rows = placed(events).withColumn("relative", paths.zone_relative(c("path"), c("placement"), c("zone_project"), c("zone_cache"), c("zone_home"), c("zone_tmp")))
    inside, name = c("relative").isNotNull(), paths.basename(c("bin"))
    null = {k: F.lit(None).cast(t) for k, t in zip(IDENTITY, ["string"] * 5 + ["int", "boolean", "boolean", "string", "string"], strict=True)}
    one = lambda **v: F.struct(*[(v[k] if k in v else null[k]).alias(k) for k in IDENTITY])
    variant = F.when(inside, "wrote").when(c("placement") == "outside", "wrote_outside").when(c("placement") == "runtime", "wrote_runtime").otherwise("wrote_unresolved")
    wrote = one(variant=variant, zone=F.when(inside, c("placement")), path=F.coalesce("relative", "path"), kind=c("kind"))
    read = one(variant=F.lit("read_credential"), path=F.when(inside, F.concat("placement", F.lit("/"), "relative")).otherwise(c("path")))
    asked = one(variant=F.lit("resolved"), qname=F.lower("qname"))
    # The recorder says what is near; a recording that does not say so is judged by its address.
    near = {"loopback": F.coalesce("loopback", net.is_loopback(c("ip"))), "private": F.coalesce("private", net.is_private(c("ip")))}
    met = one(variant=F.lit("connected"), port=c("port"), **near)
    socket = one(variant=F.lit("connected_unix"), path=c("unix_path"))
    ran = one(variant=F.lit("spawned"), program=name)
    piped = one(variant=F.lit("spawned_shell_pipeline"), tool=proc.shell_pipeline_tool(c("argv")))
    found = (
        F.when((c("op") == "fs_write") & ~failed, F.array(wrote))
        .when(c("op") == "fs_read", F.array(read))
        .when(c("op") == "dns_query", F.array(asked))
        .when((c("op") == "net_connect") & c("unix_path").isNotNull(), F.array(socket))
        .when((c("op") == "net_connect") & (c("port") != 0), F.array(met))
        .when(c("op") == "proc_spawn", F.filter(F.array(ran, piped), lambda b: ((b["variant"] == "spawned") & (b["program"] != "")) | b["tool"].isNotNull()))
    )
    return rows.select("recording_id", "package", "version", F.explode(found).alias("b")).select("recording_id", "package", "version", "b.*")


def profile(events: DataFrame) -> DataFrame:
    """The different behaviours of every recording, written once for all that is derived from them."""
    return materialize(observations(events).dropDuplicates(["recording_id", *IDENTITY]), "profile")


def unresolved_paths(events: DataFrame) -> DataFrame:
    """Per recording the unresolvable paths of writes that did not fail and of all reads."""
    counted = (F.col("placement") == "unresolvable") & ((F.col("op") == "fs_read") | ((F.col("op") == "fs_write") & F.coalesce(F.col("ok"), F.lit(True))))
    return placed(events).groupBy("recording_id").agg(F.count(F.when(counted, 1)).alias("unresolved_paths"))


def sketches(events: DataFrame) -> DataFrame:
    """Per recording a sketch of its different behaviours, to be kept with it: 4096 registers, about 1.6 percent of error."""
    rows = profile(events).select("recording_id", "package", behavior_summary().alias("summary"))
    return rows.groupBy("recording_id", "package").agg(F.hll_sketch_agg("summary", 12).alias("sketch"))


def distinct_of(held: DataFrame, *by: str) -> DataFrame:
    """About how many different behaviours the recordings of ``sketches`` have together: a new recording adds its own sketch, and no other
    is read again but for its sketch."""
    return held.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_behaviors"))


def corpus_summary(events: DataFrame) -> DataFrame:
    """One row over all recordings; distinct behaviours are counted by their summary text, exactly."""
    events = placed_once(events)
    rows = profile(events).withColumn("summary", behavior_summary()).withColumn("class", behavior_class())
    count = lambda c: F.count(F.when(F.col("class") == c, 1))
    names = ["outside", "credential_reads", "network", "processes", "filesystem"]
    seen = rows.agg(F.count(F.lit(1)).alias("observations"), F.countDistinct("summary").alias("distinct_behaviors"), *[count(c).alias(n) for c, n in zip(CLASS_ORDER, names, strict=True)])
    recordings = events.groupBy("package", "version").agg(F.max("complete").alias("complete"))
    packages = recordings.groupBy("package").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("complete")).cast("long")).alias("incomplete"))
    totals = packages.agg(F.sum("n").alias("snapshots"), F.count(F.lit(1)).alias("packages"), F.count(F.when(F.col("n") > 1, 1)).alias("packages_with_history"), F.sum(F.col("n") - 1).alias("diffable_pairs"), F.sum("incomplete").alias("incomplete"))
    return totals.crossJoin(seen)  # one row by one row


def corpus_report(events: DataFrame, verified: DataFrame) -> DataFrame:
    """One row about a corpus and its store: ``verified`` has package, version and error of every entry of the index; only entries
    that could be read count as recordings. Says whether the corpus is intact and what may be claimed of it."""
    c = F.col
    readable = events.join(verified.where("error is null").select("package", "version"), ["package", "version"], "left_semi")
    entries = verified.agg(F.count(F.lit(1)).alias("entries"), F.count("error").alias("unreadable"))
    unresolved = unresolved_paths(readable).agg(F.coalesce(F.sum("unresolved_paths"), F.lit(0)).alias("unresolved_paths"))
    rows = corpus_summary(readable).fillna(0).crossJoin(entries).crossJoin(unresolved)  # one row each
    claim = F.format_string("%d recordings of %d packages, %d version pairs comparable, %d behavior observations of %d distinct behaviors", "snapshots", "packages", "diffable_pairs", "observations", "distinct_behaviors")
    claim = F.when(c("snapshots") == 0, "no readable recordings: make no claim about this corpus").otherwise(claim)
    return rows.select("entries", c("snapshots").alias("readable"), "unreadable", "packages", "packages_with_history", "diffable_pairs", "incomplete", "unresolved_paths", ((c("unreadable") == 0) & (c("incomplete") == 0)).alias("intact"), claim.alias("claim"))


def recordings_of(events: DataFrame) -> DataFrame:
    """``package, version, recording_id, append_pos``: a row per recording with its place in the index."""
    return events.groupBy("package", "version", "recording_id").agg(F.min("append_pos").alias("append_pos"))


def version_pairs(recordings: DataFrame) -> DataFrame:
    """``package, before_version, after_version, before_id, after_id`` of neighbouring versions: in the order in which the
    index saw them first, not in that of their text. recordings has a row per recording; a version's last one stands for it."""
    versions = recordings.groupBy("package", "version").agg(F.min("append_pos").alias("first_seen"), F.max_by("recording_id", "append_pos").alias("recording_id"))
    order = Window.partitionBy("package").orderBy("first_seen", "version")
    rows = versions.withColumn("after_version", F.lead("version").over(order)).withColumn("after_id", F.lead("recording_id").over(order))
    return rows.where(F.col("after_id").isNotNull()).select("package", F.col("version").alias("before_version"), "after_version", F.col("recording_id").alias("before_id"), "after_id")


def version_diff(events: DataFrame) -> DataFrame:
    """``package, before_version, after_version, change`` and the behaviour, for added, removed and unchanged ones.

    Every behaviour is tagged with the pairs it takes part in (two at most) and grouped once: one
    shuffle instead of two anti joins."""
    pairs = version_pairs(recordings_of(events))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("before_id").alias("recording_id"), F.lit(True).alias("old")), F.struct(F.col("after_id").alias("recording_id"), F.lit(False).alias("old")))).alias("s"), "before_version", "after_version").select("s.*", "before_version", "after_version")
    rows = profile(events).join(sides, "recording_id")
    key = ["package", "before_version", "after_version", *IDENTITY]
    both = rows.groupBy(*key).agg(F.max("old").alias("was"), F.max(~F.col("old")).alias("now"))
    change = F.when(F.col("was") & F.col("now"), "unchanged").when(F.col("now"), "added").otherwise("removed")
    return both.select(*key, change.alias("change"), behavior_class().alias("class"), behavior_summary().alias("summary"))


def class_counts(diff: DataFrame) -> DataFrame:
    """Per pair of versions and class of behaviour how many came, went and stayed."""
    count = lambda c: F.count(F.when(F.col("change") == c, 1)).alias(c)
    return diff.groupBy("package", "before_version", "after_version", "class").agg(count("added"), count("removed"), count("unchanged"))


def comparison_summary(events: DataFrame, diff: DataFrame | None = None) -> DataFrame:
    """Per pair of versions: counts, blockers, caveats, whether comparable and identical, and the headline. A pair in which
    neither side did anything is there too. ``diff``: that of ``version_diff``, where it is there already."""
    events = placed_once(events)
    diff = version_diff(events) if diff is None else diff
    pair = ["package", "before_version", "after_version"]
    diff = version_pairs(recordings_of(events)).select(*pair).join(diff, pair, "left")
    count = lambda c: F.count(F.when(F.col("change") == c, 1)).alias(c)
    counts = diff.groupBy("package", "before_version", "after_version").agg(count("added"), count("removed"), count("unchanged"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("change") != "unchanged", F.col("class")))), ", ").alias("changed_classes"))
    about = events.groupBy("package", "version").agg(F.min_by("backend", "seq").alias("backend"), F.max(F.col("complete") & F.col("has_end")).alias("whole"), F.max_by("agent_version", "append_pos").alias("agent_version"), F.max_by("recording_id", "append_pos").alias("recording_id"))
    about = about.join(unresolved_paths(events), "recording_id").drop("recording_id")
    side = lambda p: about.select("package", *[F.col(c).alias(f"{p}_{c}") for c in ("version", "backend", "whole", "agent_version", "unresolved_paths")])
    rows = counts.join(side("before"), ["package", "before_version"]).join(side("after"), ["package", "after_version"])
    same = F.col("before_backend") == F.col("after_backend")
    blockers = F.array_join(F.array_compact(F.array(F.when(~same, "backend_mismatch"), F.when(~F.col("before_whole"), "partial_before"), F.when(~F.col("after_whole"), "partial_after"))), ",")
    unresolved = lambda p: F.when(F.col(f"{p}_unresolved_paths") > 0, F.concat(F.lit(f"unresolved_{p}:"), F.col(f"{p}_unresolved_paths").cast("string")))
    agent = F.when(F.col("before_agent_version") != F.col("after_agent_version"), F.concat(F.lit("agent_version:"), "before_agent_version", F.lit(">"), "after_agent_version"))
    caveats = F.array_join(F.array_compact(F.array(agent, unresolved("before"), unresolved("after"), F.when(same & (F.col("before_backend") == "aya"), F.lit("blind_spots:" + BLIND)))), ";")
    rows = rows.withColumn("blockers", blockers).withColumn("caveats", caveats)
    comparable = F.col("blockers") == ""
    identical = (F.col("added") == 0) & (F.col("removed") == 0)
    headline = F.when(~comparable, "cannot be compared").when(identical, "behaved identically").otherwise("behavior changed")
    return rows.select(*pair, "added", "removed", "unchanged", "changed_classes", "blockers", "caveats", comparable.alias("comparable"), identical.alias("identical"), headline.alias("headline"))


def diff_highlights(diff: DataFrame, k: int = 5) -> DataFrame:
    """The first k additions of each pair, by class."""
    pair = ["package", "before_version", "after_version"]
    rows = diff.where("change = 'added'").select(*pair, "class", "summary", class_rank(F.col("class")).alias("r")).distinct()
    order = Window.partitionBy(*pair).orderBy("r", "summary")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select(*pair, "n", "class", "summary")


def capped_by_class(diff: DataFrame, cap: int = 8) -> DataFrame:
    """At most ``cap`` changes per pair, side and class, each with how many more there are."""
    group = ["package", "before_version", "after_version", "change", "class"]
    rows = diff.where("change <> 'unchanged'").select(*group, "summary").distinct()
    order = Window.partitionBy(*group).orderBy("summary")
    total = F.count(F.lit(1)).over(Window.partitionBy(*group))
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("total", total).where(F.col("n") <= cap)
    return rows.select(*group, "n", "summary", F.greatest(F.col("total") - cap, F.lit(0)).alias("more"))


def surprise_weight(diff: DataFrame) -> DataFrame:
    """Per pair with additions: 100 + for each class its weight and round(log2(additions + 1))."""
    pair = ["package", "before_version", "after_version"]
    classes = diff.where("change = 'added'").groupBy(*pair, "class").agg(F.count(F.lit(1)).alias("n"))
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SURPRISE.items() for x in kv]), F.col("class")), F.lit(50))
    return classes.groupBy(*pair).agg((F.lit(100) + F.sum(weight + F.round(F.log2(F.col("n") + 1)))).cast("long").alias("weight"), F.sum("n").alias("additions"))


def review_queue(comparisons: DataFrame, weights: DataFrame, top: int = 20) -> DataFrame:
    """The heaviest comparable pairs: a top-k, not a sort of everything."""
    pair = ["package", "before_version", "after_version"]
    rows = weights.join(comparisons.where("comparable").select(*pair), pair)
    return rows.orderBy(F.desc("weight"), "package", "after_version").limit(top)
