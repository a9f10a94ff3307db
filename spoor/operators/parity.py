"""Comparing what two recorders saw of one workload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spoor.functions import paths
from spoor.scratch import materialize

#: Kinds of writes that count as the same when a relative path meets an absolute one.
ALIKE = ["open", "write", "create", "truncate"]
#: All tables here grow with the recordings; their files are so dense that Spark would take them for small and broadcast them.
SHUFFLED = "merge"
IDENTITY = ["class", "path", "kind", "ip", "port", "qname", "program"]


def facts(events: DataFrame) -> DataFrame:
    """The different facts of each recording: coarser than behaviours; failed file and network events, and
    paths that are empty or begin with <, are none."""
    c = F.col
    failed = F.coalesce(~c("ok"), F.lit(False))
    op = c("op")
    path = F.when((c("path") != "") & ~c("path").startswith("<"), paths.normalize_path(c("path")))
    kind = F.when(op == "fs_write", "write").when(op == "fs_read", "read").when(op == "net_connect", "connected").when(op == "dns_query", "resolved").when(op == "proc_spawn", "spawned")
    rows = events.where(kind.isNotNull() & ~(failed & op.isin("fs_write", "fs_read", "net_connect")))
    rows = rows.select(
        "recording_id",
        kind.alias("class"),
        F.when(op.isin("fs_write", "fs_read"), path).alias("path"),
        F.when(op == "fs_write", c("kind")).alias("kind"),
        F.when(op == "net_connect", c("ip")).alias("ip"),
        F.when(op == "net_connect", c("port")).alias("port"),
        F.when(op == "dns_query", F.lower("qname")).alias("qname"),
        F.when(op == "proc_spawn", paths.basename(c("bin"))).alias("program"),
    )
    return rows.where(~F.col("class").isin("write", "read") | F.col("path").isNotNull()).dropDuplicates(["recording_id", *IDENTITY])


def differences(sides: DataFrame) -> DataFrame:
    """``sides``: facts with pair_id and side (1 or 2). Each fact with where it was seen: both, first or second."""
    seen = sides.groupBy("pair_id", *IDENTITY).agg(F.max((F.col("side") == 1).cast("int")).alias("a"), F.max((F.col("side") == 2).cast("int")).alias("b"))
    where = F.when((F.col("a") == 1) & (F.col("b") == 1), "both").when(F.col("a") == 1, "first").otherwise("second")
    return seen.select("pair_id", *IDENTITY, where.alias("seen_by"))


def group_of(kind: Column) -> Column:
    return F.when(kind.isin(ALIKE), "content").otherwise(F.coalesce(kind, F.lit("read")))


def path_suffixes(path: Column) -> Column:
    """What follows each / of a path, whole components only."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "/"))


def relative_counterpart(sides: DataFrame) -> DataFrame:
    """``pair_id, side, path, kind_group`` of paths that the other side has in the other notation: relative
    there, absolute here, or the reverse. Every suffix of an absolute path is listed, so it is an equi-join."""
    rows = sides.where(F.col("path").isNotNull()).select("pair_id", "side", "path", group_of(F.col("kind")).alias("kind_group")).distinct()
    absolute = rows.where(F.col("path").startswith("/")).select("pair_id", "side", "path", "kind_group", F.explode(path_suffixes(F.col("path"))).alias("suffix"))
    bare = F.rtrim(F.regexp_replace("path", "^(\\./)+", ""), F.lit("/"))
    relative = rows.where(~F.col("path").startswith("/")).select("pair_id", F.col("side").alias("o_side"), F.col("path").alias("o_path"), "kind_group", bare.alias("suffix")).where("suffix <> ''")
    met = absolute.join(relative.hint(SHUFFLED), ["pair_id", "suffix", "kind_group"]).where("side <> o_side")
    return met.select("pair_id", "side", "path", "kind_group").unionByName(met.select("pair_id", F.col("o_side").alias("side"), F.col("o_path").alias("path"), "kind_group")).distinct()


def mkdir_ancestor(sides: DataFrame) -> DataFrame:
    """``pair_id, path`` of directories made on the second side that some other write of the pair extends: one whose
    path begins with an absolute directory's text, or has a relative one's between slashes or at its end.

    Only pairs with such directories are looked at, and of their written paths only the beginnings as long as one of
    the directories, or the runs of as many components; so both are equi-joins."""
    writes = sides.where("class = 'write'").select("pair_id", "path").distinct()
    made = sides.where("class = 'write' and kind = 'mkdir' and side = 2").select("pair_id", F.col("path").alias("dir")).distinct()
    c = F.col
    absolute = c("dir").startswith("/")
    sizes = made.groupBy("pair_id").agg(F.collect_set(F.when(absolute, F.char_length("dir"))).alias("lengths"), F.collect_set(F.when(~absolute, F.size(F.split("dir", "/")))).alias("counts"))
    rows = writes.join(sizes.hint(SHUFFLED), "pair_id").withColumn("parts", F.split("path", "/"))
    starts = F.transform(F.filter("lengths", lambda n: n < F.char_length("path")), lambda n: F.substring(c("path"), F.lit(1), n))
    # The first component has no slash before it (an absolute path's is empty), so runs begin at the second.
    places = F.sequence(F.lit(2), F.greatest(F.size("parts"), F.lit(2)))
    inner = F.flatten(F.transform("counts", lambda n: F.transform(F.filter(places, lambda i: i + n - 1 <= F.size("parts")), lambda i: F.array_join(F.slice("parts", i, n), "/"))))
    below = rows.select("pair_id", "path", F.explode(F.array_union(starts, inner)).alias("dir"))
    return below.join(made.hint(SHUFFLED), ["pair_id", "dir"]).where("path <> dir").select("pair_id", F.col("dir").alias("path")).distinct()


def compare(sides: DataFrame) -> DataFrame:
    """Every difference of each pair, expected (with the reason) or not."""
    sides = materialize(sides, "parity-facts")
    seen = differences(sides).where("seen_by <> 'both'").withColumn("kind_group", group_of(F.col("kind"))).withColumn("at", F.when(F.col("seen_by") == "first", 1).otherwise(2))
    partner = relative_counterpart(sides).select("pair_id", F.col("side").alias("at"), "path", "kind_group", F.lit(True).alias("has_partner"))
    parent = mkdir_ancestor(sides).select("pair_id", "path", F.lit(2).alias("at"), F.lit("mkdir").alias("kind"), F.lit(True).alias("is_parent"))
    rows = seen.join(partner.hint(SHUFFLED), ["pair_id", "at", "path", "kind_group"], "left").join(parent.hint(SHUFFLED), ["pair_id", "path", "at", "kind"], "left")
    first, partner, cls = F.col("at") == 1, F.coalesce("has_partner", F.lit(False)), F.col("class")
    log = F.col("path").contains("command-stderr.log") | F.col("path").contains("command-stdout.log")
    reason = (
        F.when(first & (cls == "write") & (F.col("path") == "/dev/null"), "null_device")
        .when(first & (cls == "write") & log, "recorder_output")
        .when((cls == "write") & partner, "other_notation")
        .when(first & cls.isin("read", "resolved", "spawned"), "not_observed_by_second")
        .when(first & (cls == "write") & ~F.col("path").startswith("/"), "relative_path")
        .when(~first & (F.col("kind") == "mkdir") & F.coalesce("is_parent", F.lit(False)), "parent_directory")
        .when(~first & (cls == "read") & partner, "other_notation")
        .when(~first & (cls == "spawned"), "spawn_timing")
    )
    return rows.select("pair_id", *IDENTITY, "seen_by", reason.alias("reason"), reason.isNotNull().alias("expected"))


def counts(sides: DataFrame) -> DataFrame:
    """Per pair and class how many facts the first, the second and both saw."""
    count = lambda s: F.count(F.when(F.col("seen_by").isin(s, "both"), 1))
    return differences(sides).groupBy("pair_id", "class").agg(count("first").alias("first"), count("second").alias("second"), F.count(F.when(F.col("seen_by") == "both", 1)).alias("shared"))


def passes(sides: DataFrame, partial: DataFrame) -> DataFrame:
    """``pair_id, unexpected, passed``: whether a pair's differences are all expected and neither side is partial (``partial``:
    pair_id of pairs with a partial side). A pair without a difference passes unless it is partial."""
    unexpected = compare(sides).groupBy("pair_id").agg(F.count(F.when(~F.col("expected"), 1)).alias("n"))
    rows = sides.select("pair_id").distinct().join(unexpected.hint(SHUFFLED), "pair_id", "left").join(partial.select("pair_id", F.lit(True).alias("is_partial")).distinct().hint(SHUFFLED), "pair_id", "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select("pair_id", n.alias("unexpected"), ((n == 0) & F.col("is_partial").isNull()).alias("passed"))
