"""Planning, merging and summing up runs over many packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from spoor.scratch import materialize
from spoor.sources.recordings import incomplete_reason, parse_lines

KEY = ["package", "version"]


def best_result(results: DataFrame) -> DataFrame:
    """One result per package and version: a complete one, then the newest by the text of its start, then the first path."""
    order = Window.partitionBy(*KEY).orderBy(F.coalesce("complete", F.lit(False)).desc(), F.desc_nulls_last("started_at"), "path")
    return results.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def merge_totals(results: DataFrame) -> DataFrame:
    """One row about all results: duplicates that collapsed, and outcomes of the best ones."""
    best = best_result(results)
    count = lambda c: F.count(F.when(c, 1))
    whole = results.agg(F.count(F.lit(1)).alias("results"))
    kept = best.agg(
        F.count(F.lit(1)).alias("kept"),
        count(F.col("complete")).alias("complete"),
        count(F.col("recorded") & ~F.col("complete")).alias("partial"),
        count(~F.col("recorded")).alias("failed"),
        count(F.col("pushed")).alias("pushed"),
        count(~F.col("matches_requested")).alias("version_mismatch"),
        F.countDistinct("package").alias("packages"),
    )
    return whole.crossJoin(kept).withColumn("duplicates_collapsed", F.col("results") - F.col("kept"))  # one row by one row


def dataset_claims(results: DataFrame) -> DataFrame:
    """What may be said of the data: the completion rate to four places, and whether it is high enough."""
    t = merge_totals(results)
    rate = F.round(F.col("complete") / F.col("kept"), 4)
    return t.select(
        rate.alias("completion_rate"),
        (F.col("complete") - F.col("pushed")).alias("complete_not_pushed"),
        (rate >= 0.9).alias("may_claim_completion"),
        F.when(rate < 0.9, "completion rate is under 90 %").otherwise("").alias("withheld"),
    )


def results_vs_registry(results: DataFrame) -> DataFrame:
    """Complete results that were not pushed."""
    return best_result(results).where("complete and not pushed").select(*KEY, "started_at")


def registry_excess(results: DataFrame, readable: int) -> DataFrame:
    """One row: complete results, those not pushed, and how many recordings the registry has beyond the complete ones."""
    best = best_result(results)
    n = F.count(F.when(F.col("complete"), 1))
    return best.agg(n.alias("complete"), F.count(F.when(F.col("complete") & ~F.col("pushed"), 1)).alias("not_pushed"), F.greatest(F.lit(readable) - n, F.lit(0)).alias("excess"))


def plan_counts(plan: DataFrame, results: DataFrame) -> DataFrame:
    """One row: versions planned, already done, and pending."""
    done = results.where("complete").select(*KEY).distinct().withColumn("done", F.lit(True))
    rows = plan.join(done, KEY, "left")
    return rows.agg(F.count(F.lit(1)).alias("planned"), F.count("done").alias("skipped"), F.count(F.when(F.col("done").isNull(), 1)).alias("pending"))


def pending_plan(plan: DataFrame, results: DataFrame) -> DataFrame:
    """Planned versions that no complete result covers; partial ones count as not done."""
    return plan.join(results.where("complete").select(*KEY).distinct(), KEY, "left_anti")


def published_versions(published: DataFrame) -> DataFrame:
    """Published versions that can be planned."""
    return published.where(~F.col("version").contains("-") & ~F.col("unpublished") & F.col("published_at").isNotNull())


# Keys of a registry's times that are no versions, and the scripts that an install runs.
NOT_VERSIONS = ["created", "modified"]
HOOKS = ["preinstall", "install", "postinstall", "prepare"]


def package_versions(documents: DataFrame) -> DataFrame:
    """Registry documents (package, document as JSON) to a row per version with a time: ``package, version, published_at, excluded`` (prerelease,
    unpublished, no_timestamp; null for one that can be planned), ``install_scripts, deprecated, unpacked_bytes, integrity``.

    A document's two maps are taken apart as variants, whatever else it holds, and joined by version: one that is only in the times
    is unpublished, one only among the versions has no place in time and no row. A document that is no JSON fails the job.
    """
    spark, c = documents.sparkSession, F.col
    parsed = materialize(documents.select("package", F.parse_json("document").alias("d")), "registry-documents")
    entries = lambda part: spark.sql(f"SELECT package, e.key AS version, e.value AS value FROM {{docs}}, LATERAL variant_explode(variant_get(d, '$.{part}')) AS e", docs=parsed)
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get("value", path, "variant")) == "STRING", F.try_variant_get("value", path, "string"))
    scripts = F.array_compact(F.array(*[F.when(F.trim(text(f"$.scripts.{h}")) != "", F.lit(h)) for h in HOOKS]))
    manifests = entries("versions").select("package", "version", F.lit(True).alias("held"), scripts.alias("install_scripts"), text("$.deprecated").alias("deprecated"), F.try_variant_get("value", "$.dist.unpackedSize", "long").alias("unpacked_bytes"), text("$.dist.integrity").alias("integrity"))
    times = entries("time").where(~c("version").isin(NOT_VERSIONS)).select("package", "version", F.try_variant_get("value", "$", "string").alias("published_at"))
    rows = times.join(manifests, ["package", "version"], "left")
    excluded = F.when(c("version").contains("-"), "prerelease").when(c("held").isNull(), "unpublished").when(F.try_to_timestamp("published_at").isNull(), "no_timestamp")
    return rows.select("package", "version", "published_at", excluded.alias("excluded"), "install_scripts", "deprecated", "unpacked_bytes", "integrity")


def exclusions(published: DataFrame) -> DataFrame:
    """Per package how many versions are left out, and why (the first reason counts)."""
    pre, gone = F.col("version").contains("-"), F.col("unpublished")
    count = lambda c: F.count(F.when(c, 1))
    return published.groupBy("package").agg(count(pre).alias("prerelease"), count(~pre & gone).alias("unpublished"), count(~pre & ~gone & F.col("published_at").isNull()).alias("no_timestamp"), count(~pre & ~gone & F.col("published_at").isNotNull()).alias("usable"))


def recent_versions(published: DataFrame, n: int = 5) -> DataFrame:
    order = Window.partitionBy("package").orderBy(F.desc("published_at"), F.desc("version"))
    return published_versions(published).withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).select(*KEY, "published_at", "n")


def plan_totals(published: DataFrame, n: int = 5) -> DataFrame:
    resolved = recent_versions(published, n).groupBy("package").agg(F.count(F.lit(1)).alias("versions"))
    every = published.select("package").distinct().join(resolved, "package", "left")
    return every.agg(F.count("versions").alias("resolved"), F.count(F.when(F.col("versions").isNull(), 1)).alias("unresolved"), F.coalesce(F.sum("versions"), F.lit(0)).alias("recordings_planned"))


def shard_spec(plan: DataFrame) -> DataFrame:
    """Per package ``name:v1,v2``, versions in order of the text."""
    return plan.groupBy("package").agg(F.concat("package", F.lit(":"), F.array_join(F.array_sort(F.collect_list("version")), ",")).alias("spec"))


def deal(count: int, weight: int, load: list[int]) -> tuple[list[int], list[int]]:
    """The shards that ``count`` packages of one weight go to, each to the emptiest (the lowest of equals): the first ones
    singly, then, once the loads are less than a weight apart, a round that repeats. ``load`` is brought up to date."""
    first: list[int] = []
    while len(first) < count and max(load) - min(load) >= weight:
        first.append(load.index(min(load)))
        load[first[-1]] += weight
    turn = sorted(range(len(load)), key=lambda s: (load[s], s))
    rounds, rest = divmod(count - len(first), len(load))
    for k, s in enumerate(turn):
        load[s] += weight * (rounds + (k < rest))
    return first, turn


def shard_plan(plan: DataFrame, shards: int) -> DataFrame:
    """``package, versions, shard``: packages from the longest on, each to the emptiest shard (the lowest of
    equals). The driver deals from one row per number of versions; a package's rank among those of its number comes from
    ranges of the sorted packages and the sums of the ranges before."""
    spark, c = plan.sparkSession, F.col
    sized = plan.groupBy("package").agg(F.count(F.lit(1)).alias("versions"))
    rows = materialize(sized.repartitionByRange("versions", "package").withColumn("part", F.spark_partition_id()), "shard-packages")
    before = Window.partitionBy("versions").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("versions", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    load, dealt = [0] * shards, []
    for r in sorted(parts.groupBy("versions").agg(F.sum("n").alias("n")).collect(), key=lambda r: -r.versions):
        dealt.append((r.versions, *deal(r.n, r.versions, load)))
    rules = spark.createDataFrame(dealt, "versions long, first array<int>, turn array<int>")
    order = Window.partitionBy("versions", "part").orderBy("package")
    ranked = rows.withColumn("n", F.row_number().over(order) - 1).join(F.broadcast(parts.select("versions", "part", "offset")), ["versions", "part"]).join(F.broadcast(rules), "versions")
    rank = c("offset") + c("n")
    shard = F.when(rank < F.size("first"), F.get("first", rank.cast("int"))).otherwise(F.get("turn", ((rank - F.size("first")) % shards).cast("int")))
    return ranked.select("package", "versions", shard.alias("shard"))


def latest_snapshot(index: DataFrame) -> DataFrame:
    """The last appended entry of each package and version: by append order, not by time."""
    return index.groupBy(*KEY).agg(F.max_by(F.struct("append_pos", "digest", "recorded_at", "events"), "append_pos").alias("e")).select(*KEY, "e.*")


def version_order(index: DataFrame) -> DataFrame:
    """Versions of a package in order of first appearance."""
    first = index.groupBy(*KEY).agg(F.min("append_pos").alias("first_seen"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("package").orderBy("first_seen")))


def stored_once(index: DataFrame) -> DataFrame:
    """Contents of the store: a digest is kept once, with how often it was pushed."""
    return index.groupBy("digest").agg(F.count(F.lit(1)).alias("pushes"), F.min("append_pos").alias("first_push"))


def snapshot_push(contents: DataFrame, known: DataFrame) -> DataFrame:
    """``contents``: recording_id, package, version and content, the text of a recording; ``known``: digests of the
    store. A row per recording: refused with its reasons (a line that cannot be read, or an incomplete recording),
    or accepted with its digest, and ``stored`` where it brings a content that the store does not have."""
    c = F.col
    lines = contents.select("recording_id", F.posexplode(F.split("content", "\r?\n")).alias("pos", "line")).where(F.trim("line") != "")
    parsed = parse_lines(lines.select("recording_id", (c("pos") + 1).cast("long").alias("seq"), "line"))
    end = F.when(c("op") == "session_end", c("seq"))
    about = parsed.groupBy("recording_id").agg(
        F.min_by(F.concat(F.lit("line "), c("seq").cast("string"), F.lit(": "), "reject"), F.when(c("reject").isNotNull(), c("seq"))).alias("bad"),
        F.coalesce(F.max_by("complete", end), F.lit(False)).alias("complete"),
        F.array_join(F.transform(F.max_by("incomplete_reasons", end), incomplete_reason), "; ").alias("said"),
        F.count(F.when(~c("op").isin("session_start", "session_end", "heartbeat"), 1)).alias("events"),
    )
    why = F.when(c("bad").isNotNull(), c("bad")).when(~F.coalesce("complete", F.lit(False)), F.when(c("said") != "", c("said")).otherwise("the recording has no session_end event"))
    sized = contents.select("recording_id", *KEY, F.sha2("content", 256).alias("digest"), F.octet_length("content").cast("long").alias("bytes"))
    rows = sized.join(about, "recording_id", "left").withColumn("reasons", why).withColumn("accepted", c("reasons").isNull())
    taken = rows.where("accepted")
    new = taken.join(known.select("digest").distinct(), "digest", "left_anti").groupBy("digest").agg(F.min("recording_id").alias("recording_id")).select("recording_id", F.lit(True).alias("new"))
    return rows.join(new, "recording_id", "left").select("recording_id", *KEY, "accepted", F.coalesce("new", F.lit(False)).alias("stored"), F.when(c("accepted"), c("digest")).alias("digest"), F.coalesce("events", F.lit(0)).alias("events"), "bytes", "reasons")


def snapshot_verify(index: DataFrame, blobs: DataFrame) -> DataFrame:
    """Every entry of the index (package, version, digest) read again from the store (digest, content): the number of
    its observations, or the first reason why it fails: a malformed digest, a blob that is missing, one with another hash,
    one that is no stream of events."""
    c = F.col
    lines = blobs.select("digest", F.posexplode(F.split("content", "\r?\n")).alias("pos", "line")).where(F.trim("line") != "")
    parsed = parse_lines(lines.select(c("digest").alias("recording_id"), (c("pos") + 1).cast("long").alias("seq"), "line"))
    read = parsed.groupBy(c("recording_id").alias("digest")).agg(
        F.min_by(F.concat(F.lit("line "), c("seq").cast("string"), F.lit(": "), "reject"), F.when(c("reject").isNotNull(), c("seq"))).alias("bad"),
        F.count(F.when(~c("op").isin("session_start", "session_end", "heartbeat"), 1)).alias("observations"),
    )
    held = blobs.select("digest", F.sha2("content", 256).alias("hash")).join(read, "digest", "left")
    error = (
        F.when(~F.coalesce(c("digest").rlike("^[0-9a-f]{64}$"), F.lit(False)), "malformed digest")
        .when(c("hash").isNull(), "blob missing")
        .when(c("hash") != c("digest"), "content does not match its digest")
        .otherwise(c("bad"))
    )
    rows = index.join(held, "digest", "left").withColumn("error", error)
    return rows.select(*KEY, "digest", F.when(c("error").isNull(), F.coalesce("observations", F.lit(0))).alias("observations"), "error")
