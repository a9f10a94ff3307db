"""What a reviewer is shown first: techniques, candidates, rankings, contradictions with the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spoor.scratch import materialize

#: Rules with one defensible technique of the public ATT&CK catalog.
TECHNIQUES = {
    "credential_path_read": "T1552.001",
    "credential_path_read_attempted": "T1552.001",
    "npmrc_read": "T1552.001",
    "dns_binary_distribution_host": "T1105",
    "spawned_network_tool": "T1071.001",
    "download_piped_to_shell": "T1059.004",
    "network_connect_unusual_port": "T1571",
    "chmod_exec_outside_project": "T1222.002",
}
#: The install hooks of a package, in order.
HOOKS = ["preinstall", "install", "postinstall", "prepare"]
#: Candidates that a corpus is to reach before it is reviewed.
TARGET = 10
NAME = r"^(?:@[A-Za-z0-9._-]+/)?[A-Za-z0-9._-]+$"


def attack_technique(rule_id: Column) -> Column:
    """The technique of a rule, null where none can be defended."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in TECHNIQUES.items() for x in kv]), rule_id)


def install_hooks(scripts: Column) -> Column:
    """Which hooks a map of scripts declares: those with more than white space."""
    return F.filter(F.array(*map(F.lit, HOOKS)), lambda h: F.coalesce(F.trim(F.element_at(scripts, h)) != "", F.lit(False)))


def valid_package_names(lines: DataFrame) -> DataFrame:
    """``line_no, line`` to ``name, line_no, refused``: the names of a list in order of first appearance, without
    comments, blank lines and pinned versions (behind the last @ that is not the first character). A name outside the
    conservative pattern, or with .., is refused."""
    line = F.trim("line")
    at = F.char_length(line) - F.instr(F.reverse(line), "@") + 1
    name = F.when(line.contains("@") & (at > 1), F.substring(line, F.lit(1), at - 1)).otherwise(line)
    rows = lines.where((line != "") & ~line.startswith("#")).select(name.alias("name"), "line_no")
    return rows.groupBy("name").agg(F.min("line_no").alias("line_no")).withColumn("refused", ~F.col("name").rlike(NAME) | F.col("name").contains(".."))


def declared_vs_recorded(recordings: DataFrame, plan: DataFrame) -> DataFrame:
    """Usable recordings (package, version, events) against what the plan says that their version declares
    (``declares``, an array of hooks): a busy one that declares nothing, or one that declares hooks. Versions the plan
    does not know give nothing."""
    rows = recordings.join(plan.select("package", "version", "declares"), ["package", "version"])
    n = F.size("declares")
    kind = F.when((n == 0) & (F.col("events") > 0), "no_declared_install_script").when(n > 0, "declares_install_script")
    weight = F.when(n > 0, 20).otherwise(10)
    return rows.withColumn("kind", kind).where("kind is not null").select("package", "version", "kind", weight.alias("weight"), F.array_join("declares", ", ").alias("declared"), "events")


def candidate_totals(candidates: DataFrame, recordings: DataFrame) -> DataFrame:
    """One row. candidates: package, rule_id; recordings: package, is_partial, exit_code. Only complete recordings count
    for the target; candidates of partial ones are counted apart."""
    rows = candidates.join(recordings.select("package", "is_partial"), "package")
    whole = ~F.col("is_partial")
    about = recordings.agg(
        F.count(F.lit(1)).alias("packages_recorded"), F.count(F.when(whole, 1)).alias("recordings_complete"), F.count(F.when(~whole, 1)).alias("recordings_partial"), F.count(F.when(F.col("exit_code") != 0, 1)).alias("installs_nonzero_exit")
    )
    found = rows.agg(
        F.count(F.when(whole, 1)).alias("candidates_complete"),
        F.count(F.when(~whole, 1)).alias("candidates_partial"),
        F.countDistinct(F.when(whole, F.struct("package", "rule_id"))).alias("distinct_pairs"),
        F.countDistinct(F.when(whole, F.col("package"))).alias("packages_with_candidates"),
    )
    return about.crossJoin(found).withColumn("meets_target", F.col("distinct_pairs") >= TARGET)  # one row by one row


def candidates_by_rule(candidates: DataFrame, recordings: DataFrame) -> DataFrame:
    """``rule_id, candidates`` of complete recordings."""
    return candidates.join(recordings.where("not is_partial").select("package"), "package").groupBy("rule_id").agg(F.count(F.lit(1)).alias("candidates"))


def rank_packages_by_score(scores: DataFrame, top: int | None = None) -> DataFrame:
    """``package, score, place``: by score, then name. The place is counted in ranges of scores, never in one task: ranges
    are summed up, and rows are numbered within theirs."""
    ranges = materialize(scores.select("package", "score").repartitionByRange(F.desc("score"), F.asc("package")).withColumn("part", F.spark_partition_id()), "ranked")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row per range
    ahead = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("ahead"))
    order = Window.partitionBy("part").orderBy(F.desc("score"), "package")
    rows = ranges.withColumn("n", F.row_number().over(order)).join(F.broadcast(ahead), "part")  # a row per range
    rows = rows.select("package", "score", (F.col("ahead") + F.col("n")).alias("place"))
    return rows if top is None else rows.where(F.col("place") <= top)


def download_claims(counts: DataFrame) -> DataFrame:
    """One row about a table (name, weekly_downloads, null if unknown): what may be said of the packages' popularity."""
    rows = counts.agg(F.count(F.lit(1)).alias("packages_in_list"), F.count("weekly_downloads").alias("packages_with_counts"), F.min("weekly_downloads").alias("min_weekly_downloads"))
    claim = F.when(F.col("min_weekly_downloads").isNull(), "no counts retrieved: make no popularity claim").otherwise(F.format_string("%d packages, each with at least %d weekly downloads", "packages_with_counts", "min_weekly_downloads"))
    return rows.withColumn("packages_without_counts", F.col("packages_in_list") - F.col("packages_with_counts")).withColumn("claim", claim)


def added_as_json(diff: DataFrame) -> DataFrame:
    """A row per pair: ``package, before, after, json`` with the additions as a list of class and summary."""
    added = diff.where("change = 'added'").groupBy("package", F.col("before_version").alias("before"), F.col("after_version").alias("after")).agg(F.array_sort(F.collect_list(F.struct("class", "summary"))).alias("added"))
    return added.select("package", "before", "after", F.to_json(F.struct("package", "before", "after", "added")).alias("json"))


def flatten_added(texts: DataFrame) -> DataFrame:
    """``json`` texts of diffs to a row per addition; a text without a package or a list of additions gives none."""
    kind = "package STRING, before STRING, after STRING, added ARRAY<STRUCT<class: STRING, summary: STRING>>"
    rows = texts.select(F.from_json("json", kind).alias("d")).where("d.package is not null and d.added is not null")
    return rows.select("d.package", "d.before", "d.after", F.explode("d.added").alias("a")).select("package", "before", "after", "a.class", "a.summary")
