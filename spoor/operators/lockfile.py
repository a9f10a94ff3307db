"""What changed between two lockfiles of a repository, and what of it to record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

IDENTITY = ["repo", "name", "version"]
#: Sources whose code comes from elsewhere. What is unknown counts, since it may.
EXTERNAL = ["remote", "git", "unknown"]
INTRODUCES = ["added", "version_changed", "integrity_changed", "source_changed"]


def external(packages: DataFrame) -> DataFrame:
    """External packages, for each identity and side the one with the first key."""
    return packages.where(F.col("source_kind").isin(EXTERNAL)).groupBy("side", *IDENTITY).agg(F.min_by(F.struct("integrity", "source_kind", "dev", "optional"), "key").alias("p"))


def both_sides(packages: DataFrame) -> DataFrame:
    """Per identity its package before and after, null where it is missing; one grouping serves all that follows."""
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("p")))
    return external(packages).groupBy(*IDENTITY).agg(side("before").alias("before"), side("after").alias("after"))


def groups(p: str) -> Column:
    dev, optional = F.col(f"{p}.dev"), F.col(f"{p}.optional")
    return F.when(dev & optional, "dev, optional").when(dev, "dev").when(optional, "optional").otherwise("prod")


def label() -> Column:
    return F.concat("name", F.when(F.col("version") == "", "").otherwise(F.concat(F.lit("@"), "version")))


def same_identity(pairs: DataFrame) -> DataFrame:
    """Changes of packages that keep name and version; one package can have several."""
    rows = pairs.where(F.col("before").isNotNull() & F.col("after").isNotNull())
    change = lambda kind, summary: F.struct(F.lit(kind).alias("change_type"), summary.alias("summary"))
    found = F.array_compact(
        F.array(
            F.when(F.col("before.integrity") != F.col("after.integrity"), change("integrity_changed", F.concat(label(), F.lit(" same version, different tarball hash")))),
            F.when(F.col("before.source_kind") != F.col("after.source_kind"), change("source_changed", F.concat(label(), F.lit(" now comes from "), "after.source_kind", F.lit(" instead of "), "before.source_kind"))),
            F.when(groups("before") != groups("after"), change("groups_changed", F.concat(label(), F.lit(" moved from "), groups("before"), F.lit(" to "), groups("after")))),
        )
    )
    return rows.select("repo", "name", "version", F.explode(found).alias("c")).select("repo", "name", "version", "c.*")


def one_sided(pairs: DataFrame) -> DataFrame:
    """Identities of one side only: ``repo, name, version, side``."""
    rows = pairs.where(F.col("before").isNull() | F.col("after").isNull())
    return rows.select(*IDENTITY, F.when(F.col("after").isNull(), "before").otherwise("after").alias("side"))


def pair_versions(alone: DataFrame) -> DataFrame:
    """The n-th removed with the n-th added version of a name, in order of the text; what is left over is added or removed."""
    rank = F.row_number().over(Window.partitionBy("repo", "name", "side").orderBy("version"))
    ranked = alone.withColumn("n", rank)
    version = lambda s: F.max(F.when(F.col("side") == s, F.col("version")))
    rows = ranked.groupBy("repo", "name", "n").agg(version("before").alias("old"), version("after").alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("version_changed")
    summary = (
        F.when(F.col("old").isNull(), F.concat(F.lit("added "), "name", F.lit("@"), "new"))
        .when(F.col("new").isNull(), F.concat(F.lit("removed "), "name", F.lit("@"), "old"))
        .otherwise(F.concat("name", F.lit(" "), "old", F.lit(" to "), "new"))
    )
    return rows.select("repo", "name", F.coalesce("new", "old").alias("version"), kind.alias("change_type"), summary.alias("summary"))


def changes(packages: DataFrame) -> DataFrame:
    """All changes: ``repo, name, version, change_type, summary, introduces_code``."""
    pairs = both_sides(packages)
    rows = same_identity(pairs).unionByName(pair_versions(one_sided(pairs)))
    return rows.withColumn("introduces_code", F.col("change_type").isin(INTRODUCES))


def order_changes(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("repo").orderBy(F.desc("introduces_code"), "name", "summary", "version")
    return found.withColumn("place", F.row_number().over(order))


def decision(found: DataFrame) -> DataFrame:
    """Per repository whether to record, and how many identities."""
    recordable = F.col("introduces_code")
    return found.groupBy("repo").agg(F.max("introduces_code").alias("should_record"), F.count(F.lit(1)).alias("changes"), F.countDistinct(F.when(recordable, F.concat("name", F.lit("@"), "version"))).alias("recordable"))


def ecosystem_of(content: Column) -> Column:
    """The package manager that a lockfile's text belongs to; null for what is none."""
    return F.when(content.rlike("(?m)^lockfileVersion:"), "pnpm").when(F.get_json_object(content, "$.lockfileVersion").isNotNull(), "npm")


def ecosystem_changes(files: DataFrame) -> DataFrame:
    """``repo, before, after, ecosystem_changed`` of files (repo, side, content). A repository that had no lockfile before has not changed it."""
    at = lambda side: F.max(F.when(F.col("side") == side, ecosystem_of(F.col("content"))))
    rows = files.groupBy("repo").agg(at("before").alias("before"), at("after").alias("after"))
    return rows.withColumn("ecosystem_changed", F.coalesce(F.col("before") != F.col("after"), F.lit(False)))


def recordable(found: DataFrame) -> DataFrame:
    """``repo, place, name, version``: the different identities to record, in order."""
    rows = found.where("introduces_code").select("repo", "name", "version").distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy("name", "version")))
