"""Lockfiles as rows of packages.

pnpm's files (5.x, 6.x, 9.x) are taken apart line by line: their layout is fixed by indentation, so a window over a file's
lines tells which section and package a line belongs to. The flat layouts (versions 2 and 3) are taken apart with Spark's own JSON functions. The nested layout of
version 1 has no fixed depth; one small function per file flattens it, without a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from spoor.scratch import materialize

ENTRY = "STRUCT<name: STRING, version: STRING, resolved: STRING, integrity: STRING, link: BOOLEAN, dev: BOOLEAN, optional: BOOLEAN, devOptional: BOOLEAN, hasInstallScript: BOOLEAN, workspaces: ARRAY<STRING>>"
FLAT = f"lockfileVersion INT, packages MAP<STRING, {ENTRY}>"
COLUMNS = "lockfile_id string, key string, name string, version string, alias string, source_kind string, url string, integrity string, dev boolean, optional boolean, has_install_script boolean"
GIT = r"^git(\+(ssh|https|http|file))?://"
MODULES = "node_modules/"


def _fail(reason: Column) -> Column:
    return F.raise_error(F.concat("lockfile_id", F.lit(": "), reason))


def _flat(files: DataFrame) -> DataFrame:
    """Packages of a flat layout; files without one give none. A link and the entry it points to are one package: of the link's
    name, the entry's version. What links point to is marked by hashing within the file; a link then searches the marked ones only."""
    packages, marked = F.col("d.packages"), F.col("marked")
    rows = files.select("lockfile_id", F.from_json("content", FLAT).alias("d"))
    targets = F.array_distinct(F.transform(F.filter(F.map_values(packages), lambda e: e["link"]), lambda e: F.coalesce(e["resolved"], F.lit(""))))
    with_mark = F.map_zip_with(packages, F.map_from_arrays(targets, targets), lambda k, e, t: F.struct(e.alias("e"), t.isNotNull().alias("target")))
    globs = F.coalesce(F.try_element_at(packages, F.lit(""))["workspaces"], F.array().cast("array<string>"))
    rows = rows.select("lockfile_id", globs.alias("globs"), with_mark.alias("marked"))
    versions = F.transform_values(F.map_filter(marked, lambda k, x: x["target"]), lambda k, x: x["e"]["version"])
    own_entries = F.map_entries(F.map_filter(marked, lambda k, x: ~x["target"] & (k != "")))
    pointed = lambda v, e: F.when(e["link"], F.try_element_at(v, F.coalesce(e["resolved"], F.lit("")))).otherwise(e["version"])
    # The outer list has one element: that way the versions are looked up once a file, not once an entry.
    entries = F.flatten(F.transform(F.array(versions), lambda v: F.transform(own_entries, lambda x: F.struct(x["key"].alias("key"), x["value"]["e"].alias("e"), pointed(v, x["value"]["e"]).alias("version")))))
    rows = rows.select("lockfile_id", "globs", F.explode(entries).alias("x")).select("lockfile_id", "globs", "x.*")
    e, key = F.col("e"), F.col("key")
    installed = F.when(key.contains(MODULES), F.substring_index(key, MODULES, -1))
    name = F.coalesce(e["name"], installed, _fail(F.concat(F.lit("no name for "), key)))
    linked = F.coalesce(e["link"], F.lit(False))
    own = F.when(linked, F.coalesce(e["resolved"], F.lit(""))).when(~key.startswith(MODULES), key)
    shape = lambda g: F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(g, r"^\./", ""), r"[.+()\[\]{}^$|?]", r"\\$0"), r"\*+", "[^/]*"), F.lit("/?$"))
    workspace = F.exists("globs", lambda g: F.regexp_like(own, shape(g)))
    git = F.coalesce(e["resolved"].rlike(GIT), F.lit(False))
    kind = F.when(own.isNotNull() & workspace, "workspace").when(own.isNotNull(), "directory").when(git, "git").otherwise("remote")
    either = lambda flag: F.coalesce(e[flag], F.lit(False)) | F.coalesce(e["devOptional"], F.lit(False))
    return rows.select(
        "lockfile_id", "key", name.alias("name"), F.coalesce("version", F.lit("")).alias("version"), F.when(installed != e["name"], installed).alias("alias"), kind.alias("source_kind"),
        F.when(own.isNull(), e["resolved"]).alias("url"), F.when(own.isNull() & ~git, e["integrity"]).alias("integrity"), either("dev").alias("dev"), either("optional").alias("optional"), F.coalesce(e["hasInstallScript"], F.lit(False)).alias("has_install_script"),
    )


def flatten_tree(tree: dict) -> Iterator[dict]:
    """Packages of a nested layout; a package below a dev or optional one is so too."""
    todo = [("", tree, False, False)]
    while todo:
        above, entries, dev, optional = todo.pop()
        for installed, e in (entries or {}).items():
            key = f"{above}/{MODULES}{installed}".lstrip("/")
            both = bool(e.get("devOptional"))
            is_dev, is_optional = dev or bool(e.get("dev")) or both, optional or bool(e.get("optional")) or both
            name, version, alias = installed, e.get("version") or "", None
            target, at, number = version.removeprefix("npm:").rpartition("@")
            if version.startswith("npm:") and at and target:
                name, version, alias = target, number, installed
            url = version if version.startswith(("git://", "git+")) else e.get("resolved")
            git = bool(url) and url.startswith(("git://", "git+"))
            yield {"key": key, "name": name, "version": version, "alias": alias, "source_kind": "git" if git else "remote", "url": url, "integrity": None if git else e.get("integrity"), "dev": is_dev, "optional": is_optional, "has_install_script": None}
            todo.append((key, e.get("dependencies"), is_dev, is_optional))


def _nested(files: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"lockfile_id": i, **p} for i, content in zip(batch["lockfile_id"], batch["content"], strict=True) for p in flatten_tree(json.loads(content).get("dependencies") or {})]
            yield pd.DataFrame(rows, columns=names).astype({"dev": bool, "optional": bool, "has_install_script": object})

    return files.select("lockfile_id", "content").mapInPandas(run, COLUMNS)


def read_lockfiles(files: DataFrame) -> DataFrame:
    """Rows ``lockfile_id, content`` (JSON) to a row per package. Text that is no JSON, and a version that is missing
    or not 1 to 3, fail the job and name the file."""
    version = F.get_json_object("content", "$.lockfileVersion").try_cast("int")
    checked = files.select("lockfile_id", F.when(version.between(1, 3), F.col("content")).otherwise(_fail(F.lit("missing or unsupported version"))).alias("content"))
    flat = F.coalesce(F.size(F.from_json("content", FLAT)["packages"]) > 0, F.lit(False))
    return _flat(checked).unionByName(_nested(checked.where(~flat)))


#: pnpm's sections of what a project itself asks for.
ROOTS = ["dependencies", "devDependencies", "optionalDependencies"]


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "^(['\"])(.*)\\1$", "$2")


def pnpm_lines(files: DataFrame) -> DataFrame:
    """``lockfile_id, n, depth, field, value, top, second, third``: the lines of YAML files as pnpm writes them (two spaces a
    level, a field and a value each), with the fields of the levels above."""
    c = F.col
    lines = files.select("lockfile_id", F.posexplode(F.split("content", "\r?\n")).alias("n", "line"))
    lines = lines.where(F.trim("line").rlike("^[^#-]")).withColumn("depth", F.floor((F.char_length("line") - F.char_length(F.ltrim("line"))) / 2).cast("int"))
    parts = F.regexp_extract(F.trim("line"), "^('[^']*'|\"[^\"]*\"|.*?):(?: (.*))?$", 1), F.regexp_extract(F.trim("line"), "^('[^']*'|\"[^\"]*\"|.*?):(?: (.*))?$", 2)
    rows = lines.select("lockfile_id", "n", "depth", _unquoted(parts[0]).alias("field"), F.trim(parts[1]).alias("value"))
    order = Window.partitionBy("lockfile_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = lambda k: F.last(F.when(c("depth") <= k, F.when(c("depth") == k, c("field")).otherwise("")), ignorenulls=True).over(order)
    return rows.select("*", above(0).alias("top"), above(1).alias("second"), above(2).alias("third"))


def read_pnpm_lockfiles(files: DataFrame) -> DataFrame:
    """Rows ``lockfile_id, content`` (YAML as pnpm writes it) to a row per package, as ``read_lockfiles`` gives. A file without a
    version, or with one that is not 5, 6 or 9, and a key that names no package fail the job and name the file.

    Groups come from the dev and optional flags of a package; 9.x has none, so there the roots that name it count: dev only
    if no other root does. Install scripts and aliases are not known. A resolution of no known kind has source ``unknown``.
    """
    c = F.col
    lines = materialize(pnpm_lines(files), "pnpm-lines")
    versions = lines.where("depth = 0 and field = 'lockfileVersion'").groupBy("lockfile_id").agg(F.first(_unquoted(c("value"))).alias("declared"))
    known = files.select("lockfile_id").join(versions, "lockfile_id", "left").withColumn("major", F.regexp_extract(F.coalesce("declared", F.lit("")), "^([0-9]+)", 1))
    known = known.select("lockfile_id", F.when(c("major").isin("5", "6", "9"), c("major")).otherwise(_fail(F.concat(F.lit("missing or unsupported version "), F.coalesce("declared", F.lit(""))))).alias("major"))

    own = lines.where("top = 'packages' and depth >= 1")
    flat = F.regexp_replace(F.when(c("field") == "resolution", c("value")).otherwise(""), "^\\{(.*)\\}$", "$1")
    pairs = F.when(c("field") == "resolution", F.transform(F.filter(F.split(flat, ", "), lambda x: x != ""), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), _unquoted(F.regexp_replace(x, "^[^:]*:", "")).alias("v"))))
    # A resolution on lines of its own is one field a line, a level deeper.
    pairs = F.coalesce(pairs, F.when((c("depth") == 3) & (c("third") == "resolution"), F.array(F.struct(c("field").alias("k"), _unquoted(c("value")).alias("v")))))
    found = lambda k: F.max(F.get(F.filter(pairs, lambda p: p["k"] == k), 0)["v"]).alias(f"r_{k}")
    field = lambda k: F.max(F.when((c("depth") == 2) & (c("field") == k), _unquoted(c("value")))).alias(f"f_{k}")
    rows = own.groupBy("lockfile_id", c("second").alias("key")).agg(*map(found, ["integrity", "tarball", "directory", "type", "repo", "commit"]), *map(field, ["name", "version", "dev", "optional"])).join(known, "lockfile_id")

    key, five = c("key"), c("major") == "5"
    at_url = F.regexp_extract(key, "^(.+?)@(file:.*|https?://.*)$", 1)
    bare = F.regexp_replace(key, "^/", "")
    plain = F.when(five, F.regexp_replace(bare, "_.*$", "")).otherwise(F.regexp_replace(bare, "\\(.*$", ""))
    host = ~key.startswith("/") & key.contains("/") & ~key.contains("@")
    part = lambda pattern, i: F.when(plain.rlike(pattern), F.regexp_extract(plain, pattern, i))
    split = lambda i: F.when(five, part("^(.+)/([^/]+)$", i)).otherwise(part("^(.+)@([^@]+)$", i))
    name = F.when(key.startswith("file:"), F.substring_index(key, "/", -1)).when(at_url != "", F.regexp_replace(at_url, "^/", "")).when(host, key).otherwise(split(1))
    raw = F.when(key.startswith("file:"), F.substring(key, 6, 1 << 20)).when(at_url != "", F.regexp_replace(F.regexp_extract(key, "^(.+?)@(file:.*|https?://.*)$", 2), "^file:", "")).when(host, key)
    version = F.coalesce("f_version", F.when(raw.isNull(), split(2)), F.lit(""))
    kind = F.when(c("r_directory").isNotNull() | (c("r_type") == "directory"), "directory").when(c("r_repo").isNotNull(), "git").when(c("r_tarball").isNotNull() | c("r_integrity").isNotNull(), "remote").otherwise("unknown")
    url = F.when(kind == "directory", F.coalesce("r_directory", raw, F.lit(""))).when(kind == "git", F.concat("r_repo", F.coalesce(F.concat(F.lit("#"), "r_commit"), F.lit("")))).when(kind == "remote", c("r_tarball")).otherwise(F.coalesce(raw, F.lit("")))

    # Roots name a package by its field and resolved version, on the line or on a line of its own.
    section, asked = F.when(c("top") == "importers", c("third")).otherwise(c("top")), c("depth") == F.when(c("top") == "importers", 3).otherwise(1)
    level = F.when(c("top") == "importers", 3).otherwise(1)
    roots = lines.where(section.isin(ROOTS) & (c("depth") >= level)).withColumns({"section": section, "asked": asked})
    order = Window.partitionBy("lockfile_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    roots = roots.withColumn("root", F.last(F.when(c("asked"), c("field")), ignorenulls=True).over(order)).where((c("asked") & (c("value") != "")) | (c("field") == "version"))
    resolved = F.regexp_replace(_unquoted(c("value")), "\\(.*$", "")
    aliased = F.regexp_extract(resolved, "^/?(.+)@([^@/]+)$", 1)
    roots = roots.select("lockfile_id", F.when(aliased != "", aliased).otherwise(c("root")).alias("name"), F.when(aliased != "", F.regexp_extract(resolved, "^/?(.+)@([^@/]+)$", 2)).otherwise(resolved).alias("version"), "section")
    reach = roots.groupBy("lockfile_id", "name", "version").agg(F.max(c("section") != "devDependencies").alias("production"), F.max(c("section") == "devDependencies").alias("development"), F.max(c("section") == "optionalDependencies").alias("by_optional"))

    rows = rows.select("lockfile_id", "key", F.coalesce("f_name", name, _fail(F.concat(F.lit("no name for "), key))).alias("name"), version.alias("version"), kind.alias("source_kind"), F.when(url != "", url).alias("url"), F.when(kind == "remote", c("r_integrity")).alias("integrity"), "major", "f_dev", "f_optional")
    rows = rows.join(reach, ["lockfile_id", "name", "version"], "left")
    by_roots = F.coalesce(c("development") & ~c("production"), F.lit(False))
    dev = F.when(c("major") == "9", by_roots).otherwise(F.coalesce(c("f_dev") == "true", F.lit(False)))
    optional = F.coalesce(c("f_optional") == "true", F.lit(False)) | F.coalesce(c("by_optional") & (c("major") == "9"), F.lit(False))
    return rows.select("lockfile_id", "key", "name", "version", F.lit(None).cast("string").alias("alias"), "source_kind", "url", "integrity", dev.alias("dev"), optional.alias("optional"), F.lit(None).cast("boolean").alias("has_install_script"))
