"""Paths and the zones they lie in."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ZONES = ("project", "cache", "home", "tmp")


def is_resolved(path: Column, origin: Column) -> Column:
    return F.coalesce((origin != "unresolved") & path.startswith("/"), F.lit(False))


def path_within(path: Column, prefix: Column) -> Column:
    """Whether a path is the prefix or below it, by whole components; an empty prefix or / holds nothing."""
    p = F.rtrim(prefix, F.lit("/"))
    return F.coalesce((p != "") & ((path == p) | F.startswith(path, F.concat(p, F.lit("/")))), F.lit(False))


def is_runtime_path(path: Column) -> Column:
    return F.coalesce(path.rlike("^(/proc|/sys|/dev|/run|/var/run)(/|$)"), F.lit(False))


def placement(path: Column, origin: Column, project: Column, cache: Column, home: Column, tmp: Column, extra: Column) -> Column:
    """The first that holds of unresolvable, runtime, project, cache, home, tmp, declared, outside.
    ``extra``: an array of further zones."""
    out = F.when(~is_resolved(path, origin), "unresolvable").when(is_runtime_path(path), "runtime")
    for name, zone in zip(ZONES, (project, cache, home, tmp), strict=True):
        out = out.when(path_within(path, zone), name)
    declared = F.coalesce(F.exists(extra, lambda z: path_within(path, z)), F.lit(False))
    return out.when(declared, "declared").otherwise("outside")


def zone_relative(path: Column, placed: Column, project: Column, cache: Column, home: Column, tmp: Column) -> Column:
    """The path inside its zone, "." for the zone itself; in a declared zone the whole path; null elsewhere."""
    prefix = F.when(placed == "project", project).when(placed == "cache", cache).when(placed == "home", home).when(placed == "tmp", tmp).otherwise(F.lit(""))
    rest = F.ltrim(F.substring(path, F.char_length(F.rtrim(prefix, F.lit("/"))) + 1, F.char_length(path)), F.lit("/"))
    rest = F.when((rest == "") & (placed != "declared"), ".").otherwise(rest)
    return F.when(placed.isin(*ZONES, "declared"), rest)


def normalize_path(path: Column) -> Column:
    """Without empty, "." and ".." components, by text alone."""
    absolute = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(done: Column, p: Column) -> Column:
        up = (p == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        return F.when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when((p == "..") & absolute, done).otherwise(F.concat(done, F.array(p)))

    kept = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(absolute, F.concat(F.lit("/"), kept)).otherwise(F.when(kept == "", ".").otherwise(kept))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_executable_mode(mode: Column) -> Column:
    """Whether an octal mode has an execute bit; what cannot be parsed has none."""
    digits = F.regexp_replace(F.trim(mode), "^(?:0o)*0*", "")
    digits = F.when(digits == "", "0").otherwise(digits)
    number = F.when(digits.rlike("^[0-7]{1,10}$"), F.conv(digits, 8, 10).cast("long"))
    return F.coalesce((number.bitwiseAND(F.lit(0o111)) != 0) & (number < 1 << 32), F.lit(False))


def is_credential_path(path: Column, fragments: list[str], names: list[str]) -> Column:
    base = basename(path)
    hit = base.isin(names)
    for f in fragments:
        hit = hit | path.contains(f)
    if ".env" in names:
        hit = hit | base.startswith(".env")
    return F.coalesce(hit, F.lit(False))


#: Paths that a recorder keeps reads of.
READ_OF_INTEREST = (
    r"/\.ssh/|/\.aws/|/\.netrc|/\.npmrc|/\.yarnrc|/\.docker/config\.json|/\.git-credentials|/\.gitconfig|/\.kube/|/\.config/gcloud/|/etc/shadow|/etc/passwd"
    r"|(^|/)(id_rsa|id_dsa|id_ecdsa|id_ed25519|credentials|\.npmrc|\.env[^/]*)$|^/proc/(.*/)?environ$"
)


def read_of_interest(path: Column) -> Column:
    return F.coalesce(path.rlike(READ_OF_INTEREST), F.lit(False))


def has_write_intent(flags: Column) -> Column:
    return F.coalesce(flags.rlike("O_WRONLY|O_RDWR|O_CREAT|O_TRUNC|O_APPEND"), F.lit(False))
