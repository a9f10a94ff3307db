"""The first rule set, kept for comparing older corpora: other zones, patterns and weights than the catalog's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spoor.catalog import REGISTRY_HOSTS, REGISTRY_SUFFIXES, NETWORK_TOOLS, WEIGHTS
from spoor.functions import network as net, paths, process as proc
from spoor.operators.rules import OPTIONAL

# Fixed values of the first rule set.
BENIGN = ["/proc/", "/sys/", "/dev/null", "/dev/tty", "/dev/pts/", "/dev/urandom", "/dev/random", "/dev/stdout", "/dev/stderr", "/dev/stdin", "/dev/fd/", "/run/", "/var/run/"]
BINARY_HOSTS = r"(^|\.)(github\.com|githubusercontent\.com|github\.io|nodejs\.org|electronjs\.org|googleapis\.com|s3[.-][a-z0-9-]+\.amazonaws\.com|s3\.amazonaws\.com|cloudfront\.net|jsdelivr\.net|unpkg\.com|azureedge\.net)$"
CREDENTIALS = r"/\.ssh(/|$)|(^|/)id_(rsa|dsa|ecdsa|ed25519)$|/\.aws(/|$)|/\.docker/config\.json$|/\.git-credentials$|/\.netrc$|/\.kube(/|$)|/\.config/gcloud(/|$)|(^|/)\.env(\.[A-Za-z0-9_.-]+)?$|/etc/shadow$|/proc/(self|\d+)/environ$"
EXPECTED = [
    "node", "npm", "npx", "pnpm", "sh", "bash", "env", "which", "uname", "getconf", "node-gyp", "python", "python3", "make", "cc", "gcc", "c++", "g++", "ld", "ar", "ranlib", "as", "cpp", "collect2", "cc1", "cc1plus", "nm",
    "objdump", "strip", "install", "sed", "grep", "egrep", "fgrep", "awk", "cat", "cp", "mv", "rm", "mkdir", "rmdir", "ln", "chmod", "touch", "true", "false", "test", "expr", "basename", "dirname", "printf", "echo", "pwd", "ls",
    "find", "xargs", "sort", "uniq", "head", "tail", "tr", "wc", "date", "hostname", "id", "tar", "gzip", "gunzip", "unzip", "bzip2", "xz", "zstd", "git", "pkg-config", "libtool", "m4", "gmake", "ccache", "sccache",
    "prebuild-install", "node-pre-gyp", "cmake", "ninja", "rustc", "cargo",
]
SHELLS = ["sh", "bash", "dash", "zsh", "ksh", "csh", "tcsh", "fish"]
DOWNLOADS = r"\b(curl|wget|fetch)\b"
INTO_INTERPRETER = r"\|\s*(sudo\s+)?(sh|bash|dash|zsh|python[0-9.]*|perl|ruby|node)\b"
NO_CANDIDATES = ["install_downloads_from_non_registry_host", "network_connect_external", "npmrc_access"]


def pipes_download(argv: Column) -> Column:
    """Whether a shell is given a script that pipes a download into an interpreter."""
    script = F.get(argv, F.array_position(argv, F.lit("-c")).cast("int"))  # positions count from 1, so this is the one behind
    given = (F.size(argv) >= 3) & F.array_contains(argv, "-c")
    return F.coalesce(given & paths.basename(F.get(argv, F.lit(0))).isin(SHELLS) & script.rlike(DOWNLOADS) & script.rlike(INTO_INTERPRETER), F.lit(False))


def legacy_zone() -> Column:
    c = F.col
    path = c("path")
    zone = F.when(path.isNull() | ~path.startswith("/"), "unresolved")
    for name in ("project", "cache", "home", "tmp"):
        zone = zone.when(paths.path_within(path, c(f"zone_{name}")), name)
    benign = F.lit(False)
    for prefix in BENIGN:
        benign = benign | path.startswith(prefix)
    return zone.when(benign, "runtime").when(path.startswith("/tmp/") | path.startswith("/var/tmp/"), "tmp").otherwise("outside")


def legacy_findings(events: DataFrame) -> DataFrame:
    """``recording_id, rule, severity, subject, occurrences``. An event can be several findings; hosts and addresses are one
    each, however often they are met; failed spawns are none; a missing port is unusual."""
    c, lit = F.col, F.lit
    events = events.withColumns({k: lit(None).cast(t) for k, t in OPTIONAL.items() if k not in events.columns})
    op, worked = c("op"), F.coalesce("ok", lit(True))
    chmod = (op == "fs_write") & (c("kind") == "chmod")
    host = F.regexp_replace(F.lower("qname"), r"\.$", "")
    name = F.coalesce(paths.basename(c("bin")), lit(""))
    near = F.coalesce("loopback", net.is_loopback(c("ip"))) | F.coalesce("private", net.is_private(c("ip")))
    address = F.concat(F.coalesce("ip", lit("undefined")), lit(":"), F.coalesce(c("port").cast("string"), lit("undefined")))

    def found(when: Column, rule: Column | str, severity: Column | str, subject: Column) -> Column:
        text = lambda x: lit(x) if isinstance(x, str) else x
        return F.when(when, F.struct(text(rule).alias("rule"), text(severity).alias("severity"), subject.alias("subject")))

    binary = host.rlike(BINARY_HOSTS)
    usual = F.coalesce(c("port").isin(80, 443), lit(False))
    file_op, credential = op.isin("fs_read", "fs_write") & ~F.coalesce(chmod, lit(False)), F.coalesce(c("path").rlike(CREDENTIALS), lit(False))
    spawned, piped = (op == "proc_spawn") & worked, pipes_download(c("argv"))
    all_found = F.array_compact(
        F.array(
            found((op == "fs_write") & ~F.coalesce(chmod, lit(False)) & worked & (c("zone") == "outside"), "write_outside_expected_dirs", "critical", c("path")),
            found(
                (op == "dns_query") & ~net.host_matches(c("qname"), REGISTRY_HOSTS + ["npmjs.org", "www.npmjs.org"], REGISTRY_SUFFIXES) & host.contains("."),
                F.when(binary, "install_downloads_from_non_registry_host").otherwise("dns_non_registry_host"), F.when(binary, "medium").otherwise("high"), host,
            ),
            found((op == "net_connect") & worked & ~near, F.when(usual, "network_connect_external").otherwise("network_connect_unusual_port"), F.when(usual, "low").otherwise("high"), address),
            found(file_op & credential, F.when(worked, "credential_path_access").otherwise("credential_path_access_attempted"), F.when(worked, "high").otherwise("medium"), c("path")),
            found(file_op & ~credential & worked & c("path").endswith("/.npmrc"), "npmrc_access", "low", c("path")),
            found(spawned & piped, "download_piped_to_shell", "critical", proc.command_line(c("argv"), c("bin"))),
            found(spawned & ~piped & name.isin(NETWORK_TOOLS), "spawned_network_tool", "high", name),
            found(spawned & ~piped & ~name.isin(NETWORK_TOOLS) & ~name.isin(EXPECTED), "spawned_unexpected_binary", "medium", name),
            found(chmod & worked & F.coalesce(c("mode").rlike("[751]"), lit(False)) & (c("zone") == "outside"), "chmod_exec_outside_project", "high", c("path")),
        )
    )
    rows = events.withColumn("zone", legacy_zone()).select("recording_id", F.explode(all_found).alias("f")).select("recording_id", "f.*")
    once = c("rule").isin("dns_non_registry_host", "install_downloads_from_non_registry_host", "network_connect_external", "network_connect_unusual_port")
    return rows.groupBy("recording_id", "rule", "severity", "subject").agg(F.count(lit(1)).alias("n")).select("recording_id", "rule", "severity", "subject", F.when(once, 1).otherwise(c("n")).cast("long").alias("occurrences"))


def legacy_classify(events: DataFrame) -> DataFrame:
    """Per recording, with findings or not: counts by severity, the score (low findings count here), candidates."""
    count = lambda s: F.count(F.when(F.col("severity") == s, 1)).alias(s)
    candidate = (F.col("severity") != "low") & ~F.col("rule").isin(NO_CANDIDATES)
    totals = legacy_findings(events).groupBy("recording_id").agg(*map(count, WEIGHTS), F.count(F.when(candidate, 1)).alias("candidates"))
    rows = events.groupBy("recording_id").agg(F.max("package").alias("package"), (~F.max(F.col("complete") & F.col("has_end"))).alias("is_partial")).join(totals, "recording_id", "left")
    rows = rows.fillna(0, [*WEIGHTS, "candidates"])
    raw = sum((F.col(s) * w for s, w in WEIGHTS.items()), F.lit(0))
    return rows.withColumn("raw", raw.cast("long")).withColumn("score", F.least("raw", F.lit(100)).cast("long"))
