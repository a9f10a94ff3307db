"""The rule catalog: which kinds of hit become which findings, and the lists that rules consult."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

# The lists of the default catalog.
REGISTRY_HOSTS = ["registry.npmjs.org", "registry.npmjs.com", "registry.yarnpkg.com"]
REGISTRY_SUFFIXES = [".npmjs.org", ".npmjs.com", ".yarnpkg.com"]
BINARY_SUFFIXES = ["github.com", "githubusercontent.com", "nodejs.org", "storage.googleapis.com", "s3.amazonaws.com", "cloudfront.net", "jsdelivr.net", "unpkg.com", "azureedge.net"]
CREDENTIAL_FRAGMENTS = ["/.ssh/", "/.aws/", "/.netrc", "/.docker/config.json", "/.git-credentials", "/.kube/", "/.config/gcloud/", "/etc/shadow"]
CREDENTIAL_NAMES = ["id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "credentials", ".env"]
NETWORK_TOOLS = ["curl", "wget", "nc", "ncat", "netcat", "ftp", "scp", "sftp", "ssh"]
EXPECTED_SPAWNS = [
    "node", "npm", "npx", "pnpm", "yarn", "sh", "bash", "dash", "env", "which", "uname", "getconf", "getent", "node-gyp", "node-pre-gyp", "prebuild-install", "python", "python3",
    "make", "gmake", "cmake", "ninja", "cc", "gcc", "c++", "g++", "ld", "ar", "ranlib", "as", "cpp", "collect2", "cc1", "cc1plus", "nm", "objdump", "strip", "install", "libtool",
    "m4", "pkg-config", "ccache", "sccache", "sed", "grep", "egrep", "fgrep", "awk", "cat", "cp", "mv", "rm", "mkdir", "rmdir", "ln", "chmod", "chown", "touch", "true", "false",
    "test", "expr", "basename", "dirname", "printf", "echo", "pwd", "ls", "find", "xargs", "sort", "uniq", "head", "tail", "tr", "wc", "date", "hostname", "id", "sleep", "seq",
    "dd", "tar", "gzip", "gunzip", "unzip", "bzip2", "xz", "zstd", "git", "rustc", "cargo", "go",
]

#: Severities from worst to least, and what each adds to the raw score.
SEVERITIES = ["critical", "high", "medium", "low"]
WEIGHTS = {"critical": 40, "high": 15, "medium": 5, "low": 1}

#: Kind, rule, severity, what must be observable, title.
RULES = [
    ("write_outside_zones", "write_outside_expected_dirs", "critical", "filesystem writes", "wrote outside the project, cache, home, and temp directories"),
    ("chmod_executable_outside_zones", "chmod_exec_outside_project", "high", "filesystem writes", "made a file executable outside the project"),
    ("credential_read", "credential_path_read", "high", "credential reads", "read credentials or environment secrets"),
    ("credential_read_failed", "credential_path_read_attempted", "medium", "credential reads", "attempted to read credentials and failed"),
    ("npmrc_read", "npmrc_read", "low", "credential reads", "read npm configuration, which may contain auth tokens"),
    ("dns_outside_registry", "dns_non_registry_host", "high", "DNS queries", "resolved a host that is not a package registry"),
    ("dns_binary_distribution", "dns_binary_distribution_host", "medium", "DNS queries", "resolved a binary distribution host during install"),
    ("connect_unusual_port", "network_connect_unusual_port", "high", "network connections", "connected to an external address on an unusual port"),
    ("connect_external", "network_connect_external", "low", "network connections", "connected to an external address"),
    ("download_piped_to_shell", "download_piped_to_shell", "critical", "process spawns", "piped a downloaded script into a shell"),
    ("spawn_network_tool", "spawned_network_tool", "high", "process spawns", "spawned a network tool during install"),
    ("spawn_unexpected", "spawned_unexpected_binary", "medium", "process spawns", "spawned a binary outside the expected toolchain"),
]
CLASS_OF_KIND = {r[0]: r[3] for r in RULES}

#: What each recorder sees of each class.
CLASSES = ["filesystem writes", "credential reads", "network connections", "DNS queries", "process spawns", "write volumes"]
UNOBSERVED = {("aya", "credential reads"), ("aya", "DNS queries")}


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    kind: str
    title: str
    note: str = ""
    enabled: bool = True


@dataclass(frozen=True)
class Catalog:
    version: int = 1
    registry_hosts: list[str] = field(default_factory=lambda: list(REGISTRY_HOSTS))
    registry_suffixes: list[str] = field(default_factory=lambda: list(REGISTRY_SUFFIXES))
    binary_distribution_suffixes: list[str] = field(default_factory=lambda: list(BINARY_SUFFIXES))
    credential_paths: list[str] = field(default_factory=lambda: list(CREDENTIAL_FRAGMENTS))
    credential_filenames: list[str] = field(default_factory=lambda: list(CREDENTIAL_NAMES))
    network_tools: list[str] = field(default_factory=lambda: list(NETWORK_TOOLS))
    expected_spawns: list[str] = field(default_factory=lambda: list(EXPECTED_SPAWNS))
    rules: list[Rule] = field(default_factory=lambda: [Rule(i, s, k, t) for k, i, s, _, t in RULES])

    def rows(self, spark: SparkSession) -> DataFrame:
        """The first enabled rule of each kind: ``kind, rule_id, severity, sev_rank, class, title``."""
        first: dict[str, Rule] = {}
        for r in self.rules:
            if r.enabled:
                first.setdefault(r.kind, r)
        rows = [(k, r.id, r.severity, SEVERITIES.index(r.severity), CLASS_OF_KIND[k], r.title) for k, r in first.items()]
        return spark.createDataFrame(rows, "kind string, rule_id string, severity string, sev_rank int, class string, title string")


def load_catalog(path: str | None = None) -> Catalog:
    """The default catalog, or the one in a JSON file, checked: version 1, no unknown field, rules
    with unique ids of a-z, 0-9 and _, known kinds and severities, titles, and one that is enabled."""
    if path is None:
        return Catalog()
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    known = {f.name for f in fields(Catalog)}
    if unknown := set(doc) - known:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    if doc.get("version") != 1:
        raise ValueError(f"catalog version {doc.get('version')} is not supported")
    rules = []
    for r in doc.get("rules", []):
        if unknown := set(r) - {f.name for f in fields(Rule)}:
            raise ValueError(f"unknown fields in a rule: {sorted(unknown)}")
        rule = Rule(**r)
        if not re.fullmatch("[a-z0-9_]+", rule.id):
            raise ValueError(f"bad rule id {rule.id!r}")
        if not rule.title.strip():
            raise ValueError(f"rule {rule.id} has no title")
        if rule.kind not in CLASS_OF_KIND or rule.severity not in SEVERITIES:
            raise ValueError(f"rule {rule.id}: unknown kind or severity")
        rules.append(rule)
    if len({r.id for r in rules}) < len(rules):
        raise ValueError("rule ids repeat")
    if not any(r.enabled for r in rules):
        raise ValueError("no rule is enabled")
    return Catalog(**{**doc, "rules": rules})


# What a recorder's view of a class leaves out.
NOTES = {
    ("strace", "filesystem writes"): "seen through the traced calls; a write submitted to io_uring is not",
    ("strace", "credential reads"): "reads are kept for a list of credential paths only",
    ("strace", "network connections"): "addresses only, no host names; sockets that listen are not traced",
    ("strace", "DNS queries"): "questions sent to port 53; a cut payload gives none, and encrypted DNS is not told from other traffic",
    ("strace", "process spawns"): "arguments up to the tracer's limit; longer command lines are marked as cut",
    ("strace", "write volumes"): "bytes of write calls only, so totals are a floor",
    ("aya", "filesystem writes"): "paths are arguments; a relative one stays unresolved",
    ("aya", "credential reads"): "the probes cover writes, connections and spawns",
    ("aya", "network connections"): "addresses only, no host names",
    ("aya", "DNS queries"): "payloads are not decoded",
    ("aya", "process spawns"): "arguments have slots of fixed width; longer ones are marked as cut",
    ("aya", "write volumes"): "requested bytes, so a short write overstates the total",
}


def coverage(spark: SparkSession) -> DataFrame:
    """``backend, class, observability, note, place``."""
    rows = [(b, c, "unobserved" if (b, c) in UNOBSERVED else "partial", NOTES[b, c], k) for b in ("strace", "aya") for k, c in enumerate(CLASSES)]
    return spark.createDataFrame(rows, "backend string, class string, observability string, note string, place int")


def caveats(spark: SparkSession) -> DataFrame:
    """``backend, blind_spots, qualifications, caveat``: the classes a recorder cannot see, those it sees with limits, and the
    line a report carries about the former (null if there are none)."""
    named = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("observability") == kind, F.struct("place", "class")))), lambda x: x["class"]), ", ")
    rows = coverage(spark).groupBy("backend").agg(named("unobserved").alias("blind_spots"), named("partial").alias("qualifications"))
    line = F.concat(F.lit("Not checked by the "), "backend", F.lit(" backend: "), "blind_spots", F.lit(". Absence of these findings is not evidence they did not happen."))
    return rows.withColumn("caveat", F.when(F.col("blind_spots") != "", line))
