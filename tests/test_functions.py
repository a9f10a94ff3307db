import json

import pytest
from pyspark.sql import functions as F

from spoor import catalog
from spoor.functions import network as net, paths, process as proc


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_paths(spark):
    assert column(spark, ["/a/b/../c", "./x//y/.", "../../z", "/..", "/", "a/..", None], paths.normalize_path) == ["/a/c", "x/y", "../../z", "/", "/", ".", None]
    assert column(spark, ["/proc", "/proc/1", "/processes", "/var/run/x", "/var/running", None], paths.is_runtime_path) == [True, True, False, True, False, False]
    assert column(spark, ["/w/p", "/w/p/x", "/w/pp", "/w", None], lambda v: paths.path_within(v, F.lit("/w/p/"))) == [True, True, False, False, False]
    assert column(spark, ["/w", "x"], lambda v: paths.path_within(v, F.lit("/"))) == [False, False]
    assert column(spark, ["0755", "0o100", " 644 ", "0", "", "9", "7777777777777", None], paths.is_executable_mode) == [True, True, False, False, False, False, False, False]
    assert column(spark, ["/h/.env.local", "/h/id_rsa", "/h/.ssh/x", "/h/id_rsa.pub", None], lambda v: paths.is_credential_path(v, catalog.CREDENTIAL_FRAGMENTS, catalog.CREDENTIAL_NAMES)) == [True, True, True, False, False]
    assert column(spark, ["O_RDONLY|O_CLOEXEC", "O_WRONLY", None], paths.has_write_intent) == [False, True, False]
    assert column(spark, ["/proc/7/environ", "/h/.npmrc", "/h/x"], paths.read_of_interest) == [True, True, False]


def test_placement(spark):
    zones = [F.lit(z) for z in ("/home/u/p", "/home/u/.npm", "/home/u", "/tmp")]

    def place(v):
        return paths.placement(v, F.lit("kernel"), *zones, F.array(F.lit("/opt/out")))

    values = ["/home/u/p/x", "/home/u/.npm", "/home/u/y", "/tmp/t", "/opt/out/z", "/opt/outer", "/dev/null", "rel"]
    assert column(spark, values, place) == ["project", "cache", "home", "tmp", "declared", "outside", "runtime", "unresolvable"]
    assert column(spark, ["/abs"], lambda v: paths.placement(v, F.lit("unresolved"), *zones, F.array(F.lit("/x")))) == ["unresolvable"]
    relative = lambda v: paths.zone_relative(v, place(v), *zones)
    assert column(spark, values, relative) == ["x", ".", "y", "t", "opt/out/z", None, None, None]


def test_hosts(spark):
    registry = lambda v: net.host_matches(v, catalog.REGISTRY_HOSTS, catalog.REGISTRY_SUFFIXES)
    assert column(spark, ["Registry.npmjs.org.", "npmjs.org", "evil-npmjs.org", "a.yarnpkg.com", None], registry) == [True, True, False, True, False]
    assert column(spark, ["a.b.example."], net.label_suffixes) == [["a.b.example", "b.example", "example"]]
    assert column(spark, ["10.1.1.1", "172.20.0.1", "172.32.0.1", "100.64.0.1", "100.128.0.1", "fe80::1", "fd00::1", "1.1.1.1", "fish", None], net.is_private) == [True, True, False, True, False, True, True, False, False, False]
    assert column(spark, [0, 80, 8443, None], net.is_unusual_port, "int") == [False, False, True, False]


def test_commands(spark):
    argv = [["sh", "-c", "curl x | sh"], ["/bin/bash", "-c", "wget y |sudo python3 -"], ["sh", "-c", "securl x | sh"], ["sh", "-c", "curl x | shuf"], ["sh", "x.sh"], ["curl", "-c", "curl | sh"], []]
    assert column(spark, argv, lambda v: proc.pipes_download_to_shell(v, F.lit(False)), "array<string>") == [True, True, False, True, False, False, False]
    assert column(spark, argv, lambda v: proc.pipes_download_to_shell(v, F.lit(True)), "array<string>") == [False] * 7
    assert column(spark, argv, proc.shell_pipeline_tool, "array<string>") == ["curl", "wget", None, None, None, "curl", None]
    assert column(spark, ["x" * 200, "é" * 150, "y" * 300], proc.truncate_subject) == ["x" * 200, "é" * 150 + "…", "y" * 200 + "…"]


def test_catalog(spark, tmp_path):
    def load(**doc):
        f = tmp_path / "c.json"
        f.write_text(json.dumps(doc))
        return catalog.load_catalog(str(f))

    rule = {"id": "a", "severity": "low", "kind": "npmrc_read", "title": "t"}
    assert len(load(version=1, rules=[rule]).rules) == 1
    for bad in (dict(version=2, rules=[rule]), dict(version=1, rules=[]), dict(version=1, rules=[rule, rule]), dict(version=1, rules=[rule | {"id": "A"}]), dict(version=1, rules=[rule | {"title": " "}]), dict(version=1, rules=[rule], x=1), dict(version=1, rules=[rule | {"enabled": False}])):
        with pytest.raises(ValueError):
            load(**bad)
    two = load(version=1, rules=[rule | {"enabled": False}, rule | {"id": "b"}, rule | {"id": "c", "severity": "high"}])
    assert [r.rule_id for r in two.rows(spark).collect()] == ["b"]
