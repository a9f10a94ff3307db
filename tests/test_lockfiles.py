import json

import pytest

from spoor.plans import bridge, registry
from spoor.sources import lockfiles
from spoor.sources.lockfiles import read_lockfiles

V3 = {
    "lockfileVersion": 3,
    "packages": {
        "": {"name": "root", "workspaces": ["packages/*"]},
        "node_modules/a": {"version": "1.0.0", "resolved": "https://r/a.tgz", "integrity": "sha512-x", "dev": True, "hasInstallScript": True},
        "node_modules/b/node_modules/@s/c": {"version": "2.0.0", "resolved": "git+https://h/c.git#1", "optional": True},
        "node_modules/alias": {"name": "real", "version": "3.0.0", "devOptional": True},
        "node_modules/w": {"resolved": "packages/w", "link": True},
        "packages/w": {"name": "w", "version": "0.1.0"},
        "node_modules/l": {"resolved": "vendor/l", "link": True},
        "vendor/l": {"name": "l", "version": "0.2.0"},
    },
}
V1 = {
    "lockfileVersion": 1,
    "dependencies": {
        "a": {"version": "1.0.0", "resolved": "https://r/a.tgz", "dev": True, "dependencies": {"d": {"version": "npm:@s/real@4.0.0"}}},
        "g": {"version": "git+ssh://h/g.git#2"},
    },
}


def read(spark, doc):
    text = doc if isinstance(doc, str) else json.dumps(doc)
    return {r.key: r for r in read_lockfiles(spark.createDataFrame([("f", text)], "lockfile_id string, content string")).collect()}


def test_flat(spark):
    got = read(spark, V3)
    short = {k: (r.name, r.version, r.alias, r.source_kind, r.dev, r.optional, r.has_install_script) for k, r in got.items()}
    assert short == {
        "node_modules/a": ("a", "1.0.0", None, "remote", True, False, True),
        "node_modules/b/node_modules/@s/c": ("@s/c", "2.0.0", None, "git", False, True, False),
        "node_modules/alias": ("real", "3.0.0", "alias", "remote", True, True, False),
        "node_modules/w": ("w", "0.1.0", None, "workspace", False, False, False),
        "node_modules/l": ("l", "0.2.0", None, "directory", False, False, False),
    }
    assert got["node_modules/a"].integrity == "sha512-x" and got["node_modules/w"].url is None


def test_query_reads_every_package(spark, sf_dir):
    packages = bridge.lock_packages(spark, sf_dir).collect()
    assert {"directory", "unknown"} <= {p.source_kind for p in packages}
    want = {(f"{p.repo}:{p.side}", f"node_modules/{p.key}/node_modules/{p.name}"): (p.version, "remote" if p.source_kind == "unknown" else p.source_kind, p.dev) for p in packages}
    got = registry.QUERIES["read_lockfiles"](spark, sf_dir).collect()
    assert len(got) == len(want) and {(r.lockfile_id, r.key): (r.version, r.source_kind, r.dev) for r in got} == want


def test_links(spark):
    entries = {
        "": {"name": "root", "version": "9.0.0"},
        "node_modules/x": {"resolved": "vendor/x", "link": True},
        "node_modules/also-x": {"name": "x", "resolved": "vendor/x", "link": True},
        "vendor/x": {"name": "x", "version": "1.0.0"},
        "node_modules/gone": {"resolved": "vendor/gone", "link": True},
        "node_modules/to-link": {"resolved": "node_modules/link", "link": True},
        "node_modules/link": {"resolved": "vendor/x", "link": True, "version": "2.0.0"},
        "node_modules/nowhere": {"link": True},
        "node_modules/plain": {"version": "3.0.0", "integrity": "sha512-p"},
        "vendor/own": {"name": "own", "version": "4.0.0"},
    }
    got = read(spark, {"lockfileVersion": 3, "packages": entries})
    assert {k: (r.name, r.version, r.alias, r.source_kind, r.url, r.integrity) for k, r in got.items()} == {
        "node_modules/x": ("x", "1.0.0", None, "directory", None, None),
        "node_modules/also-x": ("x", "1.0.0", "also-x", "directory", None, None),
        "node_modules/gone": ("gone", "", None, "directory", None, None),
        "node_modules/to-link": ("to-link", "2.0.0", None, "directory", None, None),
        "node_modules/nowhere": ("nowhere", "9.0.0", None, "directory", None, None),
        "node_modules/plain": ("plain", "3.0.0", None, "remote", None, "sha512-p"),
        "vendor/own": ("own", "4.0.0", None, "directory", None, None),
    }


def test_nested(spark):
    got = read(spark, V1)
    assert {k: (r.name, r.version, r.alias, r.source_kind, r.dev) for k, r in got.items()} == {
        "node_modules/a": ("a", "1.0.0", None, "remote", True),
        "node_modules/a/node_modules/d": ("@s/real", "4.0.0", "d", "remote", True),
        "node_modules/g": ("g", "git+ssh://h/g.git#2", None, "git", False),
    }


def test_refused(spark):
    for bad in ("", "{", {"packages": {}}, {"lockfileVersion": 4}, {"lockfileVersion": 3, "packages": {"odd/path": {"version": "1"}}}):
        with pytest.raises(Exception):
            read(spark, bad)


PNPM = {
    "five": """lockfileVersion: 5.4

specifiers:
  a: ^1.0.0

dependencies:
  a: 1.0.0

packages:

  /a/1.0.0:
    resolution: {integrity: sha512-a}
    dev: false

  /@s/b/2.0.0_peer@3.0.0:
    resolution: {integrity: sha512-b}
    dependencies:
      a: 1.0.0
    dev: true
    optional: true

  github.com/u/ms/0123:
    resolution: {tarball: https://codeload.github.com/u/ms/tar.gz/0123}
    name: ms
    version: 2.1.3
    dev: false

  file:../local:
    resolution: {directory: ../local, type: directory}
    name: local
    version: 0.0.1
    dev: true
""",
    "nine": """lockfileVersion: '9.0'

importers:

  .:
    dependencies:
      a:
        specifier: ^1.0.0
        version: 1.0.0(p@3.0.0)
      alias:
        specifier: npm:real@2.0.0
        version: real@2.0.0
    devDependencies:
      '@s/b':
        specifier: ^2.0.0
        version: 2.0.0
      a:
        specifier: ^1.0.0
        version: 1.0.0

packages:

  a@1.0.0:
    resolution: {integrity: sha512-a}

  '@s/b@2.0.0':
    resolution: {integrity: sha512-b}

  real@2.0.0:
    resolution: {}

  ms@https://codeload.github.com/u/ms/tar.gz/0123:
    resolution: {tarball: https://codeload.github.com/u/ms/tar.gz/0123}
    version: 2.1.3

  git@file:../g:
    resolution:
      repo: https://h/g.git
      commit: abc
      type: git

snapshots:

  a@1.0.0: {}
""",
}


def test_pnpm(spark):
    files = spark.createDataFrame(list(PNPM.items()), "lockfile_id string, content string")
    got = {(r.lockfile_id, r.key): (r.name, r.version, r.source_kind, r.url, r.integrity, r.dev, r.optional) for r in lockfiles.read_pnpm_lockfiles(files).collect()}
    tar = "https://codeload.github.com/u/ms/tar.gz/0123"
    assert got == {
        ("five", "/a/1.0.0"): ("a", "1.0.0", "remote", None, "sha512-a", False, False),
        ("five", "/@s/b/2.0.0_peer@3.0.0"): ("@s/b", "2.0.0", "remote", None, "sha512-b", True, True),
        ("five", "github.com/u/ms/0123"): ("ms", "2.1.3", "remote", tar, None, False, False),
        ("five", "file:../local"): ("local", "0.0.1", "directory", "../local", None, True, False),
        ("nine", "a@1.0.0"): ("a", "1.0.0", "remote", None, "sha512-a", False, False),
        ("nine", "@s/b@2.0.0"): ("@s/b", "2.0.0", "remote", None, "sha512-b", True, False),
        ("nine", "real@2.0.0"): ("real", "2.0.0", "unknown", None, None, False, False),
        ("nine", f"ms@{tar}"): ("ms", "2.1.3", "remote", tar, None, False, False),
        ("nine", "git@file:../g"): ("git", "", "git", "https://h/g.git#abc", None, False, False),
    }
    for bad in ("packages:\n\n  /a/1.0.0:\n    dev: true\n", "lockfileVersion: 7.0\n\npackages:\n\n  /a/1.0.0:\n    dev: true\n"):
        with pytest.raises(Exception, match="missing or unsupported version"):
            lockfiles.read_pnpm_lockfiles(spark.createDataFrame([("bad", bad)], "lockfile_id string, content string")).collect()


def test_lines_of_written_lockfiles_take_one_exchange(spark, sf_dir, monkeypatch):
    from spoor.plans import sources
    from spoor.sources import lockfiles

    kept = []
    read = lockfiles.read_pnpm_lockfiles
    monkeypatch.setattr(lockfiles, "read_pnpm_lockfiles", lambda files: kept.append(files) or read(files))
    sources.read_pnpm_lockfiles(spark, sf_dir)
    plan = lockfiles.pnpm_lines(kept[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
