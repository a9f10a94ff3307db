"""Hosts, addresses and ports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def is_unusual_port(port: Column) -> Column:
    """Neither 80 nor 443; no port and port 0 (a resolver's probe) are not unusual."""
    return F.coalesce(~port.isin(0, 80, 443), F.lit(False))


def host_matches(host: Column, hosts: list[str], suffixes: list[str]) -> Column:
    """Exact host, or a suffix that starts at a label."""
    h = F.lower(F.rtrim(host, F.lit(".")))
    hit = h.isin([x.lower() for x in hosts]) if hosts else F.lit(False)
    for s in suffixes:
        s = s.lstrip(".")
        hit = hit | (h == s) | h.endswith("." + s)
    return F.coalesce(hit, F.lit(False))


def is_loopback(ip: Column) -> Column:
    return F.coalesce(ip.startswith("127.") | (ip == "::1"), F.lit(False))


def is_private(ip: Column) -> Column:
    parts = F.split(ip, "\\.")
    second = F.try_element_at(parts, F.lit(2)).try_cast("int")
    v4 = ip.startswith("10.") | ip.startswith("192.168.") | ip.startswith("169.254.") | (ip.startswith("172.") & second.between(16, 31)) | (ip.startswith("100.") & second.between(64, 127))
    v6 = ip.startswith("fe80:") | ip.rlike("^f[cd][0-9a-f]*:")
    return F.coalesce(v4, F.lit(False)) | F.coalesce(v6, F.lit(False))


def label_suffixes(host: Column) -> Column:
    """All suffixes of a host that start at a label, the host first."""
    labels = F.split(F.lower(F.rtrim(host, F.lit("."))), "\\.")
    return F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
