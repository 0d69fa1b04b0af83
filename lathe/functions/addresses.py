"""Addresses that a fetcher must not connect to."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

SHARED = ipaddress.ip_network("100.64.0.0/10")
#: IPv4 ranges of ``blocked_v4``: loopback, unspecified, link-local, private, multicast, shared.
V4 = ["127.0.0.0/8", "0.0.0.0/32", "169.254.0.0/16", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4", "100.64.0.0/10"]
V6_PRIVATE = ipaddress.ip_network("fc00::/7")


def is_blocked(text: str | None) -> bool:
    """Whether an address is invalid or not public; IPv4 in IPv6 counts as IPv4."""
    try:
        a = ipaddress.ip_address(text or "")
    except ValueError:
        return True
    a = getattr(a, "ipv4_mapped", None) or a
    if a.is_loopback or a.is_unspecified or a.is_link_local or a.is_multicast:
        return True
    if a.version == 4:
        return any(a in ipaddress.ip_network(n) for n in V4)
    return a in V6_PRIVATE


@F.pandas_udf(BooleanType())
def blocked(address: pd.Series) -> pd.Series:
    return address.map(is_blocked)


def blocked_v4(address: Column) -> Column:
    """Native form for dotted IPv4; what is none is blocked."""
    parts = F.split(address, r"\.")
    good = address.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$") & ~address.endswith(".")
    number = sum((F.element_at(parts, i + 1).try_cast("long") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0).cast("long"))
    hit = F.lit(False)
    for n in map(ipaddress.ip_network, V4):
        hit = hit | number.between(int(n.network_address), int(n.broadcast_address))
    return F.when(good, hit).otherwise(True)
