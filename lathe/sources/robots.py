"""Robots rules by the public standard: group choice, longest match, wildcards, sitemap lines."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lathe.functions import urls

LONGEST = 1_000_000
#: A failed fetch counts for so long; a fetched file for the whole crawl.
NEGATIVE_SECONDS = 600


@dataclass
class Rules:
    groups: dict[str, list[tuple[bool, str]]] = field(default_factory=dict)
    sitemaps: list[str] = field(default_factory=list)

    def allows(self, agent: str, path: str) -> bool:
        """Longest matching rule decides, an allowance on ties; without one the path is allowed."""
        name = agent.lower()
        own = [k for k in self.groups if k != "*" and k and k in name]
        rules = self.groups[max(own, key=len)] if own else self.groups.get("*", [])
        best = max(((len(pattern), allow) for allow, pattern in rules if pattern and _matches(pattern, path)), default=(0, True))
        return best[1]


def _matches(pattern: str, path: str) -> bool:
    end = pattern.endswith("$")
    text = ".*".join(map(re.escape, (pattern[:-1] if end else pattern).split("*")))
    return re.match(text + ("$" if end else ""), path) is not None


def parse(text: str | None) -> Rules:
    """Rules of a file; unknown lines are skipped."""
    rules, agents, started = Rules(), [], False
    for line in (text or "")[:LONGEST].splitlines():
        key, colon, value = line.split("#", 1)[0].partition(":")
        if not colon:
            continue
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if started:
                agents, started = [], False
            agents.append(value.lower())
            rules.groups.setdefault(value.lower(), [])
        elif key in ("allow", "disallow"):
            started = True
            for a in agents:
                rules.groups[a].append((key == "allow", value))
        elif key == "sitemap" and value:
            rules.sitemaps.append(value)
    return rules


def allowed_udf(agent: str):
    """Arrow-fed function (rules text, path with query) -> allowed; null rules allow all."""

    @F.pandas_udf(BooleanType())
    def allowed(text: pd.Series, path: pd.Series) -> pd.Series:
        known: dict[str, Rules] = {}
        out = []
        for t, p in zip(text, path):
            if t is None:
                out.append(True)
                continue
            if t not in known:
                known[t] = parse(t)
            out.append(known[t].allows(agent, p or "/"))
        return pd.Series(out)

    return allowed


def request_path(url):
    """Path and query of a URL, as robots rules see it."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)", 1)
    return F.when(rest == "", "/").otherwise(rest)


def check(pages: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """Pages (url, ...) with ``robots_ok``; ``robots`` has (host, body), host with its port.

    One row per host: Spark broadcasts it while it is small and shuffles by host beyond that.
    """
    keyed = pages.withColumn("_host", F.lower(urls.authority(F.col("url"))))
    joined = keyed.join(robots.select(F.col("host").alias("_host"), F.col("body").alias("_rules")), "_host", "left")
    return joined.withColumn("robots_ok", allowed_udf(agent)("_rules", request_path(F.col("url")))).drop("_host", "_rules")


def sitemaps(robots: DataFrame) -> DataFrame:
    """Distinct (url) of the sitemap lines."""
    lines = F.regexp_extract_all("body", F.lit(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*(\S+)"), F.lit(1))
    return robots.select(F.explode(lines).alias("url")).distinct()
