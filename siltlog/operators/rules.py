"""Rule sets as predicates over parsed rows, and the ordered verdict."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltlog.functions.net import ip_in, parse_network
from siltlog.sources.logs import rule_lines

#: URLs of page parts, and of files that only crawlers ask for.
SECONDARY = r"(\.(jpg|jpeg|png|gif|css|ico|woff|ttf|svg|eot\??))|(robots\.txt|sitemap\.xml|googlecea.+\.html)$"
BENIGN = ("/robots.txt",)
#: How an address rule must begin: four groups of up to three digits.
FOUR_GROUPS = re.compile(r"\d{0,3}(\.\d{0,3}){3}", re.ASCII)
ACCEPT, SKIP, IGNORE, BLOCK, UNPARSED = "accept", "skip", "ignore", "block", "unparsed"
KINDS = ("ip", "net", "url", "ref", "ua", "vhost")


def alternation(rules: list[str]) -> str | None:
    """One pattern for all rules; None (matches nothing) if there are none."""
    rules = [r.strip() for r in rules if r.strip()]
    return "|".join(rules) or None


@dataclass
class Ruleset:
    """Rules by kind. url, ref and vhost block an address; ip, net and ua ignore it."""

    ip: list[str] = field(default_factory=list)
    net: list[str] = field(default_factory=list)
    url: list[str] = field(default_factory=list)
    ref: list[str] = field(default_factory=list)
    ua: list[str] = field(default_factory=list)
    vhost: list[str] = field(default_factory=list)
    exclude: list[int] = field(default_factory=list)
    secondary: bool = False

    @classmethod
    def load(cls, directory: str, exclude: list[int] | None = None, secondary: bool = False) -> Ruleset:
        return cls(**{k: rule_lines(directory, k) for k in KINDS}, exclude=list(exclude or []), secondary=secondary)

    def matches(self, kind: str) -> Column:
        """Whether a row matches a rule of a kind."""
        if kind == "ip":
            good = sorted({r.strip() for r in self.ip if FOUR_GROUPS.match(r.strip())})
            return F.col("ip").isin(good) if good else F.lit(False)
        if kind == "net":
            found = [n for n in map(parse_network, self.net) if n]
            return ip_in(F.col("ip"), found)
        pattern = alternation(getattr(self, kind))
        return F.trim(F.col(kind)).rlike(pattern) if pattern else F.lit(False)

    def verdict(self) -> Column:
        """First match in order; it decides between ignoring and blocking, so the order is part of the result."""
        chain = F.when(~F.col("parsed"), UNPARSED).when(self.matches("ip"), IGNORE)
        if self.secondary:
            chain = chain.when(F.col("url").rlike(SECONDARY), SKIP)
        chain = chain.when(self.matches("url") | self.matches("ref"), BLOCK)
        if self.exclude:
            chain = chain.when(F.col("http").isin(self.exclude), SKIP)
        chain = chain.when(self.matches("ua"), IGNORE).when(self.matches("vhost"), BLOCK)
        return chain.when(F.col("url").isin(*BENIGN), IGNORE).when(self.matches("net"), IGNORE).otherwise(ACCEPT)


def csv_ints(text: str | None) -> list[int]:
    return [int(x) for x in (text or "").split(",") if x.strip()]


def judge(parsed: DataFrame, rules: Ruleset) -> DataFrame:
    return parsed.withColumn("verdict", rules.verdict())
