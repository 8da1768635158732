"""Column expressions for links."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Host part of an address, host prefixes without meaning, and
# hosts that say nothing about the shared page.
HOST_PATTERN = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
PREFIX_PATTERN = r"^(?:w+|web|open|m|s|i|es|amp|\w{2}-\w{2}|ar|cl|profile|my|mobile)\."
DISCARDED_DOMAINS = ("", "twitter.com", "bit.ly", "ow.ly", "buff.ly", "fb.me", "goo.gl", "g.co")


def domain(url: Column) -> Column:
    """Host of an address, without one known prefix, in lower case; '' if none."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, HOST_PATTERN, 1), PREFIX_PATTERN, ""))


def is_discarded(name: Column) -> Column:
    return name.isin(*DISCARDED_DOMAINS)


def main_domain(name: Column) -> Column:
    """Last two labels of a host."""
    labels = F.split(name, r"\.")
    return F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), F.lit(2)), ".")


def top_level(name: Column) -> Column:
    """Last label of a host."""
    return F.element_at(F.split(name, r"\."), -1)
