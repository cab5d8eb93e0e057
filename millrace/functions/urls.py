"""Addresses: boards named by URLs and sort-friendly host prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def surt_prefix(url: Column) -> Column:
    """Host labels in reverse, joined by commas, then a bracket and the path: example.org/a is org,example)/a.

    A leading ``*.`` leaves the host open, so the prefix ends with a comma.
    """
    bare = F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.-]*://", "")
    wild = bare.startswith("*.")
    host = F.regexp_replace(F.regexp_extract(bare, r"^(?:\*\.)?([^/?#]*)", 1), r":\d+$", "")
    path = F.regexp_extract(bare, r"^[^/?#]*(/[^#]*)?", 1)
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.when(wild, F.concat(labels, F.lit(","))).otherwise(F.concat(labels, F.lit(")"), path))


def board_slug(url: Column, hosts: str, slug: str = r"[a-z0-9][a-z0-9._-]*") -> Column:
    """The board an https address names: its first path segment, or the ``for`` parameter of an embedded one.

    ``hosts`` is a pattern for the host. Null where the address is no such one.
    """
    path = F.lower(F.regexp_extract(url, rf"(?i)^https://(?:{hosts})/([^/?#]+)", 1))
    embedded = F.lower(F.regexp_extract(url, r"(?i)^https://[^/]+/embed[^?#]*\?(?:[^#]*&)?for=([^&#]+)", 1))
    named = F.when(path == "embed", embedded).otherwise(path)
    return F.when(named.rlike(f"^{slug}$"), named)


def site_board(url: Column) -> Column:
    """``tenant, cell, site`` of an address tenant.cell.host/site, with or without a locale before the site; null for others.

    A cell is a word with a number; the host has two labels or more.
    """
    pattern = r"(?i)^https://([a-z0-9-]+)\.([a-z]+[0-9]+)\.[a-z0-9-]+(?:\.[a-z0-9-]+)+/(?:[a-z]{2}(?:-[a-z]{2})?/)?([a-z0-9][a-z0-9._-]*)(?:[/?#]|$)"
    tenant, cell, site = (F.regexp_extract(url, pattern, i) for i in (1, 2, 3))
    return F.when(url.rlike(pattern), F.struct(F.lower(tenant).alias("tenant"), F.lower(cell).alias("cell"), site.alias("site")))


def board_region(url: Column) -> Column:
    """EU for hosts with a label eu, else US; null for what isn't an https address."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https://([^/?#]+)", 1))
    return F.when(host == "", None).when(host.rlike(r"(^|\.)eu(\.|$)"), "EU").otherwise("US")
