"""Addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrain.functions.values import given

#: Extensions of each class of resource and its boost (fixed values).
RESOURCE_CLASSES = [
    ("html_like", [".html", ".htm", ".xhtml"], 0.12),
    ("document_file", [".pdf", ".txt", ".md"], 0.02),
    ("structured_data", [".json", ".xml", ".rss", ".atom"], -0.28),
    ("media_asset", [".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".mp4", ".mp3"], -0.18),
    ("archive_file", [".zip", ".gz", ".tgz"], -0.14),
]


def host(url: Column) -> Column:
    """Lower-cased host name without port; null if there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"(?i)^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1), F.lit("")))


def path(url: Column) -> Column:
    """The path, ``/`` if it is empty."""
    found = F.regexp_extract(url, r"(?i)^\s*[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(F.trim(found) == "", "/").otherwise(F.trim(found))


def parts(of_path: Column) -> Column:
    """The segments of a path that are not empty."""
    return F.filter(F.split(of_path, "/"), lambda x: x != "")


def depth(of_path: Column) -> Column:
    return F.size(parts(of_path))


def ancestors(of_path: Column) -> Column:
    """The paths above a path and itself, shortest first; without the root."""
    p = parts(of_path)
    upto = F.when(F.size(p) > 0, F.sequence(F.lit(1), F.size(p))).otherwise(F.array().cast("array<int>"))
    return F.transform(upto, lambda i: F.concat(F.lit("/"), F.array_join(F.slice(p, F.lit(1), i), "/")))


#: Labels (fixed values) that stand before a country's label in public suffixes.
SECOND_LEVEL = "ac co com edu gob gouv gov govt go id ind info ltd me mil ne net nhs nic nom or org plc sch".split()


def family(of_host: Column, suffixes: tuple[str, ...] = ()) -> Column:
    """The registrable part of a host: its public suffix and one label more, or
    all of a host that is no longer.

    The public suffix is the longest of ``suffixes`` the host ends with, else a
    second-level label before a country of two letters, else the last label.
    """
    labels = F.split(of_host, r"\.")
    second = F.coalesce(F.get(labels, F.size(labels) - 2).isin(SECOND_LEVEL) & (F.length(F.element_at(labels, -1)) == 2), F.lit(False))
    kept = F.when(second, 3).otherwise(2)
    for suffix in sorted(suffixes, key=lambda x: x.count(".")):
        own = (of_host == suffix) | F.endswith(of_host, F.lit("." + suffix))
        kept = F.when(own, suffix.count(".") + 2).otherwise(kept)
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - kept + 1, F.lit(1)), kept), ".")


def resource_class(of_path: Column) -> Column:
    """The class of a path by its extension; none is html_like."""
    extension = F.lower(F.regexp_extract(of_path, r"(\.[^./]*)$", 1))
    found = F.when(extension == "", "html_like")
    for name, extensions, _ in RESOURCE_CLASSES:
        found = found.when(extension.isin(extensions), name)
    return found.otherwise("unknown")


def resource_boost(of_class: Column) -> Column:
    found = F.when(of_class == "", 0.0)
    for name, _, boost in RESOURCE_CLASSES:
        found = found.when(of_class == name, boost)
    return found.otherwise(0.0)


def structure_boost(url: Column) -> Column:
    """The boost of an address by depth, query, fragment and form of its segments."""
    p, segments = path(url), parts(path(url))
    fragment, query = F.contains(url, F.lit("#")), F.contains(url, F.lit("?"))
    n = F.size(segments)
    by_depth = F.when(n == 1, 0.16).when(n == 2, 0.08).when(n == 3, -0.04).otherwise(-0.20)
    last = F.get(segments, n - 1)
    hyphens = lambda s: F.length(s) - F.length(F.replace(s, F.lit("-"), F.lit("")))

    def segment(s: Column) -> Column:
        opaque = (F.octet_length(s) >= 24) & s.rlike("[A-Za-z]") & s.rlike("[0-9]") & s.rlike("^[A-Za-z0-9._-]*$")
        rest = given((F.octet_length(s) >= 18) & (hyphens(s) >= 2), -0.08) + given(opaque, -0.12) + given(s.contains(".htm"), -0.04)
        return F.when(s.rlike("^[0-9]+$"), -0.08).otherwise(rest)

    each = F.aggregate(segments, F.lit(0.0), lambda a, s: a + segment(s))
    listed = given(last.rlike("^(class|tag|category)-"), -0.10)
    deep = by_depth + given(~query, 0.03) + given(fragment, -0.10) + listed + each
    return F.when((n == 0) | (p == "/"), F.lit(0.22) + given(fragment, -0.10)).otherwise(deep)


def compactness(of_host: Column) -> Column:
    """.20 for the family name itself, .02 for one more label, else -.06."""
    more = F.size(F.split(of_host, r"\.")) - F.size(F.split(family(of_host), r"\."))
    return F.when(more <= 0, 0.20).when(more == 1, 0.02).otherwise(-0.06)


def token_text(url: Column) -> Column:
    """The words of host and path."""
    both = F.concat_ws(" ", host(url), path(url))
    return F.trim(F.regexp_replace(F.lower(both), "[^a-z0-9]+", " "))


def canonical(url: Column) -> Column:
    """Without scheme, ``www.``, query, fragment and closing slashes, lower case."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"^www\.", ""), r"[?#].*$", ""), "/+$", "")


def hinted(of_host: Column, hints: Column) -> Column:
    """A host that is one of the hints or below one."""
    return F.exists(hints, lambda h: (of_host == h) | of_host.endswith(F.concat(F.lit("."), h)))
