"""Tags are ``array<struct<k, v>>``: order and repeats matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of relations that are looked at whatever their other tags.
RELATION_TYPES = ("restriction", "through_route", "associatedStreet", "street")
#: Kinds of boundaries that are left out unless named.
UNWANTED_BOUNDARIES = ("administrative", "postal_code", "political")
#: Name tags in order of the document.
NAME_KEYS = ("name", "name:en", "int_name", "note")


def clean(tags: Column) -> Column:
    return F.filter(tags, lambda t: t["k"] != "created_by")


def first(tags: Column, key: str) -> Column:
    """Value of the first tag with this key, or null."""
    return F.get(F.filter(tags, lambda t: t["k"] == key), F.lit(0))["v"]


def wanted_relation(tags: Column, boundary_tags: tuple[str, ...] | None = None, admin_level: int = 5) -> Column:
    """Relations whose parts must stay together. ``boundary_tags`` None: all but the unwanted ones.

    Of repeated keys all ``type`` and ``boundary`` tags count, and the last ``admin_level``.
    """
    def any_of(key: str, test) -> Column:
        return F.coalesce(F.exists(tags, lambda t: (t["k"] == key) & test(t["v"])), F.lit(False))

    direct = any_of("type", lambda v: v.isin(*RELATION_TYPES) | v.startswith("restriction:"))
    area = any_of("type", lambda v: v.isin("multipolygon", "boundary"))
    bounded = any_of("boundary", lambda v: F.lit(True))
    named = ~any_of("boundary", lambda v: v.isin(*UNWANTED_BOUNDARIES)) if boundary_tags is None else any_of("boundary", lambda v: v.isin(*boundary_tags))
    levels = [str(n) for n in range(max(2, admin_level), 12)]
    level = F.coalesce(F.get(F.reverse(F.filter(tags, lambda t: t["k"] == "admin_level")), F.lit(0))["v"].isin(*levels), F.lit(False))
    return direct | area & (~bounded | named | level)


def is_area_relation(tags: Column) -> Column:
    return F.coalesce(first(tags, "type").isin("multipolygon", "boundary"), F.lit(False))


def display_name(tags: Column) -> Column:
    """First name tag in order, else the last key with "name" in it, else the postal code, else "?"."""
    named = F.get(F.filter(tags, lambda t: t["k"].isin(*NAME_KEYS)), F.lit(0))["v"]
    like = F.filter(tags, lambda t: t["k"].contains("name"))
    last = F.get(like, F.size(like) - 1)["v"]
    postal = F.concat(F.lit("postal_code="), first(tags, "postal_code"))
    return F.coalesce(named, last, postal, F.lit("?"))


def escaped(text: Column) -> Column:
    """XML attribute text."""
    for plain, code in (("&", "&amp;"), ("'", "&apos;"), ("<", "&lt;"), ("\n", "&#xA;"), ("\r", "&#xD;"), ("\t", "&#x9;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def written_version(version: Column, policy: str) -> Column:
    """``remove`` writes 0, ``fake`` 1, ``keep`` the input's."""
    return {"remove": F.lit(0), "fake": F.lit(1), "keep": version}[policy].cast("int")
