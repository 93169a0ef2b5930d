"""Addresses of pages: their domain, their form without tracking, their kind."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters of an address that don't tell pages apart.
EPHEMERAL = "t utm_source utm_medium utm_campaign utm_term utm_content ref source src fbclid gclid dclid msclkid twclid mc_cid mc_eid _ga _gl si".split()


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def domain(url: Column) -> Column:
    """The registered part of a host: two labels, three under co.uk and the like; addresses of numbers whole."""
    h = host(url)
    parts = F.split(h, r"\.")
    n = F.size(parts)
    two = F.concat_ws(".", F.slice(parts, -2, 2))
    three = F.concat_ws(".", F.slice(parts, -3, 3))
    named = F.when((n > 2) & two.rlike(r"^(co|com|org|net|edu|gov|mil)\.[a-z]{2}$"), three).when(n >= 2, two).otherwise(h)
    return F.when(F.coalesce(h, F.lit("")) == "", "").when(h.rlike(r"^(localhost|(\d{1,3}\.){3}\d{1,3})$"), h).otherwise(named)


def normalized(url: Column) -> Column:
    """Without fragment and tracking parameters."""
    bare = F.regexp_replace(url, "#.*$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^([^=]*)", 1).isin(EPHEMERAL))
    base = F.regexp_replace(bare, r"\?.*$", "")
    base = F.regexp_replace(base, r"^([A-Za-z]+://[^/]+)$", "$1/")
    return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)).otherwise(url)


def without_text_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#:~:text=[^&]+(&|$)", "")


def kind(url: Column, kinds: Mapping[str, tuple[str, str]]) -> Column:
    """The first kind whose host and path patterns an address fits; null for none."""
    out = F.lit(None).cast("string")
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1)
    for name, (of_host, of_path) in reversed(list(kinds.items())):
        out = F.when(host(url).rlike(of_host) & path.rlike(of_path), name).otherwise(out)
    return out


def is_clippable(url: Column) -> Column:
    return F.coalesce(url.rlike("^https?:"), F.lit(False))


def placeholder_image(source: Column) -> Column:
    """Whether an image's address stands for one that is loaded late."""
    s = F.trim(F.coalesce(source, F.lit("")))
    return (s == "") | s.startswith("data:image/") | (s == "about:blank") | s.rlike(r"(?i)(^|/)(transparent|blank|placeholder|spacer)\.(gif|png|jpe?g|webp)([?#].*)?$")


def absolute(address: Column, base: Column) -> Column:
    """An address as the page at ``base`` means it."""
    scheme, root = F.regexp_extract(base, r"^([A-Za-z]+:)", 1), F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"([^/:]/)[^/]*$", "$1")
    return (
        F.when(address.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), address).when(address.startswith("//"), F.concat(scheme, address)).when(address.startswith("/"), F.concat(root, address))
        .when(address == "", address).otherwise(F.concat(folder, address))
    )
