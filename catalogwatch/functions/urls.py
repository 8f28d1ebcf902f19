"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogwatch.functions.values import any_of, contains_any, let, strip

# Address marks of a product page.
PRODUCT_MARKS = ("/product/", "/item/", "/goods/", "?id=", "/p/", "/shop/")
# Addresses left out of a crawl, and the content types kept.
STATIC_GLOBS = ("*/static/*", "*/assets/*", "*.pdf", "*.jpg", "*.png", "*.css", "*.js")
PAGE_TYPES = ("text/html", "application/json")
# File endings that are never a product page.
FILE_ENDINGS = (".xml", ".json", ".txt")
# Country by host suffix, then by first address octet.
SUFFIX_COUNTRY = {".ru": "RU", ".us": "US", ".eu": "EU"}
OCTET_COUNTRY = {
    "RU": (45, 80, 91, 147, 178, 185, 193),
    "US": (23, 31, 37, 52, 63, 64, 66, 68, 69, 96, 104, 107, 173, 174, 198, 205),
    "EU": (51, 62, 79, 81, 82, 83, 84, 85, 86, 87, 88, 89),
}
UNKNOWN_COUNTRY = "UN"


def strip_url(c: Column) -> Column:
    """No fragment, no query, no trailing slash; blank -> null."""
    t = F.regexp_replace(strip(c), r"[#?][\s\S]*$", "")
    return F.when(strip(c) != "", F.regexp_replace(t, r"/+$", ""))


def scheme_of(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def netloc_of(c: Column) -> Column:
    """Everything between ``//`` and the path."""
    return F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def host_of(c: Column) -> Column:
    """Lower-case host without user part and port; null when there is none."""
    return F.nullif(F.lower(F.regexp_extract(netloc_of(c), r"^(?:[^@]*@)?([^:@]*)", 1)), F.lit(""))


def path_of(c: Column) -> Column:
    return F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query_of(c: Column) -> Column:
    return F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)


def is_valid_url(c: Column) -> Column:
    return F.coalesce((scheme_of(c) != "") & (netloc_of(c) != ""), F.lit(False))


def slash_path(c: Column) -> Column:
    """End the path with ``/`` unless its last segment looks like a file name."""
    t = strip(c)
    head = F.regexp_extract(t, r"^[^?#]*", 0)
    tail = F.regexp_extract(t, r"^[^?#]*([\s\S]*)$", 1)
    path = path_of(t)
    last = F.element_at(F.split(path, "/"), -1)
    return F.when((path != "") & ~path.endswith("/") & ~last.contains("."), F.concat(head, F.lit("/"), tail)).otherwise(t)


def site_slash_url(c: Column) -> Column:
    """Query and fragment dropped, path always closed by ``/``."""
    t = F.regexp_replace(strip(c), r"[?#][\s\S]*$", "")
    return F.when(t.endswith("/"), t).otherwise(F.concat(t, F.lit("/")))


def normalise_domain(c: Column) -> Column:
    t = F.regexp_replace(F.lower(strip(c)), r"^www\.", "")
    return F.when((t != "") & ~t.rlike(r"[/\\]") & ~t.contains(".."), t)


def path_segments(c: Column) -> Column:
    """Number of ``/``-separated parts of the path."""
    p = F.regexp_replace(path_of(c), r"^/+|/+$", "")
    return F.when(p == "", F.lit(0)).otherwise(F.size(F.split(p, "/")))


def last_segment(c: Column) -> Column:
    p = F.regexp_replace(path_of(c), r"/+$", "")
    return F.element_at(F.split(p, "/"), -1)


def is_product_url(c: Column) -> Column:
    """Catalogue address of depth three ending in a part with a digit, or a product mark."""
    u = F.lower(c)
    parts = F.filter(F.split(path_of(u), "/"), lambda s: s != "")
    deep = u.contains("/catalog/") & (F.size(parts) >= 3) & F.coalesce(F.try_element_at(parts, F.lit(-1)).rlike(r"\d"), F.lit(False))
    return F.coalesce(deep | contains_any(u, PRODUCT_MARKS), F.lit(False))


def looks_like_product(c: Column, patterns=(), min_segments: int = 0, numeric_last: bool = False) -> Column:
    """Product mark or site pattern, deep enough, optionally ending in a number."""
    u = F.lower(c)
    ok = is_product_url(c) | any_of([u.contains(p.lower()) for p in patterns])
    if min_segments:
        ok = ok & (path_segments(c) >= min_segments)
    if numeric_last:
        ok = ok & last_segment(c).rlike(r"^\d+$")
    return F.coalesce(ok, F.lit(False))


def query_param(c: Column, name: str) -> Column:
    """Value of one query parameter (last one wins)."""
    pairs = F.filter(F.split(query_of(c), "&"), lambda p: p.startswith(name + "="))
    return F.substring_index(F.try_element_at(pairs, F.lit(-1)), "=", -1)


def with_query_param(c: Column, name: str, value: Column) -> Column:
    """Set one parameter, keeping the order of the others."""
    base = F.regexp_extract(c, r"^[^?#]*", 0)
    fragment = F.regexp_extract(c, r"(#[\s\S]*)$", 1)
    kept = F.filter(
        F.split(query_of(c), "&"), lambda p: (p != "") & ~p.startswith(name + "=") & (p != name)
    )
    pairs = F.concat(kept, F.array(F.concat(F.lit(name + "="), value.cast("string"))))
    return F.concat(base, F.lit("?"), F.array_join(pairs, "&"), fragment)


def glob_pattern(glob: str) -> str:
    """Regular expression for a shell pattern."""
    return "(?i)^" + "".join(".*" if ch == "*" else "." if ch == "?" else "\\" + ch if not ch.isalnum() else ch for ch in glob) + "$"


def is_static_asset(c: Column, globs=STATIC_GLOBS) -> Column:
    p = path_of(c)
    return any_of([p.rlike(glob_pattern(g)) for g in globs])


def is_page_type(content_type: Column, allowed=PAGE_TYPES) -> Column:
    return F.lower(F.trim(F.substring_index(content_type, ";", 1))).isin(*allowed)


def canonical_proxy(c: Column) -> Column:
    """``scheme://netloc`` with ``https`` as the default scheme; null when there is no host."""
    full = F.regexp_replace(strip(c), r"^(?![\s\S]*://)(?=[\s\S])", "https://")
    address = F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?[^:@/?#][^/?#]*", 0)
    return let(
        F.nullif(address, F.lit("")),
        lambda a: F.concat(F.lower(F.substring_index(a, "://", 1)), F.lit("://"), F.substring_index(a, "://", -1)),
    )


def country_of_host(host: Column) -> Column:
    """Two-letter guess from host suffix or address block."""
    octet = F.split(host, r"\.")[0].try_cast("int")
    out = F.when(F.coalesce(host, F.lit("")) == "", F.lit(UNKNOWN_COUNTRY))
    for suffix, country in SUFFIX_COUNTRY.items():
        out = out.when(host.endswith(suffix), F.lit(country))
    address = host.rlike(r"^\d+\.\d+\.\d+\.\d+$")
    for country, octets in OCTET_COUNTRY.items():
        out = out.when(address & octet.isin(*octets), F.lit(country))
    return out.when(address, F.lit(UNKNOWN_COUNTRY)).otherwise(F.upper(F.substring_index(host, ".", -1)))


def redact_address(c: Column) -> Column:
    """Address without password, query and fragment."""
    user = F.regexp_extract(netloc_of(c), r"^([^:@]*)(?::[^@]*)?@", 1)
    port = F.regexp_extract(netloc_of(c), r"(:\d+)$", 1)
    scheme = scheme_of(c)
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit("://"))).otherwise(F.lit("")),
        F.when(user != "", F.concat(user, F.lit("@"))).otherwise(F.lit("")),
        F.coalesce(host_of(c), F.lit("")),
        port,
        path_of(c),
    )


def is_candidate_url(c: Column, host: Column) -> Column:
    """Page of the given site that is neither its root nor a data file."""
    path = path_of(c)
    keep = scheme_of(c).isin("http", "https") & (netloc_of(c) == host) & ~path.isin("/", "")
    return F.coalesce(keep & ~any_of([path.endswith(e) for e in FILE_ENDINGS]), F.lit(False))


def is_numbered_page(c: Column, host: Column) -> Column:
    """Page of the given site whose path ends in a number."""
    return F.coalesce(
        scheme_of(c).isin("http", "https") & (netloc_of(c) == host) & path_of(c).rlike(r"/\d+/?$"), F.lit(False)
    )


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute address of a link found on a page."""
    h = strip(href)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^[^?#]*", 0), r"(://[^/]+(?:/.*)?)/[^/]*$", "$1/")
    folder = F.when(folder.rlike(r"://[^/]+$"), F.concat(folder, F.lit("/"))).otherwise(folder)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    page = F.regexp_extract(base, r"^[^#]*", 0)
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme_of(base), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(root, h))
        .when(h.startswith("#"), F.concat(page, h))
        .when(h.startswith("?"), F.concat(F.regexp_extract(base, r"^[^?#]*", 0), h))
        .when(h != "", F.concat(folder, h))
    )
