"""Ids, hashes and urls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .text import first_truthy


def item_id(url: Column, source: Column, title: Column, date: Column) -> Column:
    """24 hex digits of SHA-256 of the url, else of source, title and date."""
    joined = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in (source, title, date)])
    return F.substring(F.sha2(first_truthy(url, joined), 256), 1, 24)


def user_hash(user: Column, salt: str) -> Column:
    return F.when(user.isNotNull(), F.substring(F.sha2(F.concat(F.lit(salt + ":"), user.cast("string")), 256), 1, 16))


def fnv36(c: Column) -> Column:
    """FNV-1a over code points, 32 bits, in base 36."""
    step = lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    chars = F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != "")
    return F.lower(F.conv(F.aggregate(chars, F.lit(2166136261).cast("long"), step).cast("string"), 10, 36))


def preview_key(date: Column, title: Column, venue: Column, kind: Column) -> Column:
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat_ws("-", blank(date), fnv36(F.lower(F.concat_ws("|", blank(date), blank(title), blank(venue), blank(kind)))))


def canonical_url(url: Column) -> Column:
    """Without fragment, query and trailing slash, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), r"/+$", ""))


def sorted_query_url(url: Column, proxy: str = "") -> Column:
    """Without fragment, parameters in order, the proxy in front taken off."""
    if proxy:
        url = F.when(url.startswith(proxy), F.try_url_decode(F.substring(url, len(proxy) + 1, 1 << 20))).otherwise(url)
    plain = F.regexp_replace(url, r"#.*$", "")
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    path = F.regexp_replace(F.regexp_replace(plain, r"\?.*$", ""), r"/+$", "")
    return F.lower(F.concat(path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&")))))


def absolute_url(href: Column, page: Column) -> Column:
    """``href`` as seen from ``page``."""
    origin = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(page, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    return F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(page, "^([^:]+:)", 1), href)).when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(folder, F.lit("/"), href))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def is_private_host(h: Column) -> Column:
    return h.rlike(r"^(localhost|.*\.local|.*\.internal|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|0\.0\.0\.0)$")


def is_clean_image(url: Column) -> Column:
    decoded = F.lower(F.coalesce(F.try_url_decode(url), url))
    bad = "|".join(f"\\Q{m}\\E" for m in rules.BRAND_MARKERS)
    return F.coalesce(decoded.rlike("^https?://") & ~decoded.rlike(bad), F.lit(False))


def is_decorative_image(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike("|".join(f"\\Q{m}\\E" for m in rules.DECORATIVE_MARKERS)), F.lit(False))


def encode_component(c: Column) -> Column:
    """UTF-8 bytes as %XX, but for letters, digits and ``-_.!~*'()``."""
    out = F.url_encode(c)
    for coded, plain in (("+", "%20"), ("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out
