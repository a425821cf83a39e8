"""URL functions, as Column expressions; the general relative join is an Arrow UDF."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import _c

# What a documentation link may not end with or contain.
SKIP_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".pdf", ".zip", ".tar", ".gz", ".css", ".js", ".ico", ".woff", ".woff2", ".mp4", ".mp3"]
BAD_SEGMENTS = ["login", "signup", "privacy", "terms", "cookie", "careers", "pricing", "billing", "about", "contact"]


def url_key(url: Column | str) -> Column:
    return F.md5(_c(url))


def normalize_url(url: Column | str) -> Column:
    """Scheme, host and path without trailing slashes; parameters of the last segment, query and fragment are dropped."""
    bare = F.regexp_replace(_c(url), r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r";[^/]*$", ""), r"/+$", "")


def netloc(url: Column | str) -> Column:
    """host[:port], empty if there is none."""
    return F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column | str) -> Column:
    rest = F.regexp_replace(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/?#]*)?", "")
    return F.regexp_replace(F.regexp_replace(rest, r"[?#].*$", ""), r";[^/]*$", "")


def is_doc_link(url: Column | str, base_netloc: Column | str) -> Column:
    """Same host as base or none; no skipped extension; none of the bad segments anywhere in the path."""
    host, p = netloc(url), F.lower(path(url))
    ok = (host == _c(base_netloc)) | (host == "")
    for x in SKIP_EXTENSIONS:
        ok = ok & ~p.endswith(x)
    for x in BAD_SEGMENTS:
        ok = ok & ~p.contains(x)
    return F.coalesce(ok, F.lit(False))


def resolve_simple(current: Column | str, href: Column | str) -> Column:
    """RFC 3986 for absolute, protocol-relative and root-relative references; null for others."""
    h, root = _c(href), F.regexp_extract(_c(current), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(_c(current), r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    return F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(scheme, h)).when(h.startswith("/"), F.concat(root, h))


def resolve_path(current: Column | str, href: Column | str) -> Column:
    """RFC 3986 for references without scheme and host: the current URL's root and a path without dot segments.

    Query and fragment are dropped, as normalize_url does. An empty path is the current one.
    """
    root = F.regexp_extract(_c(current), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    own = F.regexp_replace(F.regexp_replace(_c(href), r"[?#].*$", ""), r";[^/]*$", "")
    folder = F.regexp_replace(path(current), r"[^/]*$", "")
    whole = F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))
    steps = F.filter(F.split(whole, "/"), lambda x: (x != "") & (x != "."))
    up = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x))
    plain = F.aggregate(steps, F.array().cast("array<string>"), up)
    return F.when(root != "", F.when(own == "", F.concat(root, path(current))).otherwise(F.concat(root, F.lit("/"), F.array_join(plain, "/"))))


@F.pandas_udf(StringType())
def resolve(current: pd.Series, href: pd.Series) -> pd.Series:
    """RFC 3986 in full; null where a URL can't be read."""

    def one(a, b):
        try:
            return urljoin(a or "", b or "")
        except ValueError:
            return None

    return pd.Series([one(a, b) for a, b in zip(current, href, strict=True)], dtype=object)


def extract_links(html: Column | str, current: Column | str) -> Column:
    """Sorted distinct documentation links of a page's anchors on its own host, in any form of reference, resolved and normalised."""
    hrefs = extract_hrefs(html)
    whole = lambda h: h.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|//)")
    links = F.transform(hrefs, lambda h: normalize_url(F.when(whole(h), resolve_simple(current, h)).otherwise(resolve_path(current, h))))
    return F.array_sort(F.array_distinct(F.filter(links, lambda x: x.isNotNull() & is_doc_link(x, netloc(current)))))


def extract_hrefs(html: Column | str) -> Column:
    """The href of every anchor but those within the page, in order."""
    found = F.regexp_extract_all(_c(html), F.lit(r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return F.filter(F.transform(found, lambda h: F.replace(h, F.lit("&amp;"), F.lit("&"))), lambda h: ~h.startswith("#"))
