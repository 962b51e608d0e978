"""URLs of a catalogue site, as Column expressions: keys of books, facets, tags and categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

BASE = "https://catalogue.example.org"
#: Path segments that aren't categories.
NOT_CATEGORIES = ("blog", "tags", "xfsearch", "user", "index.php", "engine", "uploads", "templates", "m3u", "bed", "readers.html", "avtors.html", "top-100.html", "sitemap.xml", "rss.xml")
#: The facets' names in URLs.
FACETS = {"author": "avtor", "narrator": "chitaet", "series": "cikl"}


def absolute(href: Column, base: str | Column = BASE) -> Column:
    """A reference resolved against a base: absolute, //host, /path, ?query, #fragment or relative."""
    base = F.lit(base) if isinstance(base, str) else base
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "[^/]*$", "")
    folder = F.when(path == "", "/").otherwise(path)
    resolved = lambda href: (
        F.when(href.isNull() | (href == ""), None)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.\\-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, without_dots(href)))
        .when(href.rlike("^[?#]"), F.concat(F.regexp_replace(base, "[?#].*$", ""), href))
        .otherwise(F.concat(origin, without_dots(F.concat(folder, href))))
    )
    return bound(F.trim(href), resolved)


def without_dots(path: Column) -> Column:
    """A path without its . and .. segments."""
    tail = F.regexp_extract(path, "([?#].*)$", 1)
    parts = F.split(F.regexp_replace(path, "[?#].*$", ""), "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == ".", acc).when(p == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat(F.array_join(kept, "/"), tail)


def path_of(url: Column) -> Column:
    """The path of an absolute URL, / where it is empty."""
    found = lambda url: F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?", 1)
    return bound(url, lambda url: F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), bound(found(url), lambda path: F.when(path == "", "/").otherwise(path))))


def host_of(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def decoded(value: Column) -> Column:
    """Percent-decoded; unchanged where an escape is malformed. A plus stays a plus."""
    return F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)


def normalise_key(raw: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(decoded(raw), r"(?U)\s+", " ")))


def book_ref(url: Column) -> Column:
    """struct(source_id, slug) of /<id>-<slug>.html, else null."""
    pattern = r"^/([0-9]{1,18})-([^/]*)\.html$"
    return bound(path_of(url), lambda path: F.when(path.rlike(pattern), F.struct(F.regexp_extract(path, pattern, 1).try_cast("long").alias("source_id"), F.regexp_extract(path, pattern, 2).alias("slug"))))


def _tail(url: Column, prefix: str) -> Column:
    rest = lambda path: F.regexp_replace(F.substr(path, F.lit(len(prefix) + 1)), "/+$", "")
    return bound(path_of(url), lambda path: F.when(path.startswith(prefix), bound(rest(path), lambda key: F.when(key != "", normalise_key(key)))))


def facet_key(url: Column, kind: str) -> Column:
    """The key of an author's, narrator's or series' page, else null."""
    return _tail(url, f"/xfsearch/{FACETS[kind]}/")


def tag_key(url: Column) -> Column:
    return _tail(url, "/tags/")


def category_key(url: Column) -> Column:
    """The key of a single-segment category path, else null."""
    alone = lambda one: F.when(~one.rlike(r"\.(html|xml)$") & ~one.isin(*NOT_CATEGORIES), normalise_key(one))
    return bound(F.filter(F.split(path_of(url), "/"), lambda s: s != ""), lambda segments: F.when(F.size(segments) == 1, bound(F.element_at(segments, 1), alone)))


def _encoded(key: Column) -> Column:
    return F.replace(F.url_encode(key), F.lit("+"), F.lit("%20"))


def facet_url(kind: str, key: Column, page: Column | None = None, base: str = BASE) -> Column:
    page = F.lit(1) if page is None else page
    return F.concat(F.lit(f"{base}/xfsearch/{FACETS[kind]}/"), _encoded(key), F.lit("/"), F.when(page > 1, F.concat(F.lit("page/"), page.cast("string"), F.lit("/"))).otherwise(""))


def category_url(key: Column, page: Column | None = None, base: str = BASE) -> Column:
    page = F.lit(1) if page is None else page
    return F.concat(F.lit(f"{base}/"), key, F.lit("/"), F.when(page > 1, F.concat(F.lit("page/"), page.cast("string"), F.lit("/"))).otherwise(""))


def book_url(source_id: Column, slug: Column, base: str = BASE) -> Column:
    return F.concat(F.lit(f"{base}/"), source_id.cast("string"), F.lit("-"), slug, F.lit(".html"))


def cookie_domain(domain: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(domain), r"^\.+", ""))


def host_in_domain(host: Column, domain: Column) -> Column:
    """Whether a cookie's domain covers a host: the same, or a parent of it."""
    of = cookie_domain(domain)
    return (F.lower(host) == of) | F.lower(host).endswith(F.concat(F.lit("."), of))


def cookie_expired(expires: Column, now: Column) -> Column:
    """Session cookies (no expiry, or one that isn't positive) never expire."""
    return F.coalesce((expires > 0) & (expires < now), F.lit(False))


#: Extensions that a cover may keep, and those of the image types.
COVER_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")
COVER_TYPES = (("image/jpeg", ".jpg"), ("image/png", ".png"), ("image/webp", ".webp"))


def cover_extension(content_type: Column, url: Column) -> Column:
    """By type, else by the URL's path; .jpg where neither tells."""
    kind = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    own = F.lower(F.regexp_extract(F.coalesce(path_of(url), url), r"(\.[^./]*)$", 1))
    out = F.when(own.isin(*COVER_EXTENSIONS), own).otherwise(".jpg")
    for name, extension in reversed(COVER_TYPES):
        out = F.when(kind == name, extension).otherwise(out)
    return out


def playlist_url(key: Column, base: str = BASE) -> Column:
    """Where the playlist of a key (<id>-<slug>) is; null without one."""
    return F.concat(F.lit(base.rstrip("/") + "/m33u2/"), _encoded(key), F.lit(".m3u"))


def preferred_cover(cover: Column) -> Column:
    """The cover's URL, null where there is none."""
    return F.nullif(F.trim(cover), F.lit(""))


def cover_proxy_url(source_id: Column, cover: Column, version: Column) -> Column:
    """Where a browser gets a book's cover; the address changes with the cached file's version, if there is one."""
    address = F.concat(F.lit("/api/covers/"), source_id.cast("string"))
    return F.when(preferred_cover(cover).isNotNull(), F.concat(address, F.coalesce(F.concat(F.lit("?v="), version.cast("string")), F.lit(""))))
