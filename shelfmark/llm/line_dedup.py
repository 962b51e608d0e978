"""Line dedup by site-relative frequency, with DataFrame functions only.

Pages are grouped by host (lower case, without user, port and final dots). A line's ratio is the
number of the host's pages that contain it over the host's pages; lines whose ratio exceeds
``ratio`` are boilerplate of that host and are dropped from its pages. A line on fewer than ``min_on``
pages isn't told from chance and stays: every line of a site of five pages is on a fifth of them. The same
holds for every host, whatever its size.

Lines are the text between block tags of the HTML (or lines of plain text), with tags, comments,
scripts and styles removed, the common entities read, and white space squeezed. A tag, script, style or comment
that isn't closed reaches to the page's end, as in browsers, so every pattern takes a time in proportion to
the page. Empty lines don't count and aren't kept.

Scale: HTML is stripped once, into a table in the shared folder that is read twice. Lines are counted under
128-bit hashes, once a page, with partial sums before the shuffle. A line must be on ``min_on`` pages to be
dropped anywhere, so rarer ones leave before any join. A host's boilerplate lines number at most its mean
lines a page over ``ratio``, however many pages it has, so they travel as one array a host. Heavy hosts are
dealt out over salts.

A null or unreadable URL belongs to the host '' (one site of its own). Null HTML has no line; very long pages are
read whole. Repeated pages count as pages of their own. Ties: a line exactly at the ratio stays. Of the input only the three named
columns are read, so others may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, checkpoint, heavy_keys, salted_join, written

RATIO, MIN_ON = 0.1, 3

#: Fixed patterns, read alike by Java's and RE2's regular expressions.
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
INVISIBLE = r"(?is)<script\b.*?(?:</script\s{0,9}>|\z)|<style\b.*?(?:</style\s{0,9}>|\z)|<!--.*?(?:-->|\z)"
BLOCK_TAG = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|td|th|title|tr|ul)\b[^>]*(?:>|\z)"
ANY_TAG = r"<[/!A-Za-z][^>]*(?:>|\z)"
BLANKS = r"[ \t\x0B\f\r\x{00A0}]+"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", ""), F.lit(""))


def visible_text(html: Column) -> Column:
    """The text of HTML with a line break for each block tag."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), INVISIBLE, " ")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK_TAG, "\n"), ANY_TAG, "")
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def lines_of(text: Column) -> Column:
    """The lines of a text, squeezed, without the empty ones."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " "), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def _hash(line: Column) -> Column:
    """128 bits of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def boilerplate(lined: DataFrame, ratio: float = RATIO, min_on: int = MIN_ON, host: str = "host", lines: str = "lines") -> tuple[DataFrame, DataFrame]:
    """(host, __sm_drop array of line hashes) and (host, n pages), both with a row per host."""
    pages = checkpoint(lined.groupBy(host).agg(F.count(F.lit(1)).alias("n")))
    once = lined.select(host, F.explode(F.array_distinct(F.transform(F.col(lines), _hash))).alias("line"))
    often = checkpoint(once.groupBy(host, "line").agg(F.count(F.lit(1)).alias("on")).filter(F.col("on") >= min_on))
    many = often.groupBy(host).agg(F.count(F.lit(1)).alias("n"))
    rated = salted_join(often, pages, host, heavy_keys(many, host, "n", often.count()), F.col("line"), "inner")
    dropped = rated.filter(F.col("on") > F.lit(float(ratio)) * F.col("n"))
    return dropped.groupBy(host).agg(F.collect_list("line").alias(f"{OWN}drop")), pages


def dedup_lines(pages: DataFrame, ratio: float = RATIO, min_on: int = MIN_ON, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", html: bool = True) -> DataFrame:
    """(id, host, n_lines, n_dropped, text) of every page, the text without the host's boilerplate."""
    text = visible_text(F.col(text_col)) if html else F.col(text_col)
    lined = written(pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), lines_of(text).alias("lines")))
    drop, hosts = boilerplate(lined, ratio, min_on)
    total = hosts.agg(F.sum("n")).first()[0] or 0
    joined = salted_join(lined, drop, "host", heavy_keys(hosts, "host", "n", total), F.concat_ws(",", F.col(id_col).cast("string"), F.size("lines")))
    kept = F.when(F.col(f"{OWN}drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col(f"{OWN}drop"), _hash(x))))
    return joined.withColumn("kept", kept).select(id_col, "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def oracle(ratio: float = RATIO, min_on: int = MIN_ON) -> str:
    """The same over the table ``pages`` in DuckDB's SQL."""
    text = f"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), {_sql_text(INVISIBLE)}, ' ', 'g'), {_sql_text(BLOCK_TAG)}, chr(10), 'g'), {_sql_text(ANY_TAG)}, '', 'g')"
    for name, char in ENTITIES:
        text = f"replace({text}, {_sql_text(name)}, {_sql_text(char)})"
    return f"""
WITH p AS (
  SELECT row_number() OVER () AS k, page_id, coalesce(regexp_replace(lower(regexp_extract(url, {_sql_text(HOST)}, 1)), '\\.+$', ''), '') AS host,
         list_filter(list_transform(string_split(regexp_replace({text}, {_sql_text(BLANKS)}, ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM pages
), h AS (
  SELECT host, count(*) AS n FROM p GROUP BY host
), o AS (
  SELECT host, line, count(*) AS n_on FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line
), b AS (
  SELECT o.host, list(o.line) AS bad FROM o JOIN h ON o.host = h.host WHERE o.n_on >= {min_on} AND o.n_on > CAST({ratio!r} AS DOUBLE) * h.n GROUP BY o.host
), f AS (
  SELECT p.page_id, p.host, p.lines, CASE WHEN b.bad IS NULL THEN p.lines ELSE list_filter(p.lines, lambda x: NOT list_contains(b.bad, x)) END AS kept FROM p LEFT JOIN b ON p.host = b.host
)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS text FROM f
"""
