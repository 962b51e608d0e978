"""Queries over contents: text functions, matching, pages, playlists, sidecars, telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import matching, nearest, pages, passing, playlist, sidecar, sync, telemetry
from ..sources import library
from ..staging import once
from .catalogue_queries import query
from .testviews import Views

_LETTERS = r"[^\p{L}\p{N}#]+"


def _strip_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '[’''`ʼ]', '', 'g'), '{_LETTERS}', ' ', 'g'))"


def _dice_sql(a: str, b: str) -> str:
    """Dice over bigrams of two texts without white space."""
    grams = lambda x: f"list_transform(range(1, length({x})), lambda i: substring({x}, i, 2))"
    shared = f"list_sum(list_transform(list_distinct({grams(a)}), lambda g: least(len(list_filter({grams(a)}, lambda x: x = g)), len(list_filter({grams(b)}, lambda y: y = g)))))"
    return f"(CASE WHEN {a} = {b} THEN 1.0 WHEN length({a}) < 2 OR length({b}) < 2 THEN 0.0 ELSE 2.0 * {shared} / (length({a}) - 1 + length({b}) - 1) END)::DOUBLE"


def _translit_sql(x: str) -> str:
    out = f"lower({x})"
    for k, letter in enumerate(text.TRANSLIT_ONE[0]):
        out = f"replace({out}, '{letter}', '{text.TRANSLIT_ONE[1][k]}')"
    for letter, latin in text.TRANSLIT_MANY:
        out = f"replace({out}, '{letter}', '{latin}')"
    for letter in text.TRANSLIT_NONE:
        out = f"replace({out}, '{letter * 2 if letter == chr(39) else letter}', '')"
    return out


@query("SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: length(t) >= 4)[1:4], ' ') AS tokens FROM documents", views=False)
def tokenise_title(v: Views) -> DataFrame:
    """The search words of a document, whose whole text is taken for a title."""
    return v.table("documents").select("doc_id", F.array_join(text.title_tokens(F.col("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, md5({_strip_sql('lower(text)')}) AS norm FROM documents", views=False)
def normalise_text(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.md5(text.normalise_name(F.col("text")).cast("binary")).alias("norm"))


_SUFFIXES = (" Книга 2", " (Т. 2)", ", частина II", " vol. 007", " Book IX - part 3", " #12", " том XIX том 19", " Vol 5 кн. v", "", ", част. 1 #1", " vol. 0007 ч.12")
_ROMANS = (("iii", 3), ("xix", 19), ("ii", 2), ("ix", 9), ("iv", 4), ("v", 5), ("i", 1), ("x", 10))


def _suffix_sql(key: str) -> str:
    return f"CASE {key} % {len(_SUFFIXES)} " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(_SUFFIXES)) + " END"


def _suffix(key: str) -> F.Column:
    return F.element_at(F.array(*[F.lit(s) for s in _SUFFIXES]), (F.col(key) % len(_SUFFIXES) + 1).cast("int"))


def _norm_sql(rows: str) -> str:
    """(source_id, norm) of rows (source_id, t), the title normalised."""
    # without look-around the boundary is taken along and put back; twice, for neighbours that share one
    words, out = "|".join(text.VOLUME_WORDS), "' ' || lower(t) || ' '"
    for _ in range(2):
        out = f"regexp_replace({out}, '([^\\p{{L}}\\p{{N}}])(?:{words})\\s*\\.?\\s*(?:0{{0,2}}([0-9])|0?([0-9]{{2}})|([0-9]{{3}}))([^\\p{{L}}\\p{{N}}])', '\\1 #\\2\\3\\4 \\5', 'g')"
        for roman, number in _ROMANS:
            out = f"regexp_replace({out}, '([^\\p{{L}}\\p{{N}}])(?:{words})\\s*\\.?\\s*{roman}([^\\p{{L}}\\p{{N}}])', '\\1 #{number} \\2', 'g')"
    out = f"string_split({_strip_sql(f"regexp_replace({out}, '#\\s*([0-9]{{1,3}})', ' #\\1 ', 'g')")}, ' ')"
    return f"SELECT source_id, array_to_string(list_filter(x, lambda t, i: NOT starts_with(t, '#') OR list_position(x, t) = i), ' ') AS norm FROM (SELECT source_id, {out} AS x FROM ({rows}))"


@query(_norm_sql(f"SELECT p_partkey AS source_id, p_name || {_suffix_sql('p_partkey')} AS t FROM part"), views=False)
def normalise_title_volumes(v: Views) -> DataFrame:
    return v.table("part").select(F.col("p_partkey").alias("source_id"), text.normalise_title(F.concat("p_name", _suffix("p_partkey"))).alias("norm"))


_WORDS = ("Характерник", "Щастя", "Кайдашева сім'я", "Їжак і Єва", "Ґанок, цукор", "Юність ёлки эхо", "Plain title")


@query("SELECT p_partkey AS source_id, " + _translit_sql("w || ' ' || p_name") + " AS latin FROM (SELECT *, CASE p_partkey % 7 " + " ".join(f"WHEN {k} THEN '{w.replace(chr(39), chr(39) * 2)}'" for k, w in enumerate(_WORDS)) + " END AS w FROM part)", views=False)
def transliterate(v: Views) -> DataFrame:
    word = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return v.table("part").select(F.col("p_partkey").alias("source_id"), text.transliterate(F.concat(word, F.lit(" "), F.col("p_name"))).alias("latin"))


@query(
    f""", marked AS ({_norm_sql(f"SELECT source_id, title || {_suffix_sql('source_id')} AS t FROM books")})
    SELECT b.source_id, md5(coalesce(nullif(array_to_string(list_sort(list_transform(coalesce(a.names, []), lambda n: {_strip_sql('lower(n)')})), '&'), ''), '?') || '|' || m.norm) AS work_key
    FROM books b JOIN marked m ON m.source_id = b.source_id LEFT JOIN (SELECT source_id, list(name) AS names FROM book_authors JOIN authors ON author_key = key WHERE source_id % 4 <> 0 GROUP BY source_id) a ON a.source_id = b.source_id"""
)
def work_identity(v: Views) -> DataFrame:
    """The works of marked titles; every fourth book has no author."""
    people = v.book_authors.join(v.authors, F.col("author_key") == F.col("key")).filter("source_id % 4 <> 0").groupBy("source_id").agg(F.collect_list("name").alias("names"))
    return v.titles.join(people, "source_id", "left").select("source_id", text.work_key(F.coalesce("names", F.array().cast("array<string>")), F.concat("title", _suffix("source_id"))).alias("work_key"))


def _safe_sql(x: str, longest: int = 120) -> str:
    clean = f"trim(regexp_replace(regexp_replace({x}, '[\\x00-\\x1f<>:\"/\\\\|?*]+', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"coalesce(nullif(trim(substr(regexp_replace({clean}, '^[.\\s]+|[.\\s]+$', '', 'g'), 1, {longest})), ''), 'untitled')"


_NAMES = ("Bad/Name: \"with\" *chars*", "  ..hidden.. ", "?|<>", "a\tb  c", "trailing. ")


def _names_sql() -> str:
    return "CASE p_partkey % 5 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(_NAMES)) + " END"


def _name() -> F.Column:
    return F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("p_partkey") % 5 + 1).cast("int"))


@query(f"SELECT p_partkey AS source_id, {_safe_sql('n || CASE WHEN p_partkey % 3 = 0 THEN repeat(p_name, 20) ELSE chr(0) || p_brand END'.replace('chr(0) || ', ''))} AS safe FROM (SELECT *, {_names_sql()} AS n FROM part)", views=False)
def safe_file_name(v: Views) -> DataFrame:
    return v.table("part").select(F.col("p_partkey").alias("source_id"), text.safe_file_name(F.concat(_name(), F.when(F.col("p_partkey") % 3 == 0, F.repeat("p_name", 20)).otherwise(F.col("p_brand")))).alias("safe"))


@query(
    f"""SELECT p_partkey AS source_id, array_to_string(list_filter([{_safe_sql("coalesce(CASE WHEN p_size % 7 <> 0 THEN p_type END, 'Unknown Author')")}, CASE WHEN p_size % 3 = 0 THEN '' ELSE {_safe_sql('p_brand')} END,
    {_safe_sql("CASE WHEN p_size % 2 = 0 THEN p_size || ' - ' || p_name ELSE p_name END")}], lambda x: x <> ''), '/') AS folder FROM part""",
    views=False,
)
def target_folder(v: Views) -> DataFrame:
    size = F.col("p_size")
    folder = text.target_folder(F.when(size % 7 != 0, F.col("p_type")), F.when(size % 3 == 0, "").otherwise(F.col("p_brand")), F.when(size % 2 == 0, size.cast("string")), F.col("p_name"))
    return v.table("part").select(F.col("p_partkey").alias("source_id"), folder.alias("folder"))


_PATH_SQL = "CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)?', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)?', 1) END"


@query(f"SELECT page_id, {_PATH_SQL} AS path, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages", views=False)
def url_path(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", urls.path_of(F.col("url")).alias("path"), urls.host_of(F.col("url")).alias("host"))


@query(
    """SELECT page_id, TRY_CAST(nullif(regexp_extract(u, '/([0-9]+)-([^/?#]*)\\.html$', 1), '') AS BIGINT) AS source_id, nullif(regexp_extract(u, '/([0-9]+)-([^/?#]*)\\.html$', 2), '') AS slug FROM
    (SELECT page_id, 'https://catalogue.example.org/' || CASE WHEN page_id % 3 = 0 THEN 'blog' ELSE page_id || '-t' || (page_id % 7) || '.html' END AS u FROM pages)""",
    views=False,
)
def book_url(v: Views) -> DataFrame:
    i = F.col("page_id").cast("string")
    href = F.when(F.col("page_id") % 3 == 0, "blog").otherwise(F.concat(i, F.lit("-t"), (F.col("page_id") % 7).cast("string"), F.lit(".html")))
    ref = urls.book_ref(urls.absolute(href, urls.BASE + "/"))
    return v.table("pages").select("page_id", ref["source_id"].alias("source_id"), ref["slug"].alias("slug"))


@query(
    """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE lower(replace(s_name, '#', ' no ')) END AS author, CASE WHEN s_suppkey % 4 = 3 THEN 'genre' || s_suppkey END AS category FROM supplier""",
    views=False,
)
def facet_key(v: Views) -> DataFrame:
    """Keys of author and category links, percent-encoded and decoded again."""
    name = F.replace("s_name", F.lit("#"), F.lit(" no "))
    href = F.when(F.col("s_suppkey") % 4 == 3, F.concat(F.lit("/Genre"), F.col("s_suppkey").cast("string"), F.lit("/"))).otherwise(urls.facet_url("author", name, (F.col("s_suppkey") % 2).cast("int"), ""))
    url = urls.absolute(href, urls.BASE)
    return v.table("supplier").select(F.col("s_suppkey").alias("id"), urls.facet_key(url, "author").alias("author"), urls.category_key(url).alias("category"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE nullif(CAST(l_quantity AS BIGINT) * 3600 * (CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END) + l_linenumber * 60 + l_suppkey % 60, 0) END AS seconds FROM lineitem", views=False)
def duration_seconds(v: Views) -> DataFrame:
    n = F.col("l_linenumber")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.when(n == 7, "nonsense").when(n % 2 == 0, F.concat_ws(":", two(F.col("l_quantity").cast("int")), two(n), two(F.col("l_suppkey") % 60))).otherwise(F.concat_ws(":", two(n), two(F.col("l_suppkey") % 60)))
    return v.table("lineitem").select("l_orderkey", "l_linenumber", text.duration_seconds(clock).alias("seconds"))


_HINTS = ("Перший рік", "Year Two", "Volume 3", "рік третій", "book #12", "no hint", "Дев'ята хвиля", "Years 5 - 7", "years two to four", "Vol. 9")
_HINT_SQL = "(SELECT p_partkey AS source_id, p_name || ' ' || CASE p_partkey % 10 " + " ".join(f"WHEN {k} THEN '{h.replace(chr(39), chr(39) * 2)}'" for k, h in enumerate(_HINTS)) + " END || ' x' AS t FROM part)"
_WORD_SQL = "CASE lower({x}) " + " ".join(f"WHEN '{w}' THEN {k + 1}" for k, w in enumerate(text.NUMBER_WORDS)) + " ELSE TRY_CAST({x} AS INTEGER) END"


def _hinted() -> F.Column:
    return F.concat(F.col("p_name"), F.lit(" "), F.element_at(F.array(*[F.lit(h) for h in _HINTS]), (F.col("p_partkey") % 10 + 1).cast("int")), F.lit(" x"))


@query(
    "SELECT source_id, CASE "
    + " ".join(f"WHEN regexp_matches(t, '(?i)(^|[^\\p{{L}}\\p{{N}}]){p.replace(chr(39), chr(39) * 2)}($|[^\\p{{L}}\\p{{N}}])') THEN {n}" for p, n in text.ORDINALS)
    + " ELSE "
    + _WORD_SQL.format(x=f"nullif(regexp_extract(t, '{text.VOLUME_HINT}', 1), '')")
    + f" END AS hint FROM {_HINT_SQL}",
    views=False,
)
def volume_hint(v: Views) -> DataFrame:
    return v.table("part").select(F.col("p_partkey").alias("source_id"), text.volume_hint(_hinted()).alias("hint"))


def _year_part(pattern: str, k: int) -> str:
    return _WORD_SQL.format(x=f"nullif(regexp_extract(t, '{pattern}', {k}), '')")


@query(
    f"""SELECT source_id, CASE WHEN b >= a THEN a ELSE c END AS from_year, CASE WHEN b >= a THEN b ELSE c END AS to_year FROM
    (SELECT source_id, {_year_part(text.YEARS, 1)} AS a, {_year_part(text.YEARS, 2)} AS b, {_year_part(text.YEAR, 1)} AS c FROM {_HINT_SQL})""",
    views=False,
)
def year_range(v: Views) -> DataFrame:
    found = text.year_range(_hinted())
    return v.table("part").select(F.col("p_partkey").alias("source_id"), found["from"].alias("from_year"), found["to"].alias("to_year"))


@query("SELECT p_partkey AS source_id, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN p_size WHEN 2 THEN p_size WHEN 3 THEN NULL ELSE nullif(p_size - 4, 0) END AS number FROM part", views=False)
def sequence_number(v: Views) -> DataFrame:
    s, n = F.col("p_size"), F.col("p_size").cast("string")
    value = F.when(s % 5 == 0, F.concat(F.lit("v"), n)).when(s % 5 == 1, F.concat(F.lit(" 0"), n)).when(s % 5 == 2, F.concat(n, F.lit(".5"))).when(s % 5 == 3, "0").otherwise((s - 4).cast("string"))
    return v.table("part").select(F.col("p_partkey").alias("source_id"), text.sequence_number(value).alias("number"))


@query(
    r"""SELECT doc_id, l > 0 AND n * 4 >= l * 3 AS latin FROM (SELECT doc_id, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS l, length(regexp_replace(t, '[^\p{Latin}]', '', 'g')) AS n FROM
    (SELECT doc_id, text AS t FROM documents))""",
    views=False,
)
def mostly_latin(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", text.mostly_latin(F.col("text")).alias("latin"))


@query("SELECT c_custkey, array_to_string(list_filter(list_transform(string_split_regex(c_name || ' ,  ' || c_mktsegment || ';& ' || c_nationkey, '[,&;]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS names FROM customer", views=False)
def split_names(v: Views) -> DataFrame:
    joined = F.concat("c_name", F.lit(" ,  "), "c_mktsegment", F.lit(";& "), F.col("c_nationkey").cast("string"))
    return v.table("customer").select("c_custkey", F.array_join(text.split_names(joined), "|").alias("names"))


_TITLES_SQL = "SELECT DISTINCT p_name AS t, replace(p_name, ' ', '') AS s FROM part"
_DICE = _dice_sql("a.s", "b.s")


@query(f"WITH n AS ({_TITLES_SQL}) SELECT a.t AS a, b.t AS b, round({_DICE}, 6) AS dice FROM n a JOIN n b ON a.t < b.t WHERE {_DICE} >= 0.5", views=False)
def dice_pairs(v: Views) -> DataFrame:
    """Titles that resemble each other."""
    found = matching.dice_pairs(v.table("part").select("p_name").distinct(), "p_name", "p_name", 0.5)
    return found.select("a", "b", F.round("dice", 6).alias("dice"))


def _matched_tables(v: Views) -> tuple[DataFrame, DataFrame]:
    """Library items and books with their authors, each computed once.

    Items are all parts, their words swapped, in capitals, some with an author and a tag.
    """
    # a name is listed once a book: joined with each of the authors who bear it, a book's list would grow with their number
    bears = v.table("supplier").select("s_suppkey", F.lower("s_name").alias("key")).join(v.authors.distinct(), "key").select("s_suppkey", "name")
    people = v.supplied.join(bears, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("source_id").agg(F.array_sort(F.collect_set("name")).alias("authors"))
    books = once(v.titles.join(people, "source_id", "left").select("source_id", "title", "detail_state", F.coalesce("authors", F.array().cast("array<string>")).alias("authors")))
    words, i, none = F.split("title", " "), F.col("source_id"), F.array().cast("array<string>")
    items = books.select(
        F.concat(F.lit("item"), i.cast("string")).alias("item_id"), F.upper(F.concat(words[1], F.lit(" "), words[0])).alias("title"), F.when(i % 40 == 0, F.slice("authors", 1, 1)).otherwise(none).alias("authors"),
        F.when(i % 100 == 0, F.array(F.lit("fiction"), F.concat(F.lit(" Shelf:"), (i + 1).cast("string")))).otherwise(F.array(F.lit("fiction"), F.lit("shelf:none"))).alias("tags"),
    )
    return once(items), books


_STRIP_NAME = "replace(replace(lower({x}), '#', '#'), ' ', '')"
_FUZZY_SQL = f"""
, people AS (SELECT source_id, list_sort(list(name)) AS names, min(name) AS author FROM book_authors JOIN authors ON author_key = key GROUP BY source_id
), items AS (
  SELECT 'item' || p_partkey AS item_id, p_partkey, upper(string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1]) AS title, CASE WHEN p_partkey % 40 = 0 THEN author END AS author FROM part LEFT JOIN people ON p_partkey = source_id
), ready AS (
  SELECT b.source_id, b.title, coalesce(p.names, []) AS names FROM books b LEFT JOIN people p ON p.source_id = b.source_id WHERE detail_state = 'ok'
), tokens AS (
  SELECT item_id, unnest(list_filter(string_split(lower(title), ' '), lambda t: length(t) >= 4)[1:4]) AS token FROM items
), by_title AS (
  SELECT token, source_id FROM (SELECT DISTINCT token, source_id, dense_rank() OVER (PARTITION BY token ORDER BY source_id) AS n FROM (SELECT DISTINCT token FROM tokens) JOIN ready ON contains(lower(ready.title), token)) WHERE n <= 80
), by_author AS (
  SELECT needle, source_id FROM (SELECT needle, source_id, row_number() OVER (PARTITION BY needle ORDER BY source_id) AS n FROM (SELECT DISTINCT needle, source_id FROM (SELECT DISTINCT lower(author) AS needle FROM items WHERE author IS NOT NULL) JOIN (SELECT source_id, unnest(names) AS name FROM ready) ON contains(lower(name), needle))) WHERE n <= 120
), pairs AS (
  SELECT item_id, source_id FROM tokens JOIN by_title USING (token) UNION SELECT item_id, source_id FROM items JOIN by_author ON lower(author) = needle
), compared AS (
  SELECT i.item_id, r.source_id, replace(lower(i.title), ' ', '') AS ta, replace(r.title, ' ', '') AS tb, replace(lower(i.author), ' ', '') AS aa, r.names FROM pairs JOIN items i ON i.item_id = pairs.item_id JOIN ready r ON r.source_id = pairs.source_id
), scored AS (
  SELECT item_id, source_id, CASE WHEN aa IS NULL OR len(names) = 0 THEN {_dice_sql('ta', 'tb')} ELSE {_dice_sql('ta', 'tb')} * 0.75 + list_max(list_transform(names, lambda n: {_dice_sql('aa', "replace(lower(n), ' ', '')")})) * 0.25 END AS score FROM compared
), best AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, source_id) AS place FROM scored
)
"""


@query(_FUZZY_SQL + "SELECT item_id, source_id, round(score, 6) AS score, place FROM best WHERE place <= 5")
def fuzzy_top5(v: Views) -> DataFrame:
    """The five best candidates of each library item."""
    items, books = _matched_tables(v)
    found = matching.best(items, books)
    return found.select("item_id", "source_id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


_ITEMS_SQL = _FUZZY_SQL[: _FUZZY_SQL.index("), tokens AS")]
_NEAREST_SQL = f"""{_ITEMS_SQL}
), t AS (
  SELECT a.t AS ta, b.t AS tb, {_dice_sql('a.t', 'b.t')} AS likeness FROM (SELECT DISTINCT replace(lower(title), ' ', '') AS t FROM items) a, (SELECT DISTINCT replace(title, ' ', '') AS t FROM ready) b
), n AS (
  SELECT a.t AS aa, b.t AS nn, {_dice_sql('a.t', 'b.t')} AS likeness FROM (SELECT DISTINCT {_STRIP_NAME.format(x='author')} AS t FROM items WHERE author IS NOT NULL) a, (SELECT DISTINCT {_STRIP_NAME.format(x='name')} AS t FROM (SELECT unnest(names) AS name FROM ready)) b
), named AS (
  SELECT aa, source_id, max(likeness) AS likeness FROM n JOIN (SELECT source_id, {_STRIP_NAME.format(x='name')} AS nn FROM (SELECT source_id, unnest(names) AS name FROM ready)) USING (nn) GROUP BY aa, source_id
), scored AS (
  SELECT item_id, r.source_id, CASE WHEN i.author IS NULL OR len(r.names) = 0 THEN t.likeness ELSE t.likeness * 0.75 + m.likeness * 0.25 END AS score
  FROM items i JOIN t ON ta = replace(lower(i.title), ' ', '') JOIN ready r ON tb = replace(r.title, ' ', '') LEFT JOIN named m ON aa = {_STRIP_NAME.format(x='i.author')} AND m.source_id = r.source_id
)
SELECT item_id, source_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, source_id) AS place FROM scored WHERE score >= 0.6
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, source_id) <= 5
"""


@query(_NEAREST_SQL)
def nearest_books(v: Views) -> DataFrame:
    """Each library item's five best of all fetched books, without candidate caps."""
    found = nearest.nearest(*_matched_tables(v))
    return found.select("item_id", "source_id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


_CASCADE_SQL = """
, known AS (SELECT 'item' || p_partkey AS item_id, p_partkey AS link_id, p_retailprice AS confidence FROM part WHERE p_partkey % 60 = 0
), tagged AS (SELECT item_id, p_partkey + 1 AS tag_id FROM items WHERE p_partkey % 100 = 0 AND p_partkey + 1 IN (SELECT source_id FROM books))
SELECT i.item_id, coalesce(link_id, tag_id, CASE WHEN b.score >= 0.86 THEN b.source_id END) AS source_id, round(CASE WHEN link_id IS NOT NULL THEN confidence WHEN tag_id IS NOT NULL THEN 1.0 ELSE coalesce(b.score, 0.0) END, 6) AS score,
       CASE WHEN link_id IS NOT NULL THEN 'existing-link' WHEN tag_id IS NOT NULL THEN 'tag' WHEN b.score >= 0.86 THEN 'fuzzy' ELSE 'none' END AS via
FROM items i LEFT JOIN known k ON k.item_id = i.item_id LEFT JOIN tagged t ON t.item_id = i.item_id LEFT JOIN best b ON b.item_id = i.item_id AND b.place = 1
"""


@query(_FUZZY_SQL + _CASCADE_SQL)
def match_cascade(v: Views) -> DataFrame:
    """Which book each library item is, and how that was found."""
    links = v.table("part").filter("p_partkey % 60 = 0").select(F.concat(F.lit("item"), F.col("p_partkey").cast("string")).alias("item_id"), F.col("p_partkey").alias("source_id"), F.col("p_retailprice").alias("confidence"))
    items, books = _matched_tables(v)
    return matching.cascade(items, links, books, "shelf").withColumn("score", F.round("score", 6))


@query(
    f"""SELECT s_suppkey AS id, round(greatest({_dice_sql("replace(lower(s_name), ' ', '')", "replace(lower(n_name), '_', '')")}, {_dice_sql("replace(lower(s_name), ' ', '')", "replace(lower(replace(s_name, '0', '')), ' ', '')")}), 6) AS score
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    views=False,
)
def author_cross_similarity(v: Views) -> DataFrame:
    left = v.table("supplier").select(F.col("s_suppkey").alias("id"), F.array(text.normalise_name(F.col("s_name"))).alias("authors"))
    other = v.table("supplier").join(v.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.array(text.normalise_name(F.col("n_name")), text.normalise_name(F.replace("s_name", F.lit("0"), F.lit("")))).alias("other_authors"))
    return matching.author_similarity(left, other).withColumn("score", F.round("score", 6))


_MAPPINGS = (("/en", "/mnt/english"), ("/fr/", "\\mnt\\french\\"), ("/en/1", "/never"), ("", "/root"), ("/de", "/mnt/german"), ("/en/12", "/dozen"))


@query(
    f"""WITH p AS (SELECT page_id AS id, path, regexp_replace(path, '/+$', '') AS norm FROM (SELECT page_id, {_PATH_SQL} AS path FROM pages)), m(prefix, new) AS (VALUES ('/en', '/mnt/english'), ('/fr', '/mnt/french'), ('/en/1', '/never'), ('/de', '/mnt/german'), ('/en/12', '/dozen')),
    h AS (SELECT id, arg_max(new || substr(norm, length(prefix) + 1), length(prefix)) AS mapped FROM p JOIN m ON norm = prefix OR starts_with(norm, prefix || '/') GROUP BY id)
    SELECT p.id, p.path, coalesce(h.mapped, p.norm) AS mapped FROM p LEFT JOIN h ON p.id = h.id""",
    views=False,
)
def path_longest_prefix(v: Views) -> DataFrame:
    rules = v.spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(_MAPPINGS)], "pos int, from string, to string")
    return matching.map_paths(v.table("pages").select(F.col("page_id").alias("id"), urls.path_of(F.col("url")).alias("path")), rules)


@query("SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages", views=False)
def page_titles(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query("SELECT page_id, array_to_string(list_distinct_kept, ' ') AS links FROM (SELECT page_id, list_filter(x, lambda h, i: list_position(x, h) = i) AS list_distinct_kept FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS x FROM pages))", views=False)
def page_links(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", F.array_join(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)), " ").alias("links"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '<a href=')) AS n_links, CAST(sum(len(regexp_extract_all(html, '<a href='))) OVER () AS BIGINT) AS all_links FROM pages", views=False)
def page_anchor_counts(v: Views) -> DataFrame:
    """Anchors as the HTML parser sees them, against a pattern."""
    found = v.table("pages").select("page_id", F.size(pages.links_of(F.col("html"))).cast("long").alias("n_links"))
    return found.crossJoin(F.broadcast(found.agg(F.sum("n_links").alias("all_links"))))


_BLOCK_SQL = r"(?i)</?(?:p|div|br|h[1-6]|li|tr|blockquote|section)\b[^>]*>"
_PAGE_SQL = rf"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<!doctype[^>]*>', '', 'g'), '{_BLOCK_SQL}', chr(10), 'g'), '<[/a-zA-Z][^>]*>', '', 'g')"
for _entity, _letter in (("&nbsp;", "\xa0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _PAGE_SQL = f"replace({_PAGE_SQL}, '{_entity}', '{_letter}')"


@query(rf"SELECT page_id, CAST(len(x) AS INTEGER) AS n_lines, md5(array_to_string(x, chr(10))) AS digest FROM (SELECT page_id, list_filter(list_transform(string_split(replace({_PAGE_SQL}, chr(160), ' '), chr(10)), lambda l: trim(regexp_replace(l, '[ \t]+', ' ', 'g'), E' \t\r\n')), lambda l: l <> '') AS x FROM pages)", views=False)
def page_text(v: Views) -> DataFrame:
    """The text of a page: how many lines it has, and what they are; empty ones aside."""
    lines = F.filter(F.split(pages.html_to_text(F.col("html")), "\n"), lambda line: line != "")
    return v.table("pages").select("page_id", lines.alias("x")).select("page_id", F.size("x").alias("n_lines"), F.md5(F.array_join("x", "\n").cast("binary")).alias("digest"))


def _book_page(v: Views) -> DataFrame:
    """Synthetic book pages with the markers that the parser reads."""
    tasks = int(v.spark.conf.get("spark.sql.shuffle.partitions"))
    # rows are small here and pages large, so adaptive execution would leave them to few tasks
    people = v.books.select("source_id", "title", "series_key", "series_name", "size", "rating", "votes").repartition(tasks, "source_id")
    i, name = F.col("source_id").cast("string"), F.initcap("title")
    esc = lambda s: F.lit(s)
    html = F.concat(
        esc('<!doctype html><html><head><meta property="og:site_name" content="Shelf"><meta property="og:title" content="'), name, esc(' - Shelf"><meta itemprop="duration" content="'), F.lpad((F.col("size") % 20).cast("string"), 2, "0"), esc(':10:05"><link rel="canonical" href="/'), i, esc("-"), F.replace("title", F.lit(" "), F.lit("-")),
        esc('.html"></head><body><ul class="pmovie__list"><li><span>Автор:</span> <span itemprop="author"><a href="/xfsearch/avtor/'), F.replace("series_key", F.lit("#"), F.lit("%23")), esc('/">'), F.col("series_name"), esc('</a></span><li><span>Жанр:</span> <a href="/fantasy/">Fantasy</a></ul><div class="pmovie__rating-score">'),
        F.replace(F.format_string("%.1f", F.col("size") / 10.0), F.lit("."), F.lit(",")), esc('</div><span data-vote-num-id="1">'), F.coalesce(F.col("votes"), F.lit(0)).cast("string"), esc('</span><div itemprop="description"><p>About&nbsp;'), name, esc("<br>More.</p><h2>Series</h2><a href=\"/"), (F.col("source_id") + 1).cast("string"), esc('-next.html">next</a></div></body></html>'),
    )
    return people.select(F.col("source_id").alias("page_id"), F.concat(F.lit(urls.BASE + "/"), i, F.lit("-x.html")).alias("url"), html.alias("html"))


@query(
    """SELECT source_id, replace(title, ' ', '-') AS slug, upper(title[1]) || split_part(substr(title, 2), ' ', 1) || ' ' || upper(split_part(title, ' ', 2)[1]) || substr(split_part(title, ' ', 2), 2) AS title, CAST((size % 20) * 3600 + 605 AS INTEGER) AS duration_sec, round(size / 10.0, 1)::DOUBLE AS rating,
    CAST(coalesce(votes, 0) AS INTEGER) AS votes, series_key AS authors, 'fantasy' AS genres, CAST(source_id + 1 AS VARCHAR) AS related, 'About ' || upper(title[1]) || split_part(substr(title, 2), ' ', 1) || ' ' || upper(split_part(title, ' ', 2)[1]) || substr(split_part(title, ' ', 2), 2) || chr(10) || chr(10) || 'More.' AS description FROM books"""
)
def page_parse_books(v: Views) -> DataFrame:
    """Book pages through the parser and back to the columns they were made of."""
    got = pages.parse_books(_book_page(v), urls.BASE)
    keys = lambda c: F.array_join(F.transform(c, lambda x: x["key"]), ",").alias(c)
    return got.select("source_id", "slug", "title", "duration_sec", "rating", "votes", keys("authors"), keys("genres"), F.array_join(F.transform("related_ids", lambda x: x.cast("string")), ",").alias("related"), "description")


def _listing_pages(v: Views) -> DataFrame:
    b = v.books.withColumn("page_id", F.floor(F.col("source_id") / 20))
    i = F.col("source_id").cast("string")
    card = F.concat(F.lit('<div class="poster item"><a class="poster__link" href="/'), i, F.lit('-s.html"></a><div class="poster__title"> '), F.col("title"), F.lit('</div><div class="js-duration" data-time="1:02:'), F.lpad((F.col("size") % 60).cast("string"), 2, "0"), F.lit('"></div><div class="poster__ratings">Рейтинг 4,'), (F.col("size") % 10).cast("string"), F.lit(" (18 голосів)</div></div>"))
    grids = b.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_id", card.alias("card")))), lambda x: x["card"]), "").alias("cards"))
    pager = F.concat(F.lit('<div class="pagination"><span>'), (F.col("page_id") + 1).cast("string"), F.lit('</span><a href="/page/'), (F.col("page_id") % 7).cast("string"), F.lit('/">x</a></div>'))
    return grids.select("page_id", F.concat(F.lit('<div class="grid-items">'), "cards", F.lit("</div>"), pager).alias("html"))


@query("SELECT CAST(source_id // 20 AS BIGINT) AS page_id, source_id, title, CAST(3720 + size % 60 AS INTEGER) AS duration_sec, round(4 + (size % 10) / 10.0, 1)::DOUBLE AS rating, CAST(greatest(1, source_id // 20 + 1, (source_id // 20) % 7) AS INTEGER) AS last_page FROM books")
def listing_cards(v: Views) -> DataFrame:
    return pages.parse_listings(_listing_pages(v), urls.BASE).select("page_id", "source_id", "title", "duration_sec", "rating", "last_page")


@query("SELECT CAST(source_id // 20 AS BIGINT) AS page_id, source_id, title, CAST(3720 + size % 60 AS INTEGER) AS duration_sec, round(4 + (size % 10) / 10.0, 1)::DOUBLE AS rating, CAST(greatest(1, source_id // 20 + 1, (source_id // 20) % 7) AS INTEGER) AS last_page FROM books")
def cards_passing(v: Views) -> DataFrame:
    """Listing cards by a table function that never holds a page's rows together."""
    return passing.listings(_listing_pages(v), urls.BASE).select("page_id", "source_id", "title", "duration_sec", "rating", "last_page")


@query("""WITH found AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>', 1)) AS href FROM pages WHERE html IS NOT NULL) SELECT page_id, count(*) AS links, count(DISTINCT href) AS targets FROM found GROUP BY 1""", views=False)
def links_passing(v: Views) -> DataFrame:
    """Links of raw pages and how many different targets they have, by a table function in SQL."""
    passing.register(v.spark)
    return v.spark.sql("SELECT CAST(page_id AS BIGINT) AS page_id, count(href) AS links, count(DISTINCT href) AS targets FROM page_links(TABLE(SELECT page_id, html FROM {pages})) WHERE href IS NOT NULL GROUP BY page_id", pages=v.table("pages"))


@query("SELECT CAST(source_id // 20 AS BIGINT) AS page_id, max(greatest(1, source_id // 20 + 1, (source_id // 20) % 7))::INTEGER AS last_page FROM books GROUP BY 1")
def listing_last_page(v: Views) -> DataFrame:
    return pages.parse_listings(_listing_pages(v), urls.BASE).groupBy("page_id").agg(F.max("last_page").alias("last_page"))


@query("SELECT CAST(s_nationkey AS BIGINT) AS page_id, lower(s_name) AS key, s_name AS name, max(CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey END)::INTEGER AS book_count FROM supplier GROUP BY 1, 2, 3", views=False)
def index_entries(v: Views) -> DataFrame:
    """Index links, each once without and once with a count."""
    s = v.table("supplier")
    href = F.concat(F.lit("/xfsearch/avtor/"), F.replace("s_name", F.lit("#"), F.lit("%23")), F.lit("/"))
    rows = s.select(F.col("s_nationkey").cast("long").alias("page_id"), href.alias("href"), F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.col("s_name").alias("label")), F.struct(F.lit(1).alias("pos"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(F.concat("s_name", F.lit("  - "), F.col("s_suppkey").cast("string"), F.lit(" книг"))).alias("label")))).alias("x"))
    return pages.index_entries(rows.select("page_id", "href", "x.pos", "x.label"), "author", urls.BASE)


def _playlists(v: Views) -> DataFrame:
    """A playlist per conversation: a title line before every other turn, some empty, some replaced."""
    t = F.col("turn")
    info = F.when(t % 4 == 0, F.concat(F.lit("#EXTINF:-1, Turn "), t.cast("string"), F.lit("\n"))).when(t % 4 == 1, F.concat(F.lit("#EXTINF:-1,old\n#EXTINF:10,"), F.lit("\n"))).otherwise("")
    url = F.when(t % 3 == 0, F.concat(F.lit("https://cdn.example.org/"), F.col("conv_id").cast("string"), F.lit("/%C3%A9"), t.cast("string"), F.lit(".mp3?sig=1"))).when(t % 3 == 1, F.concat(F.lit("files/"), t.cast("string"), F.lit(".ogg"))).when(t % 6 == 5, "https://cdn.example.org/a%ZZ.mp3").otherwise("<b>no</b>")
    body = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(info, url).alias("s")))), lambda x: x["s"])
    return v.table("conversations").groupBy("conv_id").agg(F.concat(F.lit("#EXTM3U\r\n"), F.array_join(body, "\n")).alias("body")).select(F.col("conv_id").alias("playlist_id"), "body", F.lit("https://list.example.org/a/b.m3u").alias("base"))


_TRACKS_SQL = """WITH x AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'https://cdn.example.org/' || conv_id || '/%C3%A9' || turn || '.mp3?sig=1' WHEN 1 THEN 'https://list.example.org/a/files/' || turn || '.ogg' END AS url,
  CASE turn % 4 WHEN 0 THEN 'Turn ' || turn WHEN 1 THEN '' END AS info FROM conversations),
  g AS (SELECT *, count(url) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grp FROM x),
  c AS (SELECT *, last_value(info IGNORE NULLS) OVER (PARTITION BY conv_id, grp ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS named FROM g),
  tracks AS (SELECT conv_id AS playlist_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, url, nullif(named, '') AS title, turn FROM c WHERE url IS NOT NULL)
"""


@query(_TRACKS_SQL + "SELECT playlist_id, pos, url, title FROM tracks", views=False)
def m3u_parse(v: Views) -> DataFrame:
    return playlist.tracks(_playlists(v), base_col="base")


@query(_TRACKS_SQL + "SELECT playlist_id, pos, lpad(CAST(pos + 1 AS VARCHAR), 4, '0') || '-' || CASE turn % 3 WHEN 0 THEN 'é' || turn || '.mp3' ELSE turn || '.ogg' END AS file, CASE turn % 3 WHEN 0 THEN playlist_id || '/é' || turn || '.mp3' ELSE 'a/files/' || turn || '.ogg' END AS name FROM tracks", views=False)
def track_names(v: Views) -> DataFrame:
    t = playlist.tracks(_playlists(v), base_col="base")
    return t.select("playlist_id", "pos", playlist.track_file(F.col("pos"), F.col("url"), F.col("title")).alias("file"), playlist.track_path(F.col("url")).alias("name"))


@query("SELECT conv_id AS playlist_id, count(*) FILTER (WHERE length(text) >= 300) AS downloaded, count(*) AS total, bool_and(length(text) >= 300) AS complete FROM conversations GROUP BY conv_id", views=False)
def audio_status(v: Views) -> DataFrame:
    c = v.table("conversations").select(F.col("conv_id").alias("playlist_id"), F.col("turn").cast("string").alias("file"), F.length("text").alias("length"))
    return playlist.audio_status(c.select("playlist_id", "file"), c, "playlist_id", 300)


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '#EXTM3U ' || turn WHEN 1 THEN '#EXTM3U' || turn WHEN 2 THEN '' ELSE 'https://x.example.org/' || turn END AS body FROM conversations", views=False)
def playlist_bodies(v: Views) -> DataFrame:
    t = F.col("turn").cast("string")
    k = F.col("turn") % 4
    raw = F.when(k == 0, F.concat(F.lit("<html><PRE class=a> #EXTM3U "), t, F.lit("\n</pre></html>"))).when(k == 1, F.concat(F.lit("junk #EXTM3U"), t)).when(k == 2, F.concat(F.lit(" <!DOCTYPE html>"), t)).otherwise(F.concat(F.lit("\nhttps://x.example.org/"), t))
    return v.table("conversations").select("conv_id", "turn", playlist.playlist_body(raw).alias("body"))


@query(
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://catalogue.example.org/m33u2/' || page_id || '-b.m3u' WHEN 1 THEN 'https://catalogue.example.org/m33u2/' || page_id || '-other.m3u' WHEN 2 THEN 'https://cdn.example.org/m33u2/' || page_id || '-a.m3u?x=1' END AS url FROM pages""",
    views=False,
)
def playlist_links(v: Views) -> DataFrame:
    """The playlist of a page: by key, by id, or none of the page's own."""
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    html = F.when(k == 0, F.concat(F.lit("<script>new Playerjs({id:1, file:\"/m33u2/7-x.m3u\"});Playerjs({file:'/m33u2/"), i, F.lit("-b.m3u'})</script>"))).when(k == 1, F.concat(F.lit('<a data="/m33u2/'), i, F.lit('-other.m3u">'))).when(k == 2, F.concat(F.lit('"https://cdn.example.org/m33u2/'), i, F.lit('-a.m3u?x=1" "/m33u2/1-z.m3u"'))).otherwise(F.lit(" m33u2/0-q.m3u "))
    key = F.concat(i, F.when(k == 2, "-a").otherwise("-b"))
    return v.table("pages").select("page_id", playlist.playlist_url(html, urls.BASE + "/", key).alias("url"))


def _generations(v: Views) -> DataFrame:
    """Three sidecars per part: wanted, in the library, and written last."""
    i, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size")
    null, none = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    tag = F.concat(F.lit("shelf:"), i.cast("string"))

    def card(**values) -> F.Column:
        return F.struct(*[values.get(f, none if f in sidecar.LISTS else null).alias(f) for f in sidecar.FIELDS])

    wanted = card(title=name, language=F.when(size % 2 == 0, "ukr"), description=F.when(size % 3 == 0, F.concat(F.lit("about "), name)), genres=F.when(size % 4 != 0, F.array(F.lower("p_type"), F.lit("audio"))), tags=F.array(F.lit("a"), tag))
    have = card(title=F.when(size % 3 == 0, name).when(size % 3 == 1, F.upper(name)), language=F.when(size % 5 == 0, " ukr ").when(size % 5 == 1, "eng"), description=F.when(size % 6 == 0, "edited").when(size % 6 == 3, "  "), genres=F.when(size % 3 != 0, F.array(F.lit("audio"), F.lower("p_type"))), tags=F.when(size % 2 == 0, F.array(F.lit("b"), F.lit("a"))))
    last = card(title=F.when(size % 2 == 0, F.upper(name)), language=F.when(size % 5 < 3, "eng"), description=F.when(size % 4 == 0, "was"), tags=F.when(size % 4 == 0, F.array(F.lit("a"), F.lit("b"))))
    return v.table("part").select(i.alias("source_id"), wanted.alias("desired"), have.alias("current"), last.alias("previous"))


_GENERATIONS_SQL = """WITH g AS (SELECT p_partkey AS source_id, p_name AS w_title, CASE WHEN p_size % 2 = 0 THEN 'ukr' END AS w_lang, CASE WHEN p_size % 3 = 0 THEN 'about ' || p_name END AS w_desc, CASE WHEN p_size % 4 <> 0 THEN [lower(p_type), 'audio'] END AS w_genres, ['a', 'shelf:' || p_partkey] AS w_tags,
  CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) END AS h_title, CASE p_size % 5 WHEN 0 THEN ' ukr ' WHEN 1 THEN 'eng' END AS h_lang, CASE p_size % 6 WHEN 0 THEN 'edited' WHEN 3 THEN '  ' END AS h_desc, CASE WHEN p_size % 3 <> 0 THEN ['audio', lower(p_type)] END AS h_genres, CASE WHEN p_size % 2 = 0 THEN ['b', 'a'] END AS h_tags,
  CASE WHEN p_size % 2 = 0 THEN upper(p_name) END AS o_title, CASE WHEN p_size % 5 < 3 THEN 'eng' END AS o_lang, CASE WHEN p_size % 4 = 0 THEN 'was' END AS o_desc, CAST(NULL AS VARCHAR[]) AS o_genres, CASE WHEN p_size % 4 = 0 THEN ['a', 'b'] END AS o_tags FROM part)
"""


def _reconcile_sql(policy: str) -> str:
    out, changed, skipped = {}, [], []
    for f, is_list in (("title", False), ("genres", True), ("tags", True), ("desc", False), ("lang", False)):
        w, h, o = f"w_{f}", f"h_{f}", f"o_{f}"
        empty = (lambda x: f"({x} IS NULL OR len({x}) = 0)") if is_list else (lambda x: f"coalesce(trim({x}), '') = ''")
        key = (lambda x: f"list_sort({x})") if is_list else (lambda x: f"trim({x})")
        same = lambda a, b, k=key: f"({k(a)} IS NOT DISTINCT FROM {k(b)})"
        write = {"overwrite-all": "true", "fill-empty": empty(h), "overwrite-ours": f"({empty(h)} OR {o} IS NULL OR {same(h, o)})"}[policy]
        value = f"CASE WHEN {empty(w)} THEN CASE WHEN {empty(h)} THEN NULL ELSE {h} END WHEN {write} THEN {w} ELSE {h} END"
        moved = f"(NOT {empty(w)} AND {write} AND NOT {same(h, w)})"
        skipped.append(f"CASE WHEN NOT {empty(w)} AND NOT {write} THEN '{f}' END")
        if f == "tags":
            union = f"list_concat(coalesce({value}, []), list_filter({w}, lambda x: NOT list_contains(coalesce({value}, []), x)))"
            moved = f"({moved} OR (NOT {same(f'({value})', union)} AND NOT {same(h, union)}))"
            value = union
        out[f] = f"coalesce(array_to_string({value}, '+'), '')" if is_list else f"coalesce({value}, '-')"
        changed.append(f"CASE WHEN {moved} THEN '{f}' END")
    names = lambda xs: f"array_to_string(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL), ',')"
    return _GENERATIONS_SQL + f"SELECT source_id, {', '.join(f'{e} AS {f}' for f, e in out.items())}, {names(changed)} AS changed, {names(skipped)} AS skipped FROM g"


def _reconcile(policy: str, name: str) -> None:
    def f(v: Views) -> DataFrame:
        done = sidecar.reconcile(_generations(v), policy)
        p = lambda n: F.col(f"payload.{n}")
        short = {"description": "desc", "language": "lang"}
        names = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(*[F.when(x == a, b) for a, b in short.items()], x)), ",")
        lists = lambda n: F.coalesce(F.array_join(p(n), "+"), F.lit(""))
        return done.select("source_id", F.coalesce(p("title"), F.lit("-")).alias("title"), lists("genres").alias("genres"), lists("tags").alias("tags"), F.coalesce(p("description"), F.lit("-")).alias("desc"), F.coalesce(p("language"), F.lit("-")).alias("lang"), names("changed_fields").alias("changed"), names("skipped_fields").alias("skipped"))

    f.__name__ = name
    query(_reconcile_sql(policy), views=False)(f)


for _policy, _short in (("fill-empty", "reconcile_fill_empty"), ("overwrite-ours", "reconcile_ours"), ("overwrite-all", "reconcile_all")):
    _reconcile(_policy, _short)


@query(
    """SELECT p_partkey AS source_id, md5('{' || CASE WHEN p_size % 4 <> 0 THEN '"genres":["audio","' || lower(p_type) || '"],' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN '"language":"ukr",' ELSE '' END || '"tags":["a","shelf:' || p_partkey || '"],"title":"' || p_name || '"}') AS digest FROM part""",
    views=False,
)
def sidecar_hash(v: Views) -> DataFrame:
    return _generations(v).select("source_id", sidecar.digest(F.col("desired").withField("description", F.lit(None).cast("string"))).alias("digest"))


@query("SELECT source_id, CASE WHEN size % 3 = 0 THEN series_name || ' #' || size ELSE series_name END AS series, '[\"shelfmark:' || source_id || '\"]' AS tags FROM books")
def sidecar_build(v: Views) -> DataFrame:
    null, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    rows = v.books.withColumns({**{c: null for c in ("subtitle", "description", "published_year", "isbn", "asin")}, **{c: empty for c in ("authors", "narrators", "genres", "tags")}, "series_seq": F.when(F.col("size") % 3 == 0, F.concat(F.lit(" "), F.col("size").cast("string")))})
    made = rows.select("source_id", sidecar.build().alias("s"))
    return made.select("source_id", F.col("s.series")[0].alias("series"), F.to_json("s.tags").alias("tags"))


@query("SELECT 'item' || c_custkey AS item_id, 'T' || c_custkey AS title, CASE c_custkey % 3 WHEN 0 THEN c_name || '|' || c_mktsegment WHEN 1 THEN c_name ELSE c_name || '|X' END AS authors, CASE WHEN c_custkey % 2 = 0 THEN 'S' ELSE '' END AS series, CAST(CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey END AS INTEGER) AS num_audio_files FROM customer", views=False)
def library_items(v: Views) -> DataFrame:
    """Items of a library's JSON: authors as texts, as objects, or as one joined text."""
    i, k = F.col("c_custkey"), F.col("c_custkey") % 3
    authors = F.when(k == 0, F.concat(F.lit('"authors":["'), "c_name", F.lit('","","'), "c_mktsegment", F.lit('"],'))).when(k == 1, F.concat(F.lit('"authors":[{"id":"1","name":"'), "c_name", F.lit('"},{"id":"2"}],'))).otherwise(F.concat(F.lit('"authorName":"'), "c_name", F.lit(' , X;",')))
    series = F.when(i % 2 == 0, '"series":[{"name":"S","sequence":"2"}],').otherwise("")
    number = F.when(i % 4 != 0, F.concat(F.lit('"numAudioFiles":'), F.col("c_nationkey").cast("string"), F.lit(","))).otherwise("")
    raw = F.concat(F.lit('{"id":"item'), i.cast("string"), F.lit('","media":{'), number, F.lit('"metadata":{'), authors, series, F.lit('"title":"T'), i.cast("string"), F.lit('"}}}'))
    got = library.items(v.table("customer").select(raw.alias("json")))
    return got.select("item_id", "title", F.array_join("authors", "|").alias("authors"), F.array_join("series", "|").alias("series"), "num_audio_files")


@query("SELECT event_type, count(*) AS requests, count(*) FILTER (WHERE event_type NOT IN ('error', 'signup')) AS successes, count(*) FILTER (WHERE event_type = 'error') AS challenges, count(*) FILTER (WHERE event_type = 'signup') AS failures, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS total_ms, max(CAST(floor(value * 100) AS BIGINT)) AS max_ms FROM events GROUP BY event_type", views=False)
def fetch_stats(v: Views) -> DataFrame:
    return telemetry.fetch_stats(v.fetch_log, ["event_type"])


@query("SELECT event_id AS id, event_type FROM events ORDER BY event_id DESC LIMIT 5000", views=False)
def log_retention(v: Views) -> DataFrame:
    from ..operators.merge import keep_newest

    return keep_newest(v.fetch_log.select("id", "event_type"), 5000)


@query(
    """WITH RECURSIVE e AS (SELECT user_id AS origin, event_type, epoch_ms(ts) AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
    ), s AS (
      SELECT DISTINCT origin, CAST(0 AS BIGINT) AS n, CAST(5000 AS BIGINT) AS interval_ms, CAST(0 AS BIGINT) AS in_row, CAST(NULL AS BIGINT) AS cooldown_until, CAST(0 AS BIGINT) AS challenges FROM e
      UNION ALL
      SELECT s.origin, e.n,
        CASE WHEN event_type = 'error' THEN least(120000, greatest(1000, interval_ms * 2)) WHEN event_type = 'signup' THEN least(120000, CAST(floor(interval_ms * 1.5 + 0.5) AS BIGINT)) WHEN interval_ms > 5000 THEN greatest(5000, CAST(floor(interval_ms * 0.8 + 0.5) AS BIGINT)) ELSE interval_ms END,
        CASE WHEN event_type = 'error' THEN (CASE WHEN at_ms >= cooldown_until THEN 0 ELSE in_row END) + 1 WHEN event_type = 'signup' THEN CASE WHEN at_ms >= cooldown_until THEN 0 ELSE in_row END ELSE 0 END,
        CASE WHEN event_type = 'error' AND (CASE WHEN at_ms >= cooldown_until THEN 0 ELSE in_row END) + 1 >= 3 THEN at_ms + 600000 WHEN event_type NOT IN ('error', 'signup') OR at_ms >= cooldown_until THEN NULL ELSE cooldown_until END,
        challenges + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END
      FROM s JOIN e ON e.origin = s.origin AND e.n = s.n + 1
    )
    SELECT origin, interval_ms, in_row, cooldown_until, n AS requests, challenges FROM s QUALIFY n = max(n) OVER (PARTITION BY origin)""",
    views=False,
)
def limiter_fold(v: Views) -> DataFrame:
    """The adaptive limiter's state for each origin after all of its events: in order of their microseconds, at the nearest milliseconds."""
    us = F.unix_micros(F.col("at").cast("timestamp"))
    log = v.fetch_log.select("origin", "id", "kind", us.alias("at_us"), F.expr("round(unix_micros(cast(at as timestamp)), -3) div 1000").alias("at_ms"))
    return telemetry.limiter_fold(log, "origin", "at_us")


@query(
    """WITH a AS (SELECT user_id AS origin, event_id, event_type NOT IN ('error', 'signup') AS ok FROM events), f AS (
      SELECT *, coalesce(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER b, 0) AS bad, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER b, 0) AS good FROM a WINDOW b AS (PARTITION BY origin ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT origin, count(*) AS attempted, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS failed, bool_or(bad + CASE WHEN ok THEN 0 ELSE 1 END >= 3 AND good + CASE WHEN ok THEN 1 ELSE 0 END = 0) AS stopped_early FROM f WHERE NOT (bad >= 3 AND good = 0) GROUP BY origin""",
    views=False,
)
def early_stop(v: Views) -> DataFrame:
    return telemetry.early_stop(v.fetch_log.select("origin", "id", "ok"), "origin", "id")


@query(
    """WITH l AS (SELECT event_type AS job, max(ts) AS ran_at FROM events WHERE event_type <> 'view' GROUP BY event_type), j(job, every_minutes) AS (VALUES ('signup', 60), ('error', 0), ('click', 100000), ('view', 10), ('purchase', 1))
    SELECT j.job, CAST(floor((epoch_ms(TIMESTAMP '2024-03-01 00:00:00') - epoch_ms(ran_at)) / 60000.0) AS BIGINT) AS minutes_since, every_minutes > 0 AND (ran_at IS NULL OR floor((epoch_ms(TIMESTAMP '2024-03-01 00:00:00') - epoch_ms(ran_at)) / 60000.0) >= every_minutes) AS due FROM j LEFT JOIN l ON j.job = l.job""",
    views=False,
)
def due_jobs(v: Views) -> DataFrame:
    jobs = v.spark.createDataFrame([("signup", 60), ("error", 0), ("click", 100000), ("view", 10), ("purchase", 1)], "job string, every_minutes int")
    last = v.fetch_log.filter("event_type <> 'view'").groupBy(F.col("event_type").alias("job")).agg(F.max(F.col("at").cast("timestamp")).alias("ran_at"))
    return telemetry.due_jobs(jobs, last, F.lit("2024-03-01 00:00:00").cast("timestamp"))


@query("WITH l AS (SELECT doc_id, list_transform(string_split(replace(text, '. ', chr(10) || chr(10) || ' ' || chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))) AS x FROM documents) SELECT doc_id, md5(array_to_string(list_filter(x, lambda v, i: v <> '' OR i = 1 OR x[i - 1] <> ''), chr(10))) AS digest FROM l", views=False)
def blank_line_collapse(v: Views) -> DataFrame:
    spaced = F.replace("text", F.lit(". "), F.lit("\n\n \n"))
    return v.table("documents").select("doc_id", F.md5(pages.collapse_blank_lines(spaced).cast("binary")).alias("digest"))


@query("SELECT conv_id, turn, trim(array_to_string(list_filter(string_split(text || chr(10) || CASE turn % 3 WHEN 0 THEN 'Подякувати: Patreon' WHEN 1 THEN ' $5' ELSE 'end' END, chr(10)), lambda x: NOT regexp_matches(trim(x), '(?i)patreon|^\\$')), chr(10)), ' ' || chr(10)) AS text FROM conversations", views=False)
def strip_noise(v: Views) -> DataFrame:
    k = F.col("turn") % 3
    noise = F.when(k == 0, "Подякувати: Patreon").when(k == 1, " $5").otherwise("end")
    return v.table("conversations").select("conv_id", "turn", pages.strip_noise(F.concat("text", F.lit("\n"), noise)).alias("text"))


@query("SELECT c_custkey, CASE WHEN c_custkey < 1024 THEN c_custkey || ' B' ELSE printf('%.1f KiB', floor(c_custkey / 1024.0 * 10 + 0.5) / 10) END AS bytes, CASE WHEN c_custkey < 60 THEN greatest(1, c_custkey) || 's' WHEN c_custkey >= 3600 THEN (c_custkey // 3600) || 'h ' || (c_custkey % 3600 // 60) || 'm' ELSE (c_custkey // 60) || 'm ' || (c_custkey % 60) || 's' END AS length FROM customer", views=False)
def formatted(v: Views) -> DataFrame:
    i = F.col("c_custkey")
    return v.table("customer").select("c_custkey", text.format_bytes(i).alias("bytes"), text.format_duration(i).alias("length"))


@query("SELECT user_id AS origin, count(*) AS cookies, count(*) FILTER (WHERE event_id % 4 = 0 OR event_id % 4 = 1) AS live, count(*) FILTER (WHERE event_id % 3 <> 2) AS matching FROM events GROUP BY user_id", views=False)
def cookie_counts(v: Views) -> DataFrame:
    """Cookies of each origin that haven't expired, and that cover its host."""
    i = F.col("event_id")
    expires = F.when(i % 4 == 0, -1.0).when(i % 4 == 1, 2000.0).otherwise(500.0)
    domain = F.when(i % 3 == 0, ".Example.org").when(i % 3 == 1, "www.example.org").otherwise("ample.org")
    rows = v.table("events").select(F.col("user_id").alias("origin"), (~urls.cookie_expired(expires, F.lit(1000.0))).alias("live"), urls.host_in_domain(F.lit("www.example.org"), domain).alias("fits"))
    return rows.groupBy("origin").agg(F.count(F.lit(1)).alias("cookies"), F.count_if("live").alias("live"), F.count_if("fits").alias("matching"))


@query("SELECT user_id AS origin, event_id AS id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE event_type = 'error'", views=False)
def challenge_runs(v: Views) -> DataFrame:
    return v.fetch_log.filter("challenge").select("origin", "id", F.lag("event_type").over(Window.partitionBy("origin").orderBy("id")).alias("before"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '.png' WHEN page_id % 4 = 1 THEN '.webp' ELSE '.jpg' END AS extension FROM pages", views=False)
def cover_extensions(v: Views) -> DataFrame:
    k = F.col("page_id") % 4
    kind = F.when(k == 0, "image/png; charset=x").when(k == 1, "text/html")
    url = F.concat(F.lit("https://cdn.example.org/c"), F.col("page_id").cast("string"), F.when(k == 1, ".WEBP?x=.png").otherwise(".gif"))
    return v.table("pages").select("page_id", urls.cover_extension(kind, url).alias("extension"))


@query("SELECT o_orderkey AS source_id, array_to_string(list_filter([c_name, CASE WHEN o_orderkey % 2 = 0 THEN c_mktsegment ELSE '' END, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 7) || ' - ' ELSE '' END || 'T' || o_orderkey], lambda x: x <> ''), '/') AS folder FROM (SELECT * FROM orders WHERE o_orderstatus IN ('F', 'P') ORDER BY o_orderdate, o_orderkey LIMIT 50) JOIN customer ON o_custkey = c_custkey", views=False)
def prepared_folders(v: Views) -> DataFrame:
    """Where the oldest accepted entries of the queue are laid out."""
    from ..operators.queue import prepare_batch

    k = F.col("source_id")
    batch = prepare_batch(v.queue)
    books = batch.join(v.table("customer"), F.col("custkey") == F.col("c_custkey")).select("source_id", F.concat(F.lit("T"), k.cast("string")).alias("title"), F.array("c_name").alias("authors"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("series_name"), F.when(k % 3 == 0, (k % 7).cast("string")).alias("series_seq"))
    return sync.prepared(batch.select("source_id"), books)


@query("SELECT event_id AS id, CASE event_type WHEN 'error' THEN least(greatest(CAST(floor(value * 10000) AS BIGINT) + 1000, 5000), 900000) END AS retry_ms FROM events", views=False)
def retry_delays(v: Views) -> DataFrame:
    return v.table("events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", telemetry.retry_delay_ms(F.floor(F.col("value") * 10000).cast("long"))).alias("retry_ms"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN '#EXTM3U ' || s_name END AS body FROM supplier", views=False)
def har_playlists(v: Views) -> DataFrame:
    """The playlist among the responses of a HAR log, base64 or plain."""
    text = F.concat(F.lit("#EXTM3U "), "s_name")
    entry = F.concat(F.lit('{"request":{"url":"https://x/l.m3u"},"response":{"status":200,"content":{"encoding":"base64","text":"'), F.base64(text.cast("binary")), F.lit('"}}}'))
    other = F.lit('{"request":{"url":"https://x/p.html"},"response":{"status":200,"content":{"text":"<html>"}}}')
    har = F.concat(F.lit('{"log":{"entries":['), other, F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(","), entry)).otherwise(""), F.lit("]}}"))
    return v.table("supplier").select(F.col("s_suppkey").alias("id"), playlist.playlist_from_har(har).alias("body"))
