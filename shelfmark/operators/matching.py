"""Entity resolution of library items against the catalogue, and path mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import author_score, authors_side, closeness, leading_int, match_score, names_closeness, title_side, title_tokens
from ..staging import once
from .nearest import ROOM, TITLE_SHARE, kth_best, shape_of

THRESHOLD = 0.86
TITLE_CAP, AUTHOR_CAP, KEPT = 80, 120, 5


def dice_pairs(names: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """Pairs (a < b) of texts with a Dice coefficient of at least ``threshold`` (above 0), exact.

    Pairs come from shared bigrams. Lengths whose quotient can't reach the threshold are dropped in
    the join, and prefix filtering keeps the rarest bigrams of a text as join keys: two texts that
    reach the threshold share a bigram occurrence among them. Overlaps are counted afterwards.
    """
    flat = F.regexp_replace(F.col(text_col), r"(?U)\s+", "")
    rows = names.select(F.col(id_col).alias("id"), flat.alias("s")).filter("length(s) >= 2").withColumn("n", F.length("s") - 1)
    grams = rows.select("id", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.substr("s", i, F.lit(2)))).alias("g"))
    counted = grams.groupBy("id", "n", "g").agg(F.count(F.lit(1)).alias("c"))
    # the k-th occurrence of a bigram is an item of its own, so multisets become sets
    items = counted.select("id", "n", "g", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("k"))
    seldom = items.groupBy("g", "k").agg(F.count(F.lit(1)).alias("f"))
    order = Window.partitionBy("id").orderBy("f", "g", "k")
    # an overlap of o = t (na + nb) / 2 with nb >= na t / (2 - t) needs at least ceil(t na / (2 - t)) items
    need = F.ceil(F.col("n") * F.lit(threshold / (2 - threshold)) - F.lit(1e-9))
    prefix = items.join(seldom, ["g", "k"]).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= F.col("n") - need + 1).select("id", "n", "g", "k")
    a, b = prefix.alias("a"), prefix.alias("b")
    close = F.lit(2.0) * F.least("a.n", "b.n") >= F.lit(threshold - 1e-9) * (F.col("a.n") + F.col("b.n"))
    pairs = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.id") < F.col("b.id")) & close).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).distinct()
    left, right = counted.select(F.col("id").alias("a"), "g", F.col("c").alias("ca")), counted.select(F.col("id").alias("b"), "g", F.col("c").alias("cb"))
    shared = pairs.join(left, "a").join(right, ["b", "g"]).groupBy("a", "b", "na", "nb").agg(F.sum(F.least("ca", "cb")).alias("shared"))
    return shared.select("a", "b", (F.lit(2.0) * F.col("shared") / (F.col("na") + F.col("nb"))).alias("dice")).filter(F.col("dice") >= threshold)


def _pieces(text: Column, size: int) -> Column:
    """The pieces of a text of ``size`` characters, once each."""
    some = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(some)).otherwise(F.array().cast("array<string>"))


def containing(needles: DataFrame, texts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(``by``, needle, text) of distinct needles and texts of one kind (``by``) where the text contains the needle.

    One equi-join: a needle of four or more characters meets the texts that have the one of its four-letter
    pieces that fewest texts have, so a piece that all share (the same start of all names) joins nothing; a
    shorter needle meets those that have it as a piece. Empty needles lie in nothing.
    """
    held = texts.select(*by, "text", F.explode(F.concat(*[_pieces(F.col("text"), k) for k in (1, 2, 3, 4)])).alias("piece"))
    seldom = held.filter("length(piece) = 4").groupBy(*by, "piece").agg(F.count(F.lit(1)).alias("n"))
    cut = needles.filter("length(needle) >= 4").select(*by, "needle", F.explode(_pieces(F.col("needle"), 4)).alias("piece"))
    long = cut.join(seldom, [*by, "piece"]).groupBy(*by, "needle").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    keyed = long.unionByName(needles.filter("length(needle) between 1 and 3").select(*by, "needle", F.col("needle").alias("piece")))
    return keyed.join(held, [*by, "piece"]).filter(F.contains("text", "needle")).select(*by, "needle", "text")


def candidates(items: DataFrame, books: DataFrame, title_cap: int | None = TITLE_CAP, author_cap: int | None = AUTHOR_CAP) -> DataFrame:
    """(item_id, source_id): fetched books that share title words or authors with an item.

    Books whose title contains one of an item's first four words of four or more letters (80 a word)
    and books of its first two authors (120 an author); caps are by source_id, None lifts them. Items have item_id,
    title and authors; books source_id, title, authors and detail_state. Words and names are compared
    as distinct texts, not once a book or item, and both kinds in one join.
    """
    each = lambda values, kind, name: F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias(name)))
    listed = lambda df, key, name, title, people: df.select(key, F.explode(F.concat(each(title, "title", name), each(F.transform(people, F.lower), "author", name))).alias("x")).select(key, "x.*")
    wanted = listed(items, "item_id", "needle", title_tokens(F.col("title")), F.slice("authors", 1, 2))
    words = F.filter(F.array_distinct(F.split(F.lower("title"), r"[^\p{L}\p{N}]+")), lambda t: t != "")
    have = listed(books.filter(F.col("detail_state") == "ok"), "source_id", "text", words, F.col("authors"))
    holds = containing(wanted.select("kind", "needle").distinct(), have.select("kind", "text").distinct(), ("kind",))
    found = holds.join(have, ["kind", "text"]).select("kind", "needle", "source_id").distinct()
    caps = [(kind, cap) for kind, cap in (("title", title_cap), ("author", author_cap)) if cap is not None]
    if caps:
        most = F.coalesce(*[F.when(F.col("kind") == kind, F.lit(cap)) for kind, cap in caps], F.lit((1 << 31) - 1))
        found = found.withColumn("n", F.row_number().over(Window.partitionBy("kind", "needle").orderBy("source_id"))).filter(F.col("n") <= most)
    return wanted.join(found, ["kind", "needle"]).select("item_id", "source_id").distinct()


def scored(pairs: DataFrame, items: DataFrame, books: DataFrame, kept: int | None = None) -> DataFrame:
    """(item_id, source_id, score) of candidate pairs; each pair of titles is scored once, however many items and books bear them.

    With ``kept``, only pairs that can be among an item's ``kept`` best: those are left out that a perfect author wouldn't bring up to
    the kept-th best of what the titles alone ensure. A book may have many authors, so names join only pairs whose sides both have some; each distinct name is
    normalised once.
    """
    some = F.coalesce(F.size("authors") > 0, F.lit(False))
    i = items.select("item_id", F.col("title").alias("a"), some.alias("named"))
    b = books.select("source_id", F.col("title").alias("b"), some.alias("signed"))
    side = lambda df, name: df.select(name).distinct().select(name, title_side(F.col(name)).alias(f"{name}_side"))
    bare = pairs.join(i, "item_id").join(b, "source_id").select("item_id", "source_id", "a", "b", (F.col("named") & F.col("signed")).alias("both"))
    titles = bare.select("a", "b").distinct().join(side(i, "a"), "a").join(side(b, "b"), "b").select("a", "b", closeness(F.col("a_side"), F.col("b_side")).alias("titles"))
    titled = bare.join(titles, ["a", "b"], "left").select("item_id", "source_id", "titles", "both")
    if kept is not None:
        titled = once(titled)
        sure = titled.select("item_id", "source_id", F.when(F.col("both"), F.col("titles") * TITLE_SHARE).otherwise(F.col("titles")).alias("score"))
        most = F.when(F.col("both"), match_score(F.col("titles"), F.lit(1.0))).otherwise(F.col("titles"))
        titled = titled.join(kth_best(sure, "item_id", "source_id", kept), "item_id", "left").filter(F.col("bar").isNull() | (most >= F.col("bar") - ROOM)).drop("bar")

    def people(df: DataFrame, key: str, name: str) -> DataFrame:
        asked = titled.filter("both").select(key).distinct()
        flat = df.filter(some).join(asked, key, "left_semi").select(key, F.explode("authors").alias("author"))
        sides = flat.select("author").distinct().select("author", F.element_at(authors_side(F.array("author")), 1).alias("side"))
        return flat.join(sides, "author").groupBy(key).agg(F.collect_list("side").alias(name))

    # Comparing names takes long for few bytes: the pairs keep all of their partitions, which adaptive execution would put together.
    wide = titled.filter("both").repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_id")
    both = wide.join(people(books, "source_id", "b"), "source_id", "left").join(people(items, "item_id", "a"), "item_id", "left")
    named = both.select("item_id", "source_id", match_score(F.col("titles"), names_closeness(F.col("a"), F.col("b"))).alias("score"))
    return named.unionByName(titled.filter("both is distinct from true").select("item_id", "source_id", F.col("titles").alias("score")))


def best(items: DataFrame, books: DataFrame, kept: int = 5, title_cap: int | None = TITLE_CAP, author_cap: int | None = AUTHOR_CAP) -> DataFrame:
    """(item_id, source_id, score, place): the best of each item's candidates; items of one title and one list of authors are searched for once."""
    keyed = items.select("item_id", "title", "authors", shape_of(F.col("title"), F.col("authors")).alias("shape"))
    shapes = keyed.groupBy("shape").agg(F.first("title").alias("title"), F.first("authors").alias("authors")).withColumnRenamed("shape", "item_id")
    found = top(scored(candidates(shapes, books, title_cap, author_cap), shapes, books, kept), kept)
    return keyed.select("item_id", "shape").join(found.withColumnRenamed("item_id", "shape"), "shape").drop("shape")


def top(pairs: DataFrame, kept: int = KEPT) -> DataFrame:
    """The best candidates of each item, ranked; ties by source_id."""
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "source_id")
    return pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= kept)


def source_id_from_tags(tags: Column, prefix: str) -> Column:
    """The id in the first tag of the form prefix:<int>; null if there is none."""
    start = prefix.lower() + ":"
    found = F.transform(tags, lambda t: F.when(F.lower(F.trim(t)).startswith(start), leading_int(F.substr(F.lower(F.trim(t)), F.lit(len(start) + 1)))))
    return F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(1))


def cascade(items: DataFrame, links: DataFrame, books: DataFrame, prefix: str, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, source_id, score, via): a known link, else a tag, else the best fuzzy match, else none.

    Only items that neither way settles are compared.
    """
    known = books.select("source_id")
    linked = links.join(known, "source_id", "left_semi").select("item_id", F.col("source_id").alias("link_id"), F.coalesce("confidence", F.lit(1.0)).alias("link_score"))
    tagged = items.select("item_id", source_id_from_tags(F.col("tags"), prefix).alias("source_id")).filter("source_id is not null").join(known, "source_id", "left_semi").select("item_id", F.col("source_id").alias("tag_id"))
    exact = items.join(linked, "item_id", "left").join(tagged, "item_id", "left")
    open_items = exact.filter("link_id is null and tag_id is null").filter(F.coalesce("title", F.lit("")) != "").select("item_id", "title", "authors")
    fuzzy = best(open_items, books, 1).select("item_id", F.col("source_id").alias("fuzzy_id"), F.col("score").alias("fuzzy_score"))
    out = exact.join(fuzzy, "item_id", "left")
    good = F.coalesce(F.col("fuzzy_score") >= threshold, F.lit(False))
    via = F.when(F.col("link_id").isNotNull(), "existing-link").when(F.col("tag_id").isNotNull(), "tag").when(good, "fuzzy").otherwise("none")
    score = F.when(F.col("link_id").isNotNull(), F.col("link_score")).when(F.col("tag_id").isNotNull(), 1.0).otherwise(F.coalesce("fuzzy_score", F.lit(0.0)))
    return out.select("item_id", F.coalesce("link_id", "tag_id", F.when(good, F.col("fuzzy_id"))).alias("source_id"), score.alias("score"), via.alias("via"))


def author_similarity(left: DataFrame, right: DataFrame) -> DataFrame:
    """Highest similarity of the authors of each left row to those of its right row, by id."""
    return left.join(right, "id").select("id", author_score(F.col("authors"), F.col("other_authors")).alias("score"))


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", "")


def prefixes(path: Column) -> Column:
    """A path and all its parents, the longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def map_paths(paths: DataFrame, mappings: DataFrame, id_col: str = "id", path_col: str = "path", inverse: bool = False) -> DataFrame:
    """(id, path, mapped) under the longest mapped prefix of whole segments; unmapped paths stay.

    ``mappings`` has pos, from and to. Each path joins its own parents, so it is an equi-join.
    """
    here, there = ("to", "from") if inverse else ("from", "to")
    rules = mappings.select("pos", normal_path(F.col(here)).alias("prefix"), normal_path(F.col(there)).alias("new")).filter("prefix <> ''")
    rules = rules.groupBy("prefix").agg(F.min_by("new", "pos").alias("new"))
    rows = paths.select(F.col(id_col), F.col(path_col), normal_path(F.col(path_col)).alias("norm"))
    hits = rows.select(id_col, "norm", F.explode(prefixes(F.col("norm"))).alias("prefix")).join(rules, "prefix")
    longest = hits.groupBy(id_col, "norm").agg(F.max_by(F.struct("prefix", "new"), F.length("prefix")).alias("x"))
    mapped = F.when(F.coalesce(path_col, F.lit("")) == "", F.col(path_col)).when(F.col("x").isNull(), F.col("norm")).otherwise(F.concat("x.new", F.substr("norm", F.length("x.prefix") + 1)))
    return rows.join(longest, [id_col, "norm"], "left").select(id_col, path_col, mapped.alias("mapped"))
