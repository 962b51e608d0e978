"""Ranking the editions of a work: preferred narrators, then damped ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, normalise_name

BLOCKED, PREFERRED, RATING = -1_000_000.0, 10_000.0, 20.0


def _have(narrators: Column) -> Column:
    return F.filter(F.transform(narrators, normalise_name), lambda n: n != "")


def _index_among(have: Column, preferred: list[str]) -> Column:
    found = F.lit(None).cast("int")
    for k in reversed(range(len(preferred))):
        want = normalise_name(F.lit(preferred[k]))
        found = F.when((want != "") & F.exists(have, lambda n: n.contains(want) | want.contains(n)), F.lit(k)).otherwise(found)  # noqa: B023
    return found


def preference_index(narrators: Column, preferred: list[str]) -> Column:
    """Position of the first preferred name that equals, holds or is held by a narrator's; null if none.

    Names that are empty once normalised match nothing.
    """
    return bound(_have(narrators), lambda have: _index_among(have, preferred))


def rating_points(rating: Column, votes: Column) -> Column:
    """Votes damp the rating: a single vote counts three tenths, fifty or more count whole."""
    share = F.least(F.coalesce(votes, F.lit(0)), F.lit(50)) / F.lit(50.0)
    return F.coalesce(rating * (F.lit(0.3) + F.lit(0.7) * share) * F.lit(RATING), F.lit(0.0))


def with_score(books: DataFrame, preferred: list[str], blocked: list[str]) -> DataFrame:
    """Add blocked, preferred_index, score and reasons to books with a narrators array."""
    present = lambda c, points: F.when(c, F.lit(float(points))).otherwise(0.0)
    index = F.col("preferred_index")
    bonus = (
        present(F.coalesce(F.col("series_key") != "", F.lit(False)), 5) + present(F.coalesce(F.col("duration_sec") != 0, F.lit(False)), 3)
        + present(F.coalesce(F.col("description") != "", F.lit(False)), 2) + present(F.size("narrators") > 0, 2) + present(F.coalesce(F.col("detail_state") == "ok", F.lit(False)), 5)
    )
    score = present(F.col("blocked"), BLOCKED) + F.coalesce((F.lit(len(preferred)) - index) * F.lit(PREFERRED), F.lit(0.0)) + rating_points(F.col("rating"), F.col("votes")) + bonus
    names = F.array(*[F.lit(p) for p in preferred]).cast("array<string>")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("blocked"), F.concat(F.lit("narrator blocked ("), F.array_join("narrators", ", "), F.lit(")"))),
            F.when(index.isNotNull(), F.concat(F.lit("preferred narrator #"), (index + 1).cast("string"), F.lit(": "), F.try_element_at(names, index + 1))),
            F.when(F.col("rating").isNotNull(), F.concat(F.lit("rating "), F.col("rating").cast("string"), F.lit(" ("), F.coalesce("votes", F.lit(0)).cast("string"), F.lit(" votes)"))),
        )
    )
    # a book's narrators are normalised once, for both lists and all of their names
    found = bound(_have(F.col("narrators")), lambda have: F.struct(_index_among(have, blocked).isNotNull().alias("blocked"), _index_among(have, preferred).alias("preferred_index")))
    out = books.withColumn("__found", found).withColumn("blocked", F.coalesce("__found.blocked", F.lit(False))).withColumn("preferred_index", F.col("__found.preferred_index")).drop("__found")
    return out.withColumn("score", score).withColumn("reasons", reasons)


def group_key() -> Column:
    """The work's key; a book without one is a work of its own."""
    return F.coalesce(F.col("work_key"), F.concat(F.lit("unkeyed:"), F.col("source_id").cast("string")))


def rank_editions(scored: DataFrame, within: list[str]) -> DataFrame:
    """Add place: 1 is the best edition of its work inside ``within``; blocked ones stand last.

    Ties go to the greater source_id.
    """
    order = Window.partitionBy(*within).orderBy("blocked", F.col("score").desc(), F.col("source_id").desc())
    return scored.withColumn("place", F.row_number().over(order))


def best_editions(scored: DataFrame, within: list[str]) -> DataFrame:
    """The best edition of each work as an aggregate: partial maxima before the shuffle."""
    others = [c for c in scored.columns if c not in within]
    order = F.struct((~F.col("blocked")).alias("b"), F.col("score").alias("s"), F.col("source_id").alias("i"))
    return scored.groupBy(*within).agg(F.max_by(F.struct(*others), order).alias("x")).select(*within, "x.*")


def alternatives(ranked: DataFrame, within: list[str]) -> DataFrame:
    """Editions other than the best, by score; rows with the winner's id aren't alternatives."""
    winner = F.first(F.when(F.col("place") == 1, F.col("source_id")), ignorenulls=True).over(Window.partitionBy(*within))
    rest = ranked.withColumn("winner", winner).filter("source_id <> winner")
    order = Window.partitionBy(*within).orderBy(F.col("score").desc(), F.col("source_id"))
    return rest.withColumn("rank", F.row_number().over(order)).drop("place")
