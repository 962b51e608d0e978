"""A training corpus from the table documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the
last return the columns of documents; the last adds size, text_crc32, shard and slot.

Null, empty and letterless texts go in the first stage, as of no language. Very long texts are read whole by every
stage. Ties: of near-duplicates the least id stays, and of equal ids the least hash of the text. Repeated rows are near-duplicates of each
other, so one stays, whatever its other columns hold. Null ids count as ids of their own. Columns beyond those of documents pass through, whatever
their names, but for those that begin with ``__sm_``; the last stage replaces those of the names that it adds. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import decontam, langid, mixing, sharding, simhash
from shelfmark.llm.common import OWN, crc_of_id, forget, table, written

#: A text whose best language is less likely than this is as good as undetermined.
LEAST_SCORE = 0.3
#: A text that is less likely than its language's training rows by this many nats an n-gram is of no learned language. Whole
#: texts of the test tables stay below 3 (a line with an access key), other scripts and random letters are above 6.
MOST_FAR = 4.0
#: The stages can't be told in SQL: naive Bayes, XXH64 fingerprints and BM25 have no DuckDB form.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts of no language: null, without a letter, with no language above LEAST_SCORE, or too far from it.

    The model learns from the documents that name their language and aren't held out. Where none
    does, every text with a letter stays.
    """
    model = langid.train(docs.filter(crc_of_id(F.col("doc_id")) % 4 != 2))
    if not model.langs:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    told = langid.predict(docs, model, lang_out=f"{OWN}lang", score_out=f"{OWN}score", far_out=f"{OWN}far")
    return told.filter((F.col(f"{OWN}lang") != langid.UNDETERMINED) & (F.col(f"{OWN}score") >= LEAST_SCORE) & (F.col(f"{OWN}far") <= MOST_FAR)).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, the one with the least id."""
    return simhash.keep_one(docs).select(*_columns(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the table benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(*_columns(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bring the sources to their target weights: a row for each copy that the mix takes."""
    return mixing.emit(mixing.mix(docs), docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every row its shard and its slot in it."""
    placed = sharding.with_slots(sharding.assign(docs))
    names = {"size": "size", "text_crc32": "crc", "shard": "shard", "slot": "slot"}
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names], *[F.col(OWN + own).alias(name) for name, own in names.items()])


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder; a stage's table goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
