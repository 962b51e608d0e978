"""Sharding by weighted rendezvous hashing of stable record keys.

Every (record key, shard) pair has a hash u in (0, 1); the record goes to the shard with the least
-ln(u) / weight. A further shard can only win records for itself, and a removed one only loses its
own, so no other record moves. Equal keys share a shard; nothing else about a record counts.

Slots number a shard's records from 0 without gaps, in buckets by a hash of key and text, which ``numbered``
deals out; it also splits null or repeated keys and repeated rows.

A null key counts as a key of its own: all its rows share a shard, as the law asks. Null text has no bytes (size
1, crc 0). Very long texts are hashed whole. Ties and repeated rows share a shard and get slots of their own. Columns of any name pass through,
but for those that begin with ``__sm_``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, numbered

SHARDS = 16
#: 52 bits: a double holds u exactly.
SCALE = float(1 << 52)


def _cost(key: Column, shard: int, weight: float) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{shard}:"), key).cast("binary")), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / SCALE
    return -F.log(u) / F.lit(float(weight))


def record_key(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("~"))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard, as an int, of a record key; ``weights`` has one positive weight per shard."""
    return F.array_min(F.array(*[F.struct(_cost(key, k, w).alias("cost"), F.lit(k).alias("shard")) for k, w in enumerate(weights)]))["shard"]


def assign(df: DataFrame, shards: int = SHARDS, weights: list[float] | None = None, new_weight: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with __sm_shard, __sm_grown (the shard if there were one more), __sm_size, __sm_crc and __sm_text (a hash)."""
    weights = weights or [1.0] * shards
    key = record_key(F.col(id_col))
    best = F.array_min(F.array(*[F.struct(_cost(key, k, w).alias("cost"), F.lit(k).alias("shard")) for k, w in enumerate(weights)]))
    data = F.coalesce(F.col(text_col), F.lit(""))
    return (
        df.withColumn(f"{OWN}best", best)
        .withColumn(f"{OWN}shard", F.col(f"{OWN}best")["shard"])
        .withColumn(f"{OWN}grown", F.when(_cost(key, len(weights), new_weight) < F.col(f"{OWN}best")["cost"], F.lit(len(weights))).otherwise(F.col(f"{OWN}best")["shard"]))
        .drop(f"{OWN}best")
        .withColumn(f"{OWN}size", (F.octet_length(data) + 1).cast("long"))
        .withColumn(f"{OWN}crc", F.crc32(data.cast("binary")))
        .withColumn(f"{OWN}text", F.xxhash64(F.col(text_col)))
    )


def with_slots(assigned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Add __sm_slot to what ``assign`` gave."""
    alike = F.concat_ws("|", record_key(F.col(id_col)), f"{OWN}size", f"{OWN}crc", f"{OWN}text")
    rows = assigned.withColumn(f"{OWN}order", F.lit(0)).withColumn(f"{OWN}hash", F.md5(alike.cast("binary")))
    return numbered(rows, [f"{OWN}shard"], f"{OWN}slot").drop(f"{OWN}order", f"{OWN}hash", f"{OWN}text")
