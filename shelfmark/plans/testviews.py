"""The catalogue's tables as views of the star schema that the queries run over."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same views in SQL, to be put before a query.
VIEWS_SQL = """
WITH stats AS (
  SELECT l_partkey AS source_id, CAST(50 AS DOUBLE) * avg(l_discount) AS rating, count(*) AS votes FROM lineitem GROUP BY l_partkey
), books AS (
  SELECT p_partkey AS source_id, p_name AS title, lower(p_brand) AS series_key, p_brand AS series_name, p_type AS genre, p_size AS size, p_retailprice AS price,
         CASE WHEN p_size % 3 = 0 THEN 'pending' ELSE 'ok' END AS detail_state, rating, votes
  FROM part LEFT JOIN stats ON p_partkey = source_id
), book_authors AS (
  SELECT DISTINCT l_partkey AS source_id, lower(s_name) AS author_key FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
), authors AS (
  SELECT lower(s_name) AS key, s_name AS name FROM supplier
), book_narrators AS (
  SELECT DISTINCT l_partkey AS source_id, lower(n_name) AS narrator_key FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
), narrators AS (
  SELECT lower(n_name) AS key, n_name AS name FROM nation
), book_tags AS (
  SELECT DISTINCT p_partkey AS source_id, unnest(string_split(p_name, ' ')) AS tag FROM part
), queue AS (
  SELECT o_orderkey AS id, o_orderkey AS source_id, CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'F' THEN 'accepted' ELSE 'prepared' END AS state, o_orderpriority AS reason, o_orderdate AS created_at, o_custkey AS custkey FROM orders
), links AS (
  SELECT o_orderkey AS source_id, 'item' || o_orderkey AS item_id FROM orders WHERE o_orderkey % 7 = 0
)
"""


class Views:
    """Views over the tables in one folder, made when first used; of some books only, if ``ids`` (source_id) says so."""

    def __init__(self, spark: SparkSession, sf_dir: str, ids: DataFrame | None = None):
        self.spark, self.sf_dir, self.ids = spark, sf_dir, ids

    def within(self, ids: DataFrame) -> Views:
        """The views of these books: what they are made of is narrowed before it is aggregated."""
        return Views(self.spark, self.sf_dir, ids.select("source_id").distinct())

    def table(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        key = {"part": "p_partkey", "lineitem": "l_partkey"}.get(name)
        return rows if self.ids is None or key is None else rows.join(self.ids, F.col(key) == F.col("source_id"), "left_semi")

    @cached_property
    def titles(self) -> DataFrame:
        """The books' own columns, without what lineitem tells of them."""
        state = F.when(F.col("p_size") % 3 == 0, "pending").otherwise("ok")
        return self.table("part").select(F.col("p_partkey").alias("source_id"), F.col("p_name").alias("title"), F.lower("p_brand").alias("series_key"), F.col("p_brand").alias("series_name"), F.col("p_type").alias("genre"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), state.alias("detail_state"))

    @cached_property
    def books(self) -> DataFrame:
        stats = self.table("lineitem").groupBy(F.col("l_partkey").alias("source_id")).agg((F.lit(50.0) * F.avg("l_discount")).alias("rating"), F.count(F.lit(1)).alias("votes"))
        return self.titles.join(stats, "source_id", "left")

    @cached_property
    def supplied(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_partkey").alias("source_id"), "l_suppkey")

    @cached_property
    def book_authors(self) -> DataFrame:
        supplier = self.table("supplier").select("s_suppkey", F.lower("s_name").alias("author_key"))
        return self.supplied.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("source_id", "author_key").distinct()

    @cached_property
    def authors(self) -> DataFrame:
        return self.table("supplier").select(F.lower("s_name").alias("key"), F.col("s_name").alias("name"))

    @cached_property
    def book_narrators(self) -> DataFrame:
        supplier, nation = self.table("supplier").select("s_suppkey", "s_nationkey"), self.table("nation").select("n_nationkey", F.lower("n_name").alias("narrator_key"))
        return self.supplied.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("source_id", "narrator_key").distinct()

    @cached_property
    def narrators(self) -> DataFrame:
        return self.table("nation").select(F.lower("n_name").alias("key"), F.col("n_name").alias("name"))

    @cached_property
    def book_tags(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("source_id"), F.explode(F.split("p_name", " ")).alias("tag")).distinct()

    @cached_property
    def queue(self) -> DataFrame:
        state = F.when(F.col("o_orderstatus") == "O", "new").when(F.col("o_orderstatus") == "F", "accepted").otherwise("prepared")
        return self.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("source_id"), state.alias("state"), F.col("o_orderpriority").alias("reason"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("custkey"))

    @cached_property
    def links(self) -> DataFrame:
        return self.table("orders").filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("source_id"), F.concat(F.lit("item"), F.col("o_orderkey").cast("string")).alias("item_id"))

    @cached_property
    def fetch_log(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("user_id").alias("origin"), kind.alias("event_type"), (kind == "error").alias("challenge"), (~kind.isin("error", "signup")).alias("ok"),
            F.floor(F.col("value") * 100).cast("long").alias("ms"), F.expr("unix_millis(cast(ts as timestamp))").alias("at_ms"), F.when(kind == "error", "challenge").when(kind == "signup", "failure").otherwise("success").alias("kind"),
        )
