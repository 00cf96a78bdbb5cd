"""Report tables derived from an order-and-parts star schema.

A part name plays the entity, an order the article, a line item the mention of
a part in an order, and the customer's nation the news source. That gives the
reports tables that grow with the data without a news feed.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entitylake.functions.keys import composite_key
from entitylake.plans.layers import complete_affiliations, entity_affiliations, entity_mapping
from entitylake.plans.reports import ReportTables


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _entity_type(name: Column) -> Column:
    kind = F.length(name) % 3
    return F.when(kind == 0, "PERSON").when(kind == 1, "ORG").otherwise("LOC")


def known_entities(spark: SparkSession, folder: str) -> DataFrame:
    """One entity per distinct part name; the name is its description too."""
    name = F.col("entity_name")
    return (
        table(spark, folder, "part")
        .select(F.col("p_name").alias("entity_name"))
        .distinct()
        .withColumn("entity_type", _entity_type(name))
        .select(
            composite_key("entity_name", "entity_type").alias("uri"),
            "entity_name",
            "entity_type",
            name.alias("entity_description"),
        )
    )


def entity_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Texts an entity's description mentions: the whole name and each of its words."""
    name = F.col("entity_name")
    texts = F.concat(F.array(name), F.split(name, " "))
    return known_entities(spark, folder).select(
        "uri", F.explode(F.array_distinct(texts)).alias("entity_text"), "entity_type"
    )


def affiliations(spark: SparkSession, folder: str) -> DataFrame:
    entities = known_entities(spark, folder)
    mapping = entity_mapping(entity_mentions(spark, folder))
    return complete_affiliations(entity_affiliations(mapping, entities))


def mentions(spark: SparkSession, folder: str) -> DataFrame:
    name = F.col("p_name")
    order = F.col("l_orderkey").cast("string")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_discount")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            composite_key(name, _entity_type(name)).alias("entity_uri"),
            name.alias("entity_name"),
            _entity_type(name).alias("entity_type"),
            name.alias("entity_description"),
            order.alias("source_uri"),
            F.col("o_orderpriority").alias("source_title"),
            F.concat(F.lit("order "), order).alias("source_description"),
            F.concat(F.lit("order/"), order).alias("source_url"),
            F.col("n_name").alias("source_name"),
            F.col("o_orderdate").alias("source_published_at"),
            F.concat(name, F.lit(" == line "), F.col("l_linenumber").cast("string")).alias("match_details"),
            F.round(80 + 200 * F.col("l_discount"), 1).alias("match_score"),
        )
    )


def party_mentions(spark: SparkSession, folder: str, party: str) -> DataFrame:
    """Mentions of the customers or suppliers (``party``) of orders: as many entities as the tables have.

    An order mentions its customer once and the supplier of each line.
    """
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_discount")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    if party == "customer":
        rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        name, described, detail = F.col("c_name"), F.col("c_mktsegment"), F.lit("buyer")
        score = F.lit(100.0)
    else:
        suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_name")
        rows = (
            line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        )
        name, described = F.col("s_name"), F.col("s_suppkey").cast("string")
        detail = F.concat(F.lit("line "), F.col("l_linenumber").cast("string"))
        score = F.round(80 + 200 * F.col("l_discount"), 1)
    order = F.col("o_orderkey").cast("string")
    return rows.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        composite_key(name, _entity_type(described)).alias("entity_uri"),
        name.alias("entity_name"),
        _entity_type(described).alias("entity_type"),
        described.alias("entity_description"),
        order.alias("source_uri"),
        F.col("o_orderpriority").alias("source_title"),
        F.concat(F.lit("order "), order).alias("source_description"),
        F.concat(F.lit("order/"), order).alias("source_url"),
        F.col("n_name").alias("source_name"),
        F.col("o_orderdate").alias("source_published_at"),
        detail.alias("match_details"),
        score.alias("match_score"),
    )


def sentiment(spark: SparkSession, folder: str) -> DataFrame:
    """Score from the price, as a binary fraction so that sums do not depend on their order."""
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("uri"),
        F.col("o_orderpriority").alias("title"),
        (F.floor("o_totalprice") / F.lit(524288.0)).alias("sentiment_score"),
        F.when(status == "F", "POSITIVE")
        .when(status == "O", "NEUTRAL")
        .otherwise("NEGATIVE")
        .alias("sentiment_label"),
    )


class StarTables(ReportTables):
    """The report tables over a folder, each set up when a report first asks for it."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder

    @cached_property
    def affiliations(self) -> DataFrame:
        return affiliations(self._spark, self._folder)

    @cached_property
    def mentions(self) -> DataFrame:
        return mentions(self._spark, self._folder)

    @cached_property
    def sentiment(self) -> DataFrame:
        return sentiment(self._spark, self._folder)


class PartyTables(StarTables):
    """The same with customers or suppliers as the entities mentioned."""

    def __init__(self, spark: SparkSession, folder: str, party: str) -> None:
        super().__init__(spark, folder)
        self._party = party

    @cached_property
    def mentions(self) -> DataFrame:
        return party_mentions(self._spark, self._folder, self._party)
