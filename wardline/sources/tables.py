"""Adapter from the driver tables to the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.text import is_sparse


class Tables:
    """Parquet tables of one folder, read lazily with only the columns a query uses."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def incidents(self) -> DataFrame:
        """Documents as incident reports: narrative, site, activity."""
        return self.documents.select(
            F.col("doc_id").alias("incident_id"),
            F.col("text").alias("narrative"),
            F.col("source").alias("site"),
            F.col("lang").alias("activity"),
        )

    def predictions(self) -> DataFrame:
        """A fixed score per document, with the sparse flag of its text."""
        score = self.score(F.col("doc_id"))
        return self.documents.select(
            F.col("doc_id").alias("incident_id"),
            score.alias("score"),
            (score >= 0.5).alias("predicted"),
            is_sparse("text").alias("sparse"),
        )

    def scored(self) -> DataFrame:
        """Incidents with their prediction and dates from the orders table shape."""
        score = self.score(F.col("doc_id"))
        return self.documents.select(
            F.col("doc_id").alias("incident_id"),
            F.col("text").alias("narrative"),
            F.col("source").alias("site"),
            F.col("lang").alias("activity"),
            score.alias("score"),
            (score >= 0.5).alias("predicted"),
            is_sparse("text").alias("sparse"),
        )

    def labelled(self) -> DataFrame:
        """Score, predicted flag and two raters for the documents that have labels."""
        score = self.score(F.col("doc_id"))
        return self.labels.select(
            F.col("doc_id").alias("incident_id"), score.alias("score"), (score >= 0.5).alias("predicted"),
            "quality", "toxic",
        )

    def tags(self) -> DataFrame:
        """Events as rule tags: rule, site and day."""
        return self.events.select(
            F.col("event_id").alias("incident_id"),
            F.col("event_type").alias("rule"),
            F.col("user_id").cast("string").alias("site"),
            F.to_date("ts").alias("day"),
            F.col("value"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )

    def dated(self) -> DataFrame:
        """Orders as dated facts with a site (nation), region, activity and flag."""
        sites = self.nation.join(
            self.region, F.col("n_regionkey") == F.col("r_regionkey")
        ).select("n_nationkey", F.col("n_name").alias("site"), F.col("r_name").alias("region"))
        people = self.customer.select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("department"))
        return (
            self.orders.join(people, F.col("o_custkey") == F.col("c_custkey"))
            .join(sites, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("o_orderkey").alias("incident_id"),
                "site",
                "region",
                "department",
                F.col("o_orderpriority").alias("activity"),
                F.col("o_orderstatus").alias("hazard"),
                F.to_date("o_orderdate").alias("event_date"),
                (F.col("o_orderkey") % 7 == 0).alias("predicted"),
                (F.col("o_orderkey") % 11 == 0).alias("sparse"),
            )
        )

    def line_tags(self) -> DataFrame:
        """Line items as rule tags of orders: rule is return flag and line status."""
        return self.lineitem.select(
            F.col("l_orderkey").alias("incident_id"),
            F.concat_ws("-", "l_returnflag", "l_linestatus").alias("rule"),
        )

    @staticmethod
    def score(key):
        return F.pmod(key * 37, F.lit(1000)) / F.lit(1000.0)
