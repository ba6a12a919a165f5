"""The survey as one object: entities, cells and dimensions, and the questions that a reader asks of them, each answered by a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacell.operators.served import compared, quantiles, suggested
from stratacell.sources.manual import located
from stratacell.sources.tables import exploded_cells, fingerprint, read_entities

#: The states of a cell.
STATES = ("coded", "not_reported", "unresolved", "missing")


def state() -> Column:
    """What a cell's columns say; silence is never a value."""
    return F.when(F.coalesce("unresolved", F.lit(False)), "unresolved").when(F.coalesce("not_reported", F.lit(False)), "not_reported").when(F.col("value").isNotNull(), "coded").otherwise("missing")


@dataclass(frozen=True)
class Survey:
    """entities: id, name, ...; cells: id, key, ord, value, state, evidence; dimensions: key, ord, layer."""

    entities: DataFrame
    cells: DataFrame
    dimensions: DataFrame

    @classmethod
    def of(cls, entities: DataFrame, dimensions: DataFrame) -> Survey:
        cells = exploded_cells(entities, dimensions).withColumn("state", state())
        return cls(entities, cells, dimensions)

    @classmethod
    def load(cls, spark: SparkSession, dimensions: DataFrame, path: str | None = None) -> Survey:
        """From a path, an environment variable or a parent folder."""
        return cls.of(read_entities(spark, f"{located(path).path}/entities.json"), dimensions)

    def dimension(self, key: str) -> DataFrame:
        """How often each state and value of a dimension occurs; the filter comes before the count."""
        return self.cells.filter(F.col("key") == key).groupBy("state", "value").agg(F.count(F.lit(1)).alias("n"))

    def not_reported(self, by: str = "key") -> DataFrame:
        """The share of silent cells among those that are coded or silent, by key or layer."""
        own = self.cells if by == "key" else self.cells.join(F.broadcast(self.dimensions.select("key", by)), "key")
        silent = F.count_if(F.col("state") == "not_reported")
        return own.filter(F.col("state").isin("coded", "not_reported")).groupBy(by).agg(F.count(F.lit(1)).alias("n"), silent.alias("silent")).withColumn("rate", F.round(F.col("silent") / F.col("n"), 6))

    def evidence(self, id_: str, key: str) -> DataFrame:
        return self.cells.filter((F.col("id") == id_) & (F.col("key") == key)).select("id", "key", "state", "value", "evidence")

    def summary(self) -> DataFrame:
        """One row: entities, dimensions and cells of each state."""
        return self.cells.agg(F.countDistinct("id").alias("entities"), F.countDistinct("key").alias("dimensions"), *[F.count_if(F.col("state") == s).alias(s) for s in STATES])

    def compare(self, ids: list[str], most: int = 6) -> DataFrame:
        """Some entities side by side, or a row that says why not."""
        return compared(self.cells, "id", "key", "value", ids, most)

    def suggest(self, name: str, n: int = 3) -> DataFrame:
        """The entities whose names are nearest."""
        return suggested(self.entities, "id", "name", name, n)

    def spread(self, key: str) -> DataFrame:
        """Quantiles of a dimension's numbers."""
        return quantiles(self.cells.filter(F.col("key") == key).select(F.col("value").try_cast("double").alias("value")), "value")

    def release(self, path: str) -> dict[str, str]:
        """Every derived table written under a folder: entities, cells, rates by dimension, the summary. Gives each table's fingerprint, which doesn't depend on the order of rows."""
        tables = {"entities": self.entities.drop("coding"), "cells": self.cells, "rates": self.not_reported(), "summary": self.summary()}
        for name, df in tables.items():
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        spark = self.cells.sparkSession
        return {name: fingerprint(spark.read.parquet(f"{path}/{name}")) for name in tables}
