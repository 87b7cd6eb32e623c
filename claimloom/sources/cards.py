"""Readers and writers of JSON cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_cards(spark: SparkSession, path: str, schema: str, states: list[str]) -> DataFrame:
    """SRC-01: every ``*.json`` of a folder; fails closed on a wrong name or a review state that isn't allowed."""
    cards = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path, pathGlobFilter="*.json")
    name = F.col("_metadata.file_name")
    wrong = (name != F.concat(F.col("slug"), F.lit(".json"))) | ~F.coalesce(F.col("reviewState").isin(states), F.lit(False))
    return cards.select("*", name.alias("file")).withColumn("slug", F.when(wrong, F.raise_error(F.concat(F.lit("card not allowed here: "), "file"))).otherwise(F.col("slug"))).drop("file")


def write_dataset(cards: DataFrame, path: str) -> None:
    """SNK-01: cards as JSON lines in slug order."""
    cards.orderBy("slug").write.mode("overwrite").json(path)


def generated_at(cards: DataFrame, columns: list[str]) -> DataFrame:
    """AGG-16: the largest of all timestamps as strings, else the epoch."""
    return cards.agg(F.coalesce(F.max(F.greatest(*(F.col(c) for c in columns)) if len(columns) > 1 else F.col(columns[0])), F.lit("1970-01-01T00:00:00.000Z")).alias("generated_at"))
