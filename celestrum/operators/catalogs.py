"""Weights and named fields of catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_field(catalog: DataFrame, name: str, value: Column) -> DataFrame:
    return catalog.withColumn(name, value)


def weight_from(catalog: DataFrame, name: str) -> DataFrame:
    """The field becomes the weight too."""
    return catalog.withColumn("weight", F.col(name).cast("double"))


def weight_to(catalog: DataFrame, name: str) -> DataFrame:
    """The weight becomes the field too."""
    return catalog.withColumn(name, F.col("weight"))


def swap_weight(catalog: DataFrame, name: str) -> DataFrame:
    return catalog.withColumns({"weight": F.col(name).cast("double"), name: F.col("weight")})
