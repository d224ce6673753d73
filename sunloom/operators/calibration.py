"""Detector degradation in time (M8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.asof import asof_bracket, interp_params


def degradation_factor(images: DataFrame, table: DataFrame, time: str = "date_obs", by: Sequence[str] = ("wavelength",), factor: str = "factor") -> DataFrame:
    """images with the factor of their time: linear in the table, 1 before it, its last value after it; null for a
    wavelength that the table lacks."""
    known = asof_bracket(images, table, time, "ts", [factor], by).select(*images.columns, F.col("before").isNull().alias("__early"), (F.col("before").isNull() & F.col("after").isNull()).alias("__none"))
    inside = interp_params(known, table, time, "ts", [factor], by)
    return inside.withColumn(factor, F.when(F.col("__none"), None).when(F.col("__early"), 1.0).otherwise(F.col(factor))).drop("__early", "__none")


def correct_degradation(px: DataFrame, factors: DataFrame, key: str = "data_id", value: str = "data") -> DataFrame:
    """Intensities divided by their image's factor."""
    return px.join(factors.select(key, F.col("factor").alias("__f")), key).withColumn(value, F.col(value) / F.col("__f")).drop("__f")
