"""Rasters as pixel tables and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What stands for no data in stored rasters.
NO_DATA = {"euv": -9999.0, "magnetic": -65500.0}


def raster_to_pixels(rasters: DataFrame, key: str = "map_id", layers: Sequence[str] = ("data",), no_data: float = NO_DATA["euv"]) -> DataFrame:
    """(key, iy, ix, x, y, layers) of rows with axes x, y and row-major layers; the no-data value becomes null (S3)."""
    zipped = F.arrays_zip(*layers)
    rows = rasters.select(key, "x", "y", F.posexplode(zipped).alias("p", "v"))
    n = F.size("x")
    iy, ix = F.floor(F.col("p") / n).cast("int"), (F.col("p") % n).cast("int")
    return rows.select(key, iy.alias("iy"), ix.alias("ix"), F.get("x", ix).alias("x"), F.get("y", iy).alias("y"), *[F.nullif(F.col(f"v.{c}"), F.lit(no_data)).alias(c) for c in layers])


def pixels_to_raster(px: DataFrame, key: str = "map_id", layers: Sequence[str] = ("data",), no_data: float = NO_DATA["euv"]) -> DataFrame:
    """Row-major layers of each map, null as the no-data value, with nx (S4). A map is one row: at most some million pixels."""
    cell = F.struct("iy", "ix", *[F.coalesce(F.col(c).cast("double"), F.lit(no_data)).alias(c) for c in layers])
    got = px.groupBy(key).agg(F.sort_array(F.collect_list(cell)).alias("__c"), (F.max("ix") + 1).alias("nx"))
    return got.select(key, "nx", *[F.col(f"__c.{c}").alias(c) for c in layers])
