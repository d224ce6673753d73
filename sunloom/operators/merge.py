"""Merging maps on one grid, pixel by pixel (A12 to A16, W6, O8). No data is null throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_min(px: DataFrame, cell: Sequence[str] = ("iy", "ix"), order: str = "map_id", del_mu: float | None = None, mu_cutoff: float = 0.0, mu_merge_cutoff: float | None = None) -> DataFrame:
    """Minimum-intensity merge (A12): per cell the winner's data, mu, chd and origin.

    Data under mu_cutoff and negative data don't count. del_mu: good data are those with mu over the cell's greatest
    less del_mu. mu_merge_cutoff: good are those with mu of at least it where two or more maps have data, and all where
    one has. The least good value wins, else the least value; the least `order` wins ties. A cell without data stays,
    with nulls.
    """
    ok = (F.col("data") >= 0) & (F.coalesce(F.col("mu"), F.lit(0.0)) >= mu_cutoff)
    seen = px.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    w = Window.partitionBy(*cell)
    good = F.lit(True)
    if del_mu is not None:
        seen = seen.withColumn("__top", F.max(F.when(F.col("mu") >= mu_cutoff, F.col("mu"))).over(w))
        good = F.coalesce(F.col("mu") > F.col("__top") - del_mu, F.lit(False))
    elif mu_merge_cutoff is not None:
        seen = seen.withColumn("__n", F.sum(F.col("__ok").cast("int")).over(w))
        good = (F.col("__n") < 2) | F.coalesce(F.col("mu") >= mu_merge_cutoff, F.lit(False))
    rank = F.when(F.col("__ok"), F.struct((~good).alias("a"), F.col("data").alias("b"), F.col(order).alias("c")))
    carried = [c for c in ("data", "mu", "chd", "origin_image") if c in px.columns]
    best = seen.withColumn("__rank", rank).groupBy(*cell).agg(F.min_by(F.struct(*carried), "__rank").alias("__w"))
    return best.select(*cell, *[F.col(f"__w.{c}").alias(c) for c in carried])


def merge_synoptic(px: DataFrame, cell: Sequence[str] = ("iy", "ix"), order: str = "map_id", weight: str | None = None) -> DataFrame:
    """Rotation merge (A13): least data, and the mean of chd over maps with data; weight "mu": of chd * mu, where mu of
    0 or less counts 0.01 (A14)."""
    valid = F.col("data").isNotNull()
    chd = F.col("chd") if weight is None else F.col("chd") * F.greatest(F.col("mu"), F.lit(0.01))
    rank = F.when(valid, F.struct("data", order))
    return px.groupBy(*cell).agg(F.min_by("data", rank).alias("data"), F.avg(F.when(valid, chd)).alias("chd"), F.sum(valid.cast("int")).alias("n_maps"))


def merge_weighted(px: DataFrame, weights: DataFrame, key: str = "map_id", values: Sequence[str] = ("data", "mu", "chd"), cell: Sequence[str] = ("iy", "ix"), missing: str = "skip") -> DataFrame:
    """Weighted means per cell. missing "skip": over maps with data, weights must sum to 1 (A15); "zero": a map without
    data counts as 0 with its full weight, and a cell without any data is null (A16)."""
    if missing == "skip":
        total = weights.agg(F.sum("weight")).first()[0] or 0.0
        if abs(total - 1) > 1e-6:
            raise ValueError(f"weights sum to {total}, not 1")
    both = px.join(weights, key)
    w = F.col("weight")

    def mean(c: str):
        has = F.col(c).isNotNull()
        top = F.sum(F.when(has, w * F.col(c)))
        return (top / (F.sum(F.when(has, w)) if missing == "skip" else F.sum(w))).alias(c)

    return both.groupBy(*cell).agg(*map(mean, values))


def gauss_weights(df: DataFrame, sigma: float = 0.15, order_by: Sequence[str] = ("date_obs",), by: Sequence[str] = ()) -> DataFrame:
    """df with `weight`: a Gaussian around 1 at 0.5 + i / n by rank in time, its greatest value 1."""
    w = Window.partitionBy(*by)
    x = F.lit(0.5) + (F.row_number().over(w.orderBy(*order_by)) - 1) / F.count("*").over(w)
    out = df.withColumn("__g", F.exp(-F.pow((x - 1) / sigma, 2) / 2))
    return out.withColumn("weight", F.col("__g") / F.max("__g").over(w)).drop("__g")


def provenance(products: DataFrame, sources: DataFrame, product: str = "product_id", source: str = "map_id") -> DataFrame:
    """Methods, inputs and times of every source of a merge product, once each."""
    return products.select(product, source).join(sources, source).drop(source).dropDuplicates()
