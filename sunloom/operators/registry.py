"""Registry writes as functions of tables: what a batch adds, changes or removes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.order import row_numbers


def register_files(existing: DataFrame, incoming: DataFrame, order: str = "fname_raw") -> DataFrame:
    """incoming with `out_flag`: 0 new, 1 its date, provider and type are there, 2 its raw name is there.

    A row that repeats another of the batch counts as if the other, earlier in `order`, were there already.
    """
    key = ["date_obs", "provider", "type"]
    first_key = F.row_number().over(Window.partitionBy(*key).orderBy(order)) == 1
    first_name = F.row_number().over(Window.partitionBy("fname_raw").orderBy(*key)) == 1
    rows = incoming.withColumns({"__fk": first_key, "__fn": first_name})
    has_key = existing.select(*key, F.lit(True).alias("__k")).distinct()
    has_name = existing.select("fname_raw", F.lit(True).alias("__n")).distinct()
    both = rows.join(has_key, key, "left").join(has_name, "fname_raw", "left")
    flag = F.when(F.col("__k").isNotNull() | ~F.col("__fk"), 1).when(F.col("__n").isNotNull() | ~F.col("__fn"), 2).otherwise(0)
    return both.select(*incoming.columns, flag.alias("out_flag"))


def upsert_hists(store: DataFrame, new: DataFrame, overwrite: bool = False, tolerance: float = 1e-4) -> DataFrame:
    """The store with new histograms added; one that is there (same image, method, binning, latitude band within a
    relative tolerance) keeps its counts, or takes the new ones if overwrite (S6)."""
    key = ["image_id", "meth_id", "n_mu_bins", "n_intensity_bins"]
    n = new.select(*key, F.col("lat_band").alias("__band"), F.col("hist").alias("__hist")).dropDuplicates([*key, "__band"])
    near = F.abs(F.col("lat_band") - F.col("__band")) <= tolerance * F.abs(F.col("__band"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}")) for c in key]
    on = near
    for c in same:
        on = on & c
    kept = store.alias("s").join(n.alias("n"), on, "left").select(*[F.col(f"s.{c}") if c != "hist" else F.coalesce(F.col("n.__hist") if overwrite else F.col("s.hist"), F.col("s.hist")).alias("hist") for c in store.columns])
    there = new.alias("n").join(store.select(*key, F.col("lat_band").alias("__band")).alias("s"), _and([F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}")) for c in key]) & (F.abs(F.col("n.lat_band") - F.col("__band")) <= tolerance * F.abs(F.col("n.lat_band"))), "left_anti")
    return kept.unionByName(there.select(store.columns))


def _and(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def register_maps(maps: DataFrame, map_vars: DataFrame, new: DataFrame, new_vars: DataFrame, eps: float = 1e-6) -> DataFrame:
    """new maps with `existing`: the least map with the same combo and methods and all the new one's non-null parameters
    within a relative eps; null if it is new (S7). A name already taken also rejects."""
    want = new_vars.where("var_val IS NOT NULL").groupBy("map_id").agg(F.count("*").alias("n_want"))
    pairs = new.select(F.col("map_id").alias("new_id"), "combo_id", "meth_combo_id").join(maps.select("map_id", "combo_id", "meth_combo_id"), ["combo_id", "meth_combo_id"])
    a = new_vars.where("var_val IS NOT NULL").select(F.col("map_id").alias("new_id"), "var_id", F.col("var_val").alias("__v"))
    b = map_vars.select("map_id", "var_id", "var_val")
    close = F.abs(F.col("var_val") - F.col("__v")) <= eps * F.abs(F.col("__v"))
    hits = pairs.join(a, "new_id").join(b, ["map_id", "var_id"]).where(close).groupBy("new_id", "map_id").agg(F.count("*").alias("n"))
    full = pairs.join(hits, ["new_id", "map_id"], "left").join(want.withColumnRenamed("map_id", "new_id"), "new_id", "left").where(F.coalesce("n", F.lit(0)) == F.coalesce("n_want", F.lit(0)))
    found = full.groupBy("new_id").agg(F.min("map_id").alias("existing"))
    named = new.where("fname IS NOT NULL").select(F.col("map_id").alias("new_id"), "fname").join(maps.select("fname", F.col("map_id").alias("by_name")), "fname").groupBy("new_id").agg(F.min("by_name").alias("by_name"))
    out = new.join(found.withColumnRenamed("new_id", "map_id"), "map_id", "left").join(named.withColumnRenamed("new_id", "map_id"), "map_id", "left")
    return out.select(*new.columns, F.coalesce("existing", "by_name").alias("existing"))


PROTECTED = {"image": ("data_id", "date_obs", "instrument", "wavelength"), "map": ("map_id", "combo_id", "meth_combo_id")}


def update_column(df: DataFrame, where: Column, col: str, value: Column, kind: str = "image") -> DataFrame:
    """One column set where a condition holds; identifying columns are refused."""
    if col in PROTECTED[kind]:
        raise ValueError(f"column {col} identifies a row and can't be changed")
    return df.withColumn(col, F.when(where, value).otherwise(F.col(col)))


def delete_cascade(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table without the rows that name one of the ids, and (table, deleted) counts (S9). tables: name to (table,
    its column for the key)."""
    left, counts = {}, None
    for name, (df, col) in tables.items():
        gone = ids.select(F.col(key).alias(col)).distinct()
        left[name] = df.join(gone, col, "left_anti").select(df.columns)
        n = df.join(gone, col, "left_semi").agg(F.count("*").alias("deleted")).select(F.lit(name).alias("table"), "deleted")
        counts = n if counts is None else counts.unionByName(n)
    return left, counts


def delete_images(files: DataFrame, ids: DataFrame) -> DataFrame:
    """files with the processed name of some images blanked: deletion of processed data only."""
    return files.join(ids.select("data_id", F.lit(True).alias("__x")).distinct(), "data_id", "left").withColumn("fname_hdf", F.when(F.col("__x"), "").otherwise(F.col("fname_hdf"))).select(files.columns)


def upsert_dim(dim: DataFrame, incoming: DataFrame, natural: Sequence[str], id_col: str) -> DataFrame:
    """dim with new natural keys added under the next ids, in the keys' order (S10), by ranges of them."""
    new = incoming.select(*natural).distinct().join(dim, list(natural), "left_anti")
    top = dim.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top"))  # one row
    rows = row_numbers(new, list(natural), "__number").crossJoin(F.broadcast(top)).withColumn(id_col, (F.col("__top") + F.col("__number")).cast("long"))
    return dim.unionByName(rows.select(id_col, *natural), allowMissingColumns=True)


def orphan_combos(combos: DataFrame, *users: DataFrame) -> DataFrame:
    """Ids of image sets that no table uses."""
    used = users[0].select("combo_id")
    for u in users[1:]:
        used = used.unionByName(u.select("combo_id"))
    return combos.select("combo_id").join(used.distinct(), "combo_id", "left_anti")


def drop_combos(combo_ids: DataFrame, tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables (sets, links, values) without the rows of some image sets, and name, n_dropped, n_kept of each (S11,
    S14). Rows without a combo_id stay."""
    gone = combo_ids.select("combo_id").distinct()
    kept = {name: df.join(gone, "combo_id", "left_anti").select(df.columns) for name, df in tables.items()}
    told = []
    for name, df in tables.items():
        hit = df.select("combo_id").join(gone.withColumn("__x", F.lit(True)), "combo_id", "left")
        told.append(hit.agg(F.lit(name).alias("name"), F.count("__x").alias("n_dropped"), F.count_if(F.col("__x").isNull()).alias("n_kept")))
    return kept, reduce(DataFrame.unionByName, told)


def store_params(store: DataFrame, fits: DataFrame, variables: DataFrame, params: Sequence[str]) -> DataFrame:
    """The parameter table with fitted values, one row per set, method and variable; values already there change.

    fits: combo_id, meth_id and a column a parameter; variables: var_id, meth_id, var_name.
    """
    long = fits.unpivot(["combo_id", "meth_id"], list(params), "var_name", "var_val").join(variables.select("var_id", "meth_id", "var_name"), ["meth_id", "var_name"])
    long = long.select("combo_id", "meth_id", "var_id", "var_val")
    return store.join(long, ["combo_id", "meth_id", "var_id"], "left_anti").select("combo_id", "meth_id", "var_id", "var_val").unionByName(long)


def pivot_params(store: DataFrame, variables: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per set with a column a parameter name."""
    return store.join(variables.select("var_id", "var_name"), "var_id").groupBy("combo_id").pivot("var_name", list(names)).agg(F.first("var_val"))


def trim_params(combos: DataFrame, images: DataFrame, days: float, gap: tuple | None = None) -> DataFrame:
    """Sets to drop: mean date within `days` of their instrument's first or last image, or in a given gap."""
    ends = images.groupBy("instrument").agg(F.min("date_obs").alias("__a"), F.max("date_obs").alias("__z"))
    us, span = (lambda c: F.unix_micros(F.col(c).cast("timestamp"))), round(days * 86_400e6)
    edge = (us("date_mean") < us("__a") + span) | (us("date_mean") > us("__z") - span)
    if gap is not None:
        edge = edge | F.col("date_mean").between(F.lit(gap[0]), F.lit(gap[1]))
    return combos.join(ends, "instrument").where(edge).select("combo_id")


def set_map_methods(maps: DataFrame, map_vars: DataFrame, map_ids: DataFrame, meth_combo_id: int, new_vars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(maps, parameters) with the method set of some maps replaced and their new parameters added."""
    named = maps.join(map_ids.select("map_id", F.lit(True).alias("__x")).distinct(), "map_id", "left")
    out = named.withColumn("meth_combo_id", F.when(F.col("__x"), F.lit(meth_combo_id).cast("long")).otherwise(F.col("meth_combo_id"))).select(maps.columns)
    key = ["map_id", "combo_id", "var_id"]
    return out, map_vars.join(new_vars, key, "left_anti").select(map_vars.columns).unionByName(new_vars.select(map_vars.columns))


def training_pixels(images: DataFrame, masks: DataFrame, scaling: DataFrame, keys: Sequence[str] = ("data_id", "iy", "ix")) -> DataFrame:
    """Scaled image and mask pixels side by side (S17): keys, instrument, ts, value, mask.

    images: keys, instrument, ts, value (log intensity); masks: keys, hole; scaling: instrument, alpha, x, a table of
    parameters; an instrument without them stays as it is.
    """
    par = F.broadcast(scaling.select("instrument", "alpha", "x"))  # one row an instrument
    got = images.join(masks.select(*keys, F.col("hole").alias("mask")), list(keys)).join(par, "instrument", "left")
    value = F.coalesce(F.col("alpha") * F.col("value") + F.col("x"), F.col("value"))
    return got.select(*keys, "instrument", "ts", value.alias("value"), "mask")


def export_training(pixels: DataFrame, path: str, time: str = "ts") -> None:
    """Training pixels as Parquet by instrument and day; days written again replace theirs."""
    pixels.withColumn("day", F.to_date(time)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("instrument", "day").parquet(path)
