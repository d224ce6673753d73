"""Catalog queries: filters by time, rotation, instrument, flag and set membership."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import HOUR, micros


def image_catalog(images: DataFrame, files: DataFrame) -> DataFrame:
    """Images with their files' columns, by instrument and date."""
    extra = [c for c in files.columns if c == "data_id" or c not in images.columns]
    return images.join(files.select(extra), "data_id").orderBy("instrument", "date_obs")


def _all(conditions: Sequence[Column | None]) -> Column:
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def _between(col: str, lo, hi) -> Column | None:
    """lo <= col <= hi; both bounds or none."""
    if (lo is None) != (hi is None):
        raise ValueError("a range needs both bounds")
    return None if lo is None else F.col(col).between(F.lit(lo), F.lit(hi))


def _among(col: str, values: Sequence | None) -> Column | None:
    return None if values is None else F.col(col).isin(list(values))


def query_images(cat: DataFrame, start=None, end=None, instruments=None, wavelengths=None, flag: int | None = 0, compat_unfiltered: bool = False) -> DataFrame:
    """Images in a time range, both ends in (F1). Every filter that is given holds; compat_unfiltered: without a time
    range none does."""
    if compat_unfiltered and start is None and end is None:
        return cat
    has = [_between("date_obs", start, end), _among("instrument", instruments), _among("wavelength", wavelengths)]
    return cat.where(_all([*has, None if flag is None else F.col("flag") == flag]))


def query_images_rotation(cat: DataFrame, first: float, last: float, instruments=None, wavelengths=None, flag: int = 0) -> DataFrame:
    """Images in a range of decimal rotations, by instrument and rotation (F2)."""
    has = [_between("cr_rot", first, last), _among("instrument", instruments), _among("wavelength", wavelengths), F.col("flag") == flag]
    return cat.where(_all(has)).orderBy("instrument", "cr_rot")


def query_files(files: DataFrame, start=None, end=None, types=None, providers=None, flag: int = 0) -> DataFrame:
    """Files by time, type and provider, in that order of type, provider and date."""
    has = [_between("date_obs", start, end), _among("type", types), _among("provider", providers), F.col("flag") == flag]
    return files.where(_all(has)).orderBy("type", "provider", "date_obs")


def query_hists(hists: DataFrame, meth_id: int, n_mu: int | None = None, n_int: int | None = None, lat_band: float | None = None, start=None, end=None, instruments=None, wavelengths=None, tolerance: float = 1e-4) -> DataFrame:
    """Histograms of a method and binning; without times everything of the store.

    A latitude band matches within a relative tolerance. n_mu None: any binning if instruments are given, else only
    histograms without mu bins.
    """
    if start is None and end is None:
        return hists
    mu = F.col("n_mu_bins") == n_mu if n_mu is not None else None if instruments is not None else F.col("n_mu_bins").isNull()
    band = None if lat_band is None else F.abs(F.col("lat_band") - lat_band) <= tolerance * abs(lat_band)
    has = [F.col("meth_id") == meth_id, mu, None if n_int is None else F.col("n_intensity_bins") == n_int, band]
    return hists.where(_all([*has, _between("date_obs", start, end), _among("instrument", instruments), _among("wavelength", wavelengths)]))


def query_combos(combos: DataFrame, methods: DataFrame, method: str, start=None, end=None, instrument: str | None = "any") -> DataFrame:
    """Image sets of a named method by mean date; instrument None: sets without one."""
    of = methods.where(F.col("meth_name") == method).select("meth_id")
    inst = None if instrument == "any" else F.col("instrument").eqNullSafe(F.lit(instrument).cast("string"))
    return combos.join(of, "meth_id", "left_semi").where(_all([_between("date_mean", start, end), inst]))


def high_water(df: DataFrame, col: str, by: Sequence[str] = (), least: bool = False) -> DataFrame:
    """Greatest (or least) value of a column, per group."""
    return df.groupBy(*by).agg((F.min if least else F.max)(col).alias(col))


def unprocessed(files: DataFrame, kind: str = "EUV_Image") -> DataFrame:
    """Files without a processed file, unflagged, by date."""
    blank = F.col("fname_hdf").isNull() | (F.trim("fname_hdf") == "")
    return files.where(blank & (F.col("flag") == 0) & (F.col("type") == kind)).orderBy("date_obs")


def query_rotation(cat: DataFrame, around, instrument: str | None = None, half: float = 0.5) -> DataFrame:
    """Images within half a rotation of the image nearest to a time, sought within an hour of it (F8)."""
    gap = F.abs(micros(F.col("date_obs")) - micros(F.lit(around)))
    near = cat.where(gap <= HOUR)
    near = near if instrument is None else near.where(F.col("instrument") == instrument)
    centre = near.agg(F.min_by("cr_rot", F.struct(gap, "data_id")).alias("__cr"))  # one row
    return cat.join(F.broadcast(centre), F.col("cr_rot").between(F.col("__cr") - half, F.col("__cr") + half)).drop("__cr").orderBy("instrument", "cr_rot")


def mask_low(px: DataFrame, value: str = "data", least: float = 1.0) -> DataFrame:
    """Values under a limit become null."""
    return px.withColumn(value, F.when(F.col(value) >= least, F.col(value)))


def with_members(sets: DataFrame, members: DataFrame, key: str, member: str, wanted: Sequence, any: bool = False) -> DataFrame:
    """Sets that hold all (or any) of the wanted members: relational division."""
    hit = members.where(F.col(member).isin(list(wanted)))
    if not any:
        hit = hit.groupBy(key).agg(F.count_distinct(member).alias("n")).where(F.col("n") == len({*wanted}))
    return sets.join(hit.select(key), key, "left_semi")


def query_maps(maps: DataFrame, combos: DataFrame, members: DataFrame, images: DataFrame, method_members: DataFrame, methods: DataFrame, map_vars: DataFrame, variables: DataFrame, mean_range=None, span_range=None, n_images: int | None = None, image_ids=None, wavelengths=None, method_names=None, var_ranges: dict | None = None, any: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(map_info, data_info, method_info, image_assoc) of the maps for which all given predicates hold.

    mean_range or span_range is needed. span_range asks that a set's first or last date lie in it, so a set that
    covers the whole range doesn't match. Members, wavelengths and methods must all be present (any: one of them).
    """
    if mean_range is None and span_range is None:
        raise ValueError("mean_range or span_range is needed")
    sets = combos
    if mean_range is not None:
        sets = sets.where(F.col("date_mean").between(*map(F.lit, mean_range)))
    if span_range is not None:
        lo, hi = map(F.lit, span_range)
        sets = sets.where(F.col("date_min").between(lo, hi) | F.col("date_max").between(lo, hi))
    if n_images is not None:
        sets = sets.where(F.col("n_images") == n_images)
    if image_ids is not None:
        sets = with_members(sets, members, "combo_id", "data_id", image_ids, any)
    if wavelengths is not None:
        seen = members.join(sets.select("combo_id"), "combo_id", "left_semi").join(images.select("data_id", "wavelength"), "data_id")
        sets = with_members(sets, seen, "combo_id", "wavelength", wavelengths, any)
    found = maps.join(sets.select("combo_id", "date_mean", "date_min", "date_max", "n_images"), "combo_id")
    if method_names is not None:
        named = method_members.join(methods.select("meth_id", "meth_name"), "meth_id")
        found = with_members(found, named, "meth_combo_id", "meth_name", method_names)
    for name, (lo, hi) in (var_ranges or {}).items():
        ids = variables.where(F.col("var_name") == name).select("var_id")
        ok = map_vars.join(ids, "var_id", "left_semi").where(F.col("var_val").between(lo, hi)).select("map_id")
        found = found.join(ok, "map_id", "left_semi")
    found = found.orderBy("date_mean")
    assoc = members.join(found.select("combo_id"), "combo_id", "left_semi")
    info = images.join(assoc.select("data_id"), "data_id", "left_semi")
    how = found.select("map_id", "meth_combo_id").join(method_members, "meth_combo_id").join(methods, "meth_id").join(map_vars.select("map_id", "meth_id", "var_id", "var_val"), ["map_id", "meth_id"], "left")
    return found, info, how, assoc


def match_sets(wanted: DataFrame, members: DataFrame, wanted_id: str, set_id: str, member: str) -> DataFrame:
    """Per wanted set, the one stored set with just its members, else null; more than one counts as none.

    Sets meet by their size and 128 bits of their members, not by each member that they share; the members of those that
    meet are then compared. Stored sets of one such name count as equal. A null member equals none.
    """
    w, m = wanted.select(wanted_id, member).distinct(), members.select(set_id, member).distinct()
    name = [F.count("*").alias("__n"), F.bit_xor(F.xxhash64(member)).alias("__h"), F.bit_xor(F.xxhash64(F.lit(1), member)).alias("__g"), F.count_if(F.col(member).isNull()).alias("__null")]
    n_w = w.groupBy(wanted_id).agg(*name)
    n_m = m.groupBy(set_id).agg(*name).where("__null = 0").groupBy("__n", "__h", "__g").agg(F.min(set_id).alias(set_id), F.count("*").alias("k")).where("k = 1").drop("k")
    met = n_w.where("__null = 0").join(n_m, ["__n", "__h", "__g"]).select(wanted_id, set_id, "__n")
    both = w.join(met, wanted_id).join(m, [set_id, member]).groupBy(wanted_id, set_id, "__n").agg(F.count("*").alias("n"))
    return n_w.select(wanted_id).join(both.where("n = __n").select(wanted_id, set_id), wanted_id, "left").select(wanted_id, set_id)


def summarize_sets(members: DataFrame, images: DataFrame, set_id: str = "combo_id", image_id: str = "data_id", date: str = "date_obs", instrument: str = "instrument") -> DataFrame:
    """Per set: n_images, first, last and mean date, and its instrument or MULTIPLE."""
    from ..functions.times import at_micros

    kinds = F.count_distinct(F.col(instrument))
    sums = members.select(set_id, image_id).join(images.select(image_id, date, instrument), image_id).groupBy(set_id).agg(
        F.count("*").alias("n_images"),
        F.min(date).alias("date_min"),
        F.max(date).alias("date_max"),
        F.sum(micros(F.col(date))).alias("__total"),
        F.count(date).alias("__n"),
        F.when(kinds == 1, F.min(instrument)).when(kinds > 1, "MULTIPLE").alias("instrument"),
    )
    mean = F.expr("(__total - pmod(__total, __n)) div __n")
    return sums.select(set_id, "n_images", "date_min", "date_max", at_micros(mean).alias("date_mean"), "instrument")


def missing(images: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Images that a store has nothing of."""
    return images.join(store.select(key).distinct(), key, "left_anti")
