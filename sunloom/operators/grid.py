"""Grids: mesh axes, projection of images to maps, resampling, point sources."""

from __future__ import annotations

from collections.abc import Sequence
from math import log, pi, sqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import TURN, arc_of_chord, chord, haversine, map_to_image, to_cartesian, to_spherical
from ..plans.asof import bucketed_range_join
from ..plans.tables import table


def mesh_axis(axis: DataFrame, periodic: bool = False, period: float = TURN, by: Sequence[str] = ("axis",)) -> DataFrame:
    """(by, i, coord) with `half` (middle to the next), `lower`, `upper` edges and `width` of each cell.

    End cells are half cells; periodic: they reach over the seam, where first and last coordinate are one period apart
    less a cell.
    """
    w = Window.partitionBy(*by).orderBy("i")
    nxt, prev = F.lead("coord").over(w), F.lag("coord").over(w)
    every = Window.partitionBy(*by)
    first, last = F.min("coord").over(every), F.max("coord").over(every)
    over = F.when(prev.isNull(), last - period), F.when(nxt.isNull(), first + period)
    before = F.coalesce(prev, over[0]) if periodic else prev
    after = F.coalesce(nxt, over[1]) if periodic else nxt
    out = axis.withColumns({"half": (F.col("coord") + nxt) / 2, "lower": F.coalesce((F.col("coord") + before) / 2, F.col("coord")), "upper": F.coalesce((F.col("coord") + after) / 2, F.col("coord"))})
    return out.withColumn("width", F.col("upper") - F.col("lower"))


def axis_overlaps(spark: SparkSession, old: Sequence[float], new: Sequence[float], names: tuple[str, str]) -> DataFrame:
    """(old index, new index, share of the new cell) of overlapping cells of two lists of edges."""
    rows, j = [], 0
    for k in range(len(new) - 1):
        while j > 0 and old[j] > new[k]:
            j -= 1
        for i in range(j, len(old) - 1):
            shared = min(old[i + 1], new[k + 1]) - max(old[i], new[k])
            if shared > 0:
                rows.append((i, k, shared / (new[k + 1] - new[k])))
                j = i
            elif old[i] >= new[k + 1]:
                break
    return spark.createDataFrame(rows, f"{names[0]} int, {names[1]} int, w double")


def resample(px: DataFrame, old_x: Sequence[float], old_y: Sequence[float], new_x: Sequence[float], new_y: Sequence[float], by: Sequence[str] = ("map_id",), values: Sequence[str] = ("data",), least_area: float = 0.5) -> DataFrame:
    """Conservative resampling to another grid, given by cell edges, rows first and columns then.

    A new cell is null where less than least_area of it has data, else the area-weighted mean of what has. The axis
    tables hold one row per pair of overlapping cells of an axis, so they grow with the grid, not with the maps.
    """
    spark = px.sparkSession
    ys = F.broadcast(axis_overlaps(spark, old_y, new_y, ("iy", "ny")))
    xs = F.broadcast(axis_overlaps(spark, old_x, new_x, ("ix", "nx")))
    w = F.col("w")
    step = px.join(ys, "iy").groupBy(*by, F.col("ny"), "ix").agg(*[F.sum(w * F.col(v)).alias(f"s_{v}") for v in values], *[F.sum(F.when(F.col(v).isNotNull(), w)).alias(f"a_{v}") for v in values])
    full = step.join(xs, "ix").groupBy(*by, F.col("ny").alias("iy"), F.col("nx").alias("ix")).agg(*[F.sum(w * F.col(f"s_{v}")).alias(f"s_{v}") for v in values], *[F.sum(w * F.col(f"a_{v}")).alias(f"a_{v}") for v in values])
    return full.select(*by, "iy", "ix", *[F.when(F.col(f"a_{v}") >= least_area, F.col(f"s_{v}") / F.col(f"a_{v}")).alias(v) for v in values])


def average_poles(px: DataFrame, last_row: int, by: Sequence[str] = ("map_id",), value: str = "data") -> DataFrame:
    """First and last row replaced by their means."""
    means = px.where(F.col("iy").isin(0, last_row)).groupBy(*by, "iy").agg(F.avg(value).alias("__m"))
    return px.join(means, [*by, "iy"], "left").withColumn(value, F.coalesce("__m", value)).drop("__m")


def average_seam(px: DataFrame, last_col: int, left_width: float, right_width: float, by: Sequence[str] = ("map_id",), value: str = "data") -> DataFrame:
    """First and last column replaced by their width-weighted mean; a side without data takes the other's."""
    w = F.when(F.col("ix") == 0, left_width).otherwise(right_width)
    has = F.col(value).isNotNull()
    means = px.where(F.col("ix").isin(0, last_col)).groupBy(*by, "iy").agg((F.sum(w * F.col(value)) / F.sum(F.when(has, w))).alias("__m"))
    edge = F.col("ix").isin(0, last_col)
    return px.join(means, [*by, "iy"], "left").withColumn(value, F.when(edge, F.col("__m")).otherwise(F.col(value))).drop("__m")


def project_image(px: DataFrame, grid: DataFrame, observers: DataFrame, x0: float, dx: float, y0: float, dy: float, value: str = "data", r0: float = 1.0, distance: float | None = None) -> DataFrame:
    """Images sampled at the cells of a map grid, bilinearly (J11): data_id, iy, ix, data, mu, origin_image.

    grid: iy, ix, phi, sinlat. observers: data_id, cr_lon, cr_lat, crota2 in degrees, one row an image. px: regular
    axes x0 + ix * dx, y0 + iy * dy. Cells behind the limb have null mu and data (distance: the limb as seen from
    there), and so has a cell one of whose four pixels is missing. Each cell asks for four pixels by an equi-join.
    """
    cells = grid.crossJoin(observers)  # the result has a row for each cell and image
    x, y, z = map_to_image(F.col("phi"), F.col("sinlat"), F.col("cr_lon"), F.col("cr_lat"), F.col("crota2"), r0)
    limb = 0.0 if distance is None else r0 * r0 / distance
    scale = F.lit(1.0) if distance is None else 1 / (1 - z / distance)
    cells = cells.select("data_id", "iy", "ix", x.alias("x"), y.alias("y"), z.alias("z")).withColumn("__s", scale.cast("double") if distance is None else 1 / (1 - F.col("z") / distance))
    front = cells.where(F.col("z") > limb).select("data_id", "iy", "ix", (F.col("z") / r0).alias("mu"), ((F.col("x") * F.col("__s") - x0) / dx).alias("fx"), ((F.col("y") * F.col("__s") - y0) / dy).alias("fy"))
    front = front.withColumns({"jx": F.floor("fx").cast("int"), "jy": F.floor("fy").cast("int")})
    u, v = F.col("fx") - F.col("jx"), F.col("fy") - F.col("jy")
    corners = F.array(*[F.struct((F.col("jy") + b).alias("py"), (F.col("jx") + a).alias("px"), ((u if a else 1 - u) * (v if b else 1 - v)).alias("w")) for b in (0, 1) for a in (0, 1)])
    ask = front.select("data_id", "iy", "ix", "mu", F.explode(corners).alias("c")).select("data_id", "iy", "ix", "mu", F.col("c.py").alias("py"), F.col("c.px").alias("px"), F.col("c.w").alias("w")).where("w > 0")
    have = px.select("data_id", F.col("iy").alias("py"), F.col("ix").alias("px"), F.col(value).alias("__v"))
    got = ask.join(have, ["data_id", "py", "px"], "left").groupBy("data_id", "iy", "ix", "mu").agg(F.sum(F.col("w") * F.col("__v")).alias("s"), F.min(F.col("__v").isNotNull()).alias("all"))
    data = F.when(F.col("all"), F.col("s"))
    return got.select("data_id", "iy", "ix", data.alias("data"), "mu", F.when(data.isNotNull(), F.col("data_id")).alias("origin_image"))


def quality_map(px: DataFrame, images: DataFrame, holes_only: bool = False) -> DataFrame:
    """Each pixel's origin image as its instrument, with its mu; null without data, or (holes_only) where chd < 0.5."""
    seen = F.col("data").isNotNull() & (F.lit(True) if not holes_only else F.coalesce(F.col("chd") >= 0.5, F.lit(False)))
    named = px.join(images.select(F.col("data_id").alias("origin_image"), F.col("instrument").alias("__inst")), "origin_image", "left")
    return named.select("map_id", "iy", "ix", F.when(seen, F.col("__inst")).alias("instrument"), F.when(seen & F.col("__inst").isNotNull(), F.col("mu")).alias("mu"))


def reproject_polar(px: DataFrame, n_theta: int, n_phi: int, inverse: bool = False, by: Sequence[str] = ("map_id",), value: str = "data") -> DataFrame:
    """A longitude-colatitude raster turned by 90 degrees about the x axis, nearest pixel.

    Rows are theta = (iy + 0.5) * pi / n_theta, columns phi = (ix + 0.5) * 2 pi / n_phi.
    """
    grid = px.select(*by).distinct().withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(n_theta - 1)))).withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(n_phi - 1))))
    x, y, z = to_cartesian((F.col("iy") + 0.5) * (pi / n_theta), (F.col("ix") + 0.5) * (TURN / n_phi))
    _, theta, phi = to_spherical(x, z if inverse else -z, -y if inverse else y)
    ask = grid.withColumns({"__y": F.least(F.floor(F.round(theta / (pi / n_theta), 9)), F.lit(n_theta - 1)).cast("int"), "__x": (F.floor(F.round(phi / (TURN / n_phi), 9)) % n_phi).cast("int")})
    have = px.select(*by, F.col("iy").cast("int").alias("__y"), F.col("ix").cast("int").alias("__x"), F.col(value))
    return ask.join(have, [*by, "__y", "__x"], "left").select(*by, "iy", "ix", value)


def _tiles(theta: Column, phi: Column, reach: Column, size: Column) -> tuple[Column, Column]:
    """Rows and columns of the tiles of a size that a disk touches; near a pole all columns."""
    rows, cols = F.ceil(pi / size), _columns(size)
    top = F.greatest(F.floor((theta - reach) / size), F.lit(0)).cast("int")
    low = F.least(F.floor((theta + reach) / size), rows).cast("int")
    flat = F.least(F.sin(F.greatest(theta - reach, F.lit(0.0))), F.sin(F.least(theta + reach, F.lit(pi))))
    wide = F.when((theta - reach <= 0) | (theta + reach >= pi), pi).otherwise(F.least(F.lit(pi), 1.6 * reach / flat))
    a, b = F.floor((phi - wide) / (TURN / cols)).cast("int"), F.floor((phi + wide) / (TURN / cols)).cast("int")
    return F.sequence(top, low), F.transform(F.sequence(a, F.least(b, a + cols - 1)), lambda c: F.pmod(c, cols))


def _columns(size: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(TURN / size)).cast("int")


#: Fixed value: full width at half maximum of a Gaussian over its sigma.
FWHM = 2 * sqrt(2 * log(2))


def _spacing(points: DataFrame, axis: DataFrame, at: str, out: str) -> DataFrame:
    """points with the width of an axis' cells (coord, width) at a coordinate, linear between cells, flat beyond them."""
    w = Window.orderBy("coord")  # as many rows as an axis has
    seg = axis.select("coord", "width").withColumns({"__to": F.lead("coord").over(w), "__w": F.lead("width").over(w)})
    ends = axis.agg(F.min("coord").alias("__a"), F.max("coord").alias("__z"), F.count("*").alias("__n"))
    a, z, n = ends.first()
    if n < 2:
        return points.withColumn(out, F.lit(axis.first()["width"]))
    held = points.withColumn("__at", F.greatest(F.lit(a), F.least(F.lit(z), F.col(at))))
    seg = seg.where("__to IS NOT NULL").withColumnsRenamed({"coord": "__from", "width": "__v"})
    met = bucketed_range_join(held, seg, "__at", "__from", "__to", (z - a) / (n - 1))
    met = met.where((F.col("__at") < F.col("__to")) | (F.col("__to") == z))
    share = (F.col("__at") - F.col("__from")) / (F.col("__to") - F.col("__from"))
    return met.withColumn(out, F.col("__v") + (F.col("__w") - F.col("__v")) * share).drop("__at", "__from", "__to", "__v", "__w")


def point_widths(points: DataFrame, style: str = "adaptive", theta_axis: DataFrame | None = None, phi_axis: DataFrame | None = None, neighbors: int = 10, mesh_factor: float = 2.0, arc_factor: float = 2.0, fixed: float = 0.04, pole: float = 0.08, equator: float = 0.06, cell: float = 0.25) -> DataFrame:
    """points (point_id, theta, phi, ...) with `sigma` of the Gaussian that each is spread as.

    Widths at half maximum by style: fixed; smooth, from equator to pole with the squared cosine of colatitude; local,
    mesh_factor times the diagonal of the mesh cell there (axes: coord, width, as mesh_axis gives them; the diagonal has
    the sine of colatitude once); adaptive, that or arc_factor times the arc to the neighbors-th nearest point, whichever
    is more (J16).
    """
    if style == "fixed":
        return points.withColumn("sigma", F.lit(fixed / FWHM))
    if style == "smooth":
        return points.withColumn("sigma", ((pole - equator) * F.pow(F.cos("theta"), 2) + equator) / FWHM)
    if style not in ("local", "adaptive"):
        raise ValueError(f"unknown style {style}")
    there = _spacing(_spacing(points, theta_axis, "theta", "__dt"), phi_axis, "phi", "__dp")
    width = mesh_factor * F.sqrt(F.col("__dt") * F.col("__dt") + F.sin("theta") * F.col("__dp") * F.col("__dp"))
    if style == "adaptive":
        there = there.join(kth_neighbor(points.select("point_id", "theta", "phi"), neighbors, cell), "point_id")
        width = F.greatest(width, arc_factor * F.col("distance"))
    return there.withColumn("sigma", width / FWHM).select(*points.columns, "sigma")


def project_points(points: DataFrame, mesh: DataFrame, sigma: float | None = None, n_trunc: float = 4.0, finest: float = 1e-3) -> DataFrame:
    """Flux points spread over mesh cells as Gaussians in arc length, truncated at n_trunc sigma.

    points: point_id, theta, phi, flux, and sigma if it varies (point_widths). mesh: iy, ix, theta, phi, da. Each point's
    cells are normalised so that its flux is kept; points without flux, or with no cell in reach, add nothing. Points
    meet cells through tiles: of a hierarchy whose sizes double from the finest, each point uses the level of its reach,
    so a few wide points do not widen the tiles of all.
    """
    p = points.where("flux <> 0")
    p = p if sigma is None else p.withColumn("sigma", F.lit(float(sigma)))
    reach = n_trunc * F.col("sigma")
    p = table(p.select("point_id", F.col("theta").alias("__t"), F.col("phi").alias("__p"), "flux", "sigma", F.greatest(F.lit(0), F.ceil(F.log2(reach / finest))).cast("int").alias("__level")), "points")
    levels = sorted(r["__level"] for r in p.select("__level").distinct().collect())  # a few: sizes double up to the sphere
    size = finest * F.pow(F.lit(2.0), F.col("__level"))
    down, across = _tiles(F.col("__t"), F.col("__p"), n_trunc * F.col("sigma"), size)
    p = p.select("*", F.explode(down).alias("__row"), across.alias("__cols")).select("*", F.explode("__cols").alias("__col")).drop("__cols")
    m = mesh.withColumn("__level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    m = m.withColumns({"__row": F.floor(F.col("theta") / size).cast("int"), "__col": F.pmod(F.floor(F.col("phi") / (TURN / _columns(size))).cast("int"), _columns(size))})
    arc = haversine(F.col("__t"), F.col("__p"), F.col("theta"), F.col("phi"))
    near = p.join(m, ["__level", "__row", "__col"]).withColumn("__arc", arc).where(F.col("__arc") <= n_trunc * F.col("sigma"))
    g = F.exp(-F.pow(F.col("__arc") / F.col("sigma"), 2) / 2)
    total = F.sum(F.col("__g") * F.col("da")).over(Window.partitionBy("point_id"))
    near = near.withColumn("__g", g).withColumn("__b", F.col("flux") * F.col("__g") / total)
    return near.groupBy("iy", "ix").agg(F.sum("__b").alias("br"))


def kth_neighbor(points: DataFrame, k: int, cell: float = 0.25, key: str = "point_id") -> DataFrame:
    """(key, distance): arc to the k-th nearest other point (J16), null with fewer than k others.

    Points of one place are one row with their number. Places meet through cubes of the unit ball: neighbours within a
    cube's width are all in the 27 cubes around. The first width is `cell`, or less: what gives a place about 2 k others
    if they are spread evenly, and then a quarter as long as a cube holds many more. What lacks k others within the width
    is asked again with four times the width, until that is the ball's; a round's places have few others within a quarter
    of its width, so pairs grow as places.
    """
    x, y, z = to_cartesian(F.col("theta"), F.col("phi"))
    pts = table(points.select(key, "theta", "phi"), "neighbor_points")
    had = pts.where("theta IS NOT NULL AND phi IS NOT NULL AND NOT isnan(theta) AND NOT isnan(phi)").groupBy("theta", "phi")
    have = table(had.agg(F.min(key).alias("__k"), F.count("*").alias("__m")).withColumns({"__x": x, "__y": y, "__z": z}), "neighbor_places")
    cube = lambda width: {f"__c{c}": F.floor(F.col(f"__{c}") / width).cast("int") for c in "xyz"}
    cell = min(cell, max(1e-9, (8 * k / max(1, have.count())) ** 0.5))
    while cell >= 4e-9 and (have.groupBy(*cube(cell).values()).count().agg(F.max("count")).first()[0] or 0) > 64 + 8 * k:
        cell /= 4
    done = have.where(F.col("__m") > k).select("__k", F.lit(0.0).alias("distance"))
    todo = have.where(F.col("__m") <= k)
    around = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("abc", (a, b, c), strict=True)]) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    d = chord((F.col("__t"), F.col("__p")), (F.col("theta"), F.col("phi")))
    while True:
        ask = todo.withColumns(cube(cell)).select(F.col("__k").alias("__asks"), F.col("theta").alias("__t"), F.col("phi").alias("__p"), "__cx", "__cy", "__cz", F.explode(around).alias("__o"))
        ask = ask.select("__asks", "__t", "__p", *[(F.col(f"__c{c}") + F.col(f"__o.{o}")).alias(f"__c{c}") for c, o in zip("xyz", "abc", strict=True)])
        own = have.withColumns(cube(cell)).select("__k", "__m", "theta", "phi", "__cx", "__cy", "__cz")
        near = ask.join(own, ["__cx", "__cy", "__cz"]).select("__asks", d.alias("__d"), (F.col("__m") - (F.col("__asks") == F.col("__k")).cast("int")).alias("__m"))
        near = near if cell >= 2 else near.where(F.col("__d") <= cell * (1 - 1e-9) - 1e-15)
        upto = F.sum("__m").over(Window.partitionBy("__asks").orderBy("__d").rowsBetween(Window.unboundedPreceding, 0))
        got = near.withColumn("__n", upto).where((F.col("__n") >= k) & (F.col("__n") - F.col("__m") < k))
        got = table(got.select(F.col("__asks").alias("__k"), arc_of_chord(F.col("__d")).alias("distance")), "neighbor_found")
        done = done.unionByName(got)
        todo = table(todo.join(got.select("__k"), "__k", "left_anti"), "neighbor_todo")
        if cell >= 2 or todo.isEmpty():
            break
        cell *= 4
    return pts.join(done.join(have.select("__k", "theta", "phi"), "__k"), ["theta", "phi"], "left").select(key, "distance")
