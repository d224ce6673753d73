"""Functional limb fits by damped least squares, all groups at once (A10).

A round moves every histogram by the parameters that its group tries, and gives its squared distance to the reference
with the derivatives by slope and shift: six numbers a histogram. Their sums by group are the normal matrix. A step that
brings a group closer is kept and damped less, one that does not is tried again damped more; a group leaves once its
steps or gains are small, or when it cannot go on, with the reason. Rounds are written tables.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.photometry import limb_factors
from ..plans.tables import table


def _slopes_at_ends(q: Sequence[Column]) -> list[Column]:
    """Cubic parameters from the derivatives at mu = 0 and 1 and the cubic terms, of beta and of y."""
    return [q[0], (q[1] - q[0] - 3 * q[2]) / 2, q[2], q[3], (q[4] - q[3] - 3 * q[5]) / 2, q[5]]


@dataclass(frozen=True)
class LimbModel:
    """A limb model as it is fitted: where the search starts, bounds, and the model's parameters from those searched."""

    name: str
    start: tuple[float, ...]
    least: tuple[float, ...] | None = None
    most: tuple[float, ...] | None = None
    unpack: Callable[[Sequence[Column]], list[Column]] = list


_INF = float("inf")
#: Starts of the searches. The cubic's beta may not rise and its y not fall at either end.
MODELS = {
    "cubic": LimbModel("cubic", (-1.0, 0.0, -0.4, 4.7, 1.0, 2.1), (-_INF, -_INF, -_INF, 0.0, 0.0, -_INF), (0.0, 0.0, _INF, _INF, _INF, _INF), _slopes_at_ends),
    "power_log": LimbModel("power_log", (0.93, -0.13, 0.6)),
    "theoretic": LimbModel("theoretic", (-0.05, -0.3, -0.01, 0.4, -1.0, 6.0)),
}


def _sums(batches: Iterator[pd.DataFrame], edges: np.ndarray, keys: list[str]) -> Iterator[pd.DataFrame]:
    """Of each row's histogram moved by beta and y, less the reference: sse, and sums of products of derivatives."""
    lo, m = edges[0], len(edges) - 1
    step = (edges[-1] - lo) / m
    for df in batches:
        if not len(df):
            continue
        share, ref = np.stack(df["__share"].to_numpy()), np.stack(df["__ref"].to_numpy())
        cdf = np.concatenate([np.zeros((len(df), 1)), share.cumsum(axis=1)], axis=1)
        beta, y = df["__beta"].to_numpy()[:, None], df["__y"].to_numpy()[:, None]
        with np.errstate(all="ignore"):
            u = (edges - y) / beta
            at = (u - lo) / step
        inside = (at > 0) & (at < m)
        at = np.clip(np.nan_to_num(at), 0, m)
        i = np.minimum(at.astype(int), m - 1)
        f = np.take_along_axis(share, i, axis=1)
        moved = np.take_along_axis(cdf, i, axis=1) + (at - i) * f
        f = np.where(inside, f / step, 0.0)
        r = np.diff(moved, axis=1) - ref
        b, c = np.diff(-f * u / beta, axis=1), np.diff(-f / beta, axis=1)
        out = df[keys].copy()
        for name, v in (("sse", r * r), ("bb", b * b), ("bc", b * c), ("cc", c * c), ("br", b * r), ("cr", c * r)):
            out[f"__{name}"] = v.sum(axis=1)
        yield out


def _moved_on(df: pd.DataFrame, model: LimbModel, gain: float, step: float) -> pd.DataFrame:
    """The state of each group after its tried parameters were scored, and what it tries next."""
    k = len(model.start)
    low = np.array(model.least or (-_INF,) * k)
    high = np.array(model.most or (_INF,) * k)
    rows = []
    for r in df.to_dict("records"):
        got = r["__got"] if r["__got"] is not None and np.isfinite(r["__got"]) else _INF
        best, tried = r["_best"], np.array(r["_tried"])
        lam, status = r["_lam"], ""
        if got < r["_sse"]:
            if np.isfinite(r["_sse"]) and r["_sse"] - got <= gain * r["_sse"]:
                status = "converged"
            best, sse, lam = tried, got, max(lam / 5, 1e-12)
            n, g = np.array(r["__n"]).reshape(k, k), np.array(r["__g"])
        elif best is None:
            rows.append(r | {"_status": "no start"})
            continue
        else:
            best, sse, lam = np.array(best), r["_sse"], lam * 4
            n, g = np.array(r["_n"]).reshape(k, k), np.array(r["_g"])
            if lam > 1e12:
                status = "stalled"
        free = ~(((best <= low) & (g > 0)) | ((best >= high) & (g < 0)))
        diag = np.diag(n)
        if not status and (diag[free] <= 1e-14 * max(diag.max(), 1e-300)).any():
            status = "singular"
        ask = best
        if not status:
            a = n[np.ix_(free, free)] + lam * np.diag(diag[free])
            move = np.zeros(k)
            move[free] = np.linalg.solve(a, -g[free])
            ask = np.clip(best + move, low, high)
            if np.abs(ask - best).max() <= step * (1 + np.abs(best).max()):
                status = "converged"
        rows.append(r | {"_best": best.tolist(), "_tried": ask.tolist(), "_sse": sse, "_lam": lam, "_n": n.ravel().tolist(), "_g": g.tolist(), "_rounds": r["_rounds"] + 1, "_status": status})
    return pd.DataFrame(rows, columns=df.columns)


def histogram_rows(bins: DataFrame, by: Sequence[str], bins_per_row: int, mu: str = "mu", index: str = "i_int", n: str = "share") -> DataFrame:
    """by, mu, __share and __ref: a histogram a row, but for the greatest mu's of each group, which is the reference of
    the others. Bins that are not there are 0."""
    zero = F.array_repeat(F.lit(0.0), bins_per_row)
    cells = F.map_from_entries(F.collect_list(F.struct(F.col(index).cast("int"), F.col(n).cast("double"))))
    rows = bins.groupBy(*by, mu).agg(cells.alias("__m")).withColumn("__share", F.transform(zero, lambda _, i: F.coalesce(F.element_at("__m", i.cast("int")), F.lit(0.0)))).drop("__m")
    ref = rows.groupBy(*by).agg(F.max(mu).alias("__last"), F.max_by("__share", mu).alias("__ref"))
    return rows.join(ref, list(by)).where(F.col(mu) < F.col("__last")).drop("__last")


def fit_limb(bins: DataFrame, edges: Sequence[float], model: str, by: Sequence[str], mu: str = "mu", index: str = "i_int", n: str = "share", gain: float = 1e-9, step: float = 1e-9, max_rounds: int = 200) -> DataFrame:
    """Limb parameters of each group: by, model, params (array), sse, seconds, rounds, status (A10).

    bins: by, mu, index, n, normalised by row of mu; the greatest mu is the reference. Parameters that move [2, 2.5] of
    the logarithm out of [0, 5] (A8), or have a slope that isn't positive, are not accepted. status: converged; stalled
    (no step helps); singular (a parameter has no influence, as without data); no start (the first parameters are not
    acceptable); limit (max_rounds). params are the best found, null with no start. seconds: from the begin of the fit
    until the group left.
    """
    spec, began, by = MODELS[model], time.monotonic(), list(by)
    k, spark = len(spec.start), bins.sparkSession
    at = np.array([float(e) for e in edges])
    hist = table(histogram_rows(bins, by, len(at) - 1, mu, index, n), "limb_rows")
    array = lambda v: F.array(*[F.lit(float(x)) for x in v])
    none = F.lit(None).cast("array<double>")
    state = hist.select(*by).distinct().withColumns({"_best": none, "_tried": array(spec.start), "_sse": F.lit(_INF), "_lam": F.lit(1e-3), "_n": none, "_g": none, "_rounds": F.lit(0), "_status": F.lit("")})
    state = table(state, "limb_state")
    shape = state.schema
    done: list[DataFrame] = []

    def factors(p: Sequence[Column]) -> tuple[Column, Column]:
        return limb_factors(model, spec.unpack(p), F.col(mu))

    p = [F.col("_tried")[i] for i in range(k)]
    h = [1e-6 * F.greatest(F.lit(1.0), F.abs(x)) for x in p]
    ends = [(factors([*p[:i], p[i] + h[i], *p[i + 1 :]]), factors([*p[:i], p[i] - h[i], *p[i + 1 :]])) for i in range(k)]
    db, dy = (F.array(*[(a[j] - b[j]) / (2 * s) for (a, b), s in zip(ends, h, strict=True)]) for j in (0, 1))
    beta, y = factors(p)
    u, v = [F.col("__db")[i] for i in range(k)], [F.col("__dy")[i] for i in range(k)]
    normal = [F.sum(F.col("__bb") * u[i] * u[j] + F.col("__bc") * (u[i] * v[j] + u[j] * v[i]) + F.col("__cc") * v[i] * v[j]) for i in range(k) for j in range(k)]
    down = [F.sum(F.col("__br") * u[i] + F.col("__cr") * v[i]) for i in range(k)]
    bad = (F.col("__beta") <= 0) | (F.col("__beta") < -F.col("__y") / 2) | (F.col("__beta") > (5 - F.col("__y")) / 2.5) | F.isnan("__beta") | F.isnan("__y") | F.col("__beta").isNull() | F.col("__y").isNull()
    for number in range(1, max_rounds + 1):
        rows = hist.join(state.select(*by, "_tried"), by).select(*by, "__share", "__ref", beta.alias("__beta"), y.alias("__y"), db.alias("__db"), dy.alias("__dy")).withColumn("__bad", bad)
        keys = [*by, "__bad", "__db", "__dy"]
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        scored = rows.mapInPandas(lambda it, keys=keys: _sums(it, at, keys), ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), *(f"__{c} double" for c in ("sse", "bb", "bc", "cc", "br", "cr"))]))
        total = scored.groupBy(*by).agg(F.when(F.max("__bad"), F.lit(_INF)).otherwise(F.sum("__sse")).alias("__got"), F.array(*normal).alias("__n"), F.array(*down).alias("__g"))
        both = state.join(total, by)
        moved = both.mapInPandas(lambda it: (_moved_on(df, spec, gain, step)[shape.names] for df in it if len(df)), shape)
        after = table(moved, "limb_state")
        left = after.where(F.lit(number == max_rounds) | (F.col("_status") != ""))
        n, going = after.agg(F.count_if(F.lit(number == max_rounds) | (F.col("_status") != "")), F.count_if(F.col("_status") == "")).first()
        if n:
            params = F.when(F.col("_best").isNotNull(), F.array(*spec.unpack([F.col("_best")[i] for i in range(k)])))
            done.append(left.select(*by, F.lit(model).alias("model"), params.alias("params"), F.when(F.col("_best").isNotNull(), F.col("_sse")).alias("sse"), F.lit(round(time.monotonic() - began, 3)).alias("seconds"),
                                    F.col("_rounds").alias("rounds"), F.when(F.col("_status") == "", "limit").otherwise(F.col("_status")).alias("status")))
        state = after.where("_status = ''")
        if not going or number == max_rounds:
            break
    empty = state.where(F.lit(False)).select(*by, F.lit(model).alias("model"), none.alias("params"), none[0].alias("sse"), F.lit(0.0).alias("seconds"), F.col("_rounds").alias("rounds"), F.lit("").alias("status"))
    return table(_union(done or [empty]), "limb_done")


def fit_limb_models(bins: DataFrame, edges: Sequence[float], by: Sequence[str], models: Sequence[str] = ("cubic", "power_log"), **options) -> DataFrame:
    """The fits of a constrained and a free model to the same histograms, a row a group and model (A10)."""
    return _union([fit_limb(bins, edges, m, by, **options) for m in models])


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
