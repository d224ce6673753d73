"""Limb, scaling and degradation corrections of intensities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cubic(p: Sequence[Column], mu: Column) -> tuple[Column, Column]:
    def pinned(a: Column, b: Column, c: Column) -> Column:
        return a * (mu - 1) + b * (mu * mu - 1) + c * (mu * mu * mu - 1)

    return 1 + pinned(*p[:3]), pinned(*p[3:6])


def _power_log(p: Sequence[Column], mu: Column) -> tuple[Column, Column]:
    return 1 + p[0] * (F.pow(mu, p[1]) - 1), p[2] * F.log10(mu)


def _theoretic(p: Sequence[Column], mu: Column) -> tuple[Column, Column]:
    f1, f0 = p[0] * (mu - 1) + p[1] * F.log10(mu), p[2] * (mu - 1) + p[3] * F.log10(mu)
    beta = p[4] / (f1 + p[4])
    return beta, (f1 * p[5] / p[4] - f0) * beta


LIMB_MODELS = {"cubic": (_cubic, 6), "power_log": (_power_log, 3), "theoretic": (_theoretic, 6)}


def limb_factors(model: str, params: Sequence[Column], mu: Column, floor: float = 0.1) -> tuple[Column, Column]:
    """(beta, y) at mu, which counts as at least floor; beta is 1 and y is 0 at mu = 1 (M6)."""
    return LIMB_MODELS[model][0](params, F.greatest(mu, F.lit(floor)))


def scale_log(value: Column, slope: Column, shift: Column, where: Column | None = None) -> Column:
    """10 ** (slope * log10(value) + shift) where asked (else the value); a value of 0 or less has no log: null (M7)."""
    out = F.when(value > 0, F.pow(F.lit(10.0), slope * F.log10(value) + shift))
    return out if where is None else F.when(where, out).otherwise(value)


def usable(mu: Column, value: Column, least: float = 2.0) -> Column:
    """Pixels that a limb correction applies to."""
    return F.coalesce((mu > 0) & (value > least), F.lit(False))


def detectable(mu: Column, scaled: Column) -> Column:
    """Pixels that a detection may use: on the disk, and with data."""
    return F.coalesce((mu > 0) & scaled.isNotNull(), F.lit(False))


def on_segment(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Linear through two points; one point or one abscissa alone gives its value."""
    slope = (y1 - y0) * ((x - x0) / (x1 - x0))
    return F.when(x0.isNull() | (x0 == x1), F.coalesce(y1, y0)).when(x1.isNull(), y0).otherwise(y0 + slope)
