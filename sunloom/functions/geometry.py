"""Sphere and image-plane geometry. Angles in radians unless a name says degrees."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

TURN = 2 * pi


def to_spherical(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """(r, theta, phi) with phi in [0, 2 pi); the origin has theta 0 (M1)."""
    r = F.sqrt(x * x + y * y + z * z)
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(r > 0, z / r).otherwise(1.0)))
    return r, F.acos(cos), F.pmod(F.atan2(y, x), F.lit(TURN))


def to_cartesian(theta: Column, phi: Column, r: Column | float = 1.0) -> tuple[Column, Column, Column]:
    r = r if isinstance(r, Column) else F.lit(float(r))
    return r * F.sin(theta) * F.cos(phi), r * F.sin(theta) * F.sin(phi), r * F.cos(theta)


def arc_of_chord(d: Column) -> Column:
    """Arc length on the unit sphere of a chord (M2)."""
    return 2 * F.asin(F.least(F.lit(1.0), d / 2))


def haversine(theta1: Column, phi1: Column, theta2: Column, phi2: Column) -> Column:
    """Arc between two points given by colatitude and longitude (M2)."""
    a = F.pow(F.sin((theta2 - theta1) / 2), 2) + F.sin(theta1) * F.sin(theta2) * F.pow(F.sin((phi2 - phi1) / 2), 2)
    return 2 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def chord(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Straight distance of two points of the unit sphere, each (theta, phi)."""
    return F.sqrt(sum(F.pow(p - q, 2) for p, q in zip(to_cartesian(*a), to_cartesian(*b), strict=True)))


def map_to_image(phi: Column, sinlat: Column, lon_deg: Column, lat_deg: Column, roll_deg: Column, r0: float = 1.0) -> tuple[Column, Column, Column]:
    """Image (x right, y up, z to the observer) of a map point seen from Carrington (lon, lat), then rolled (M3)."""
    cos_lat = F.sqrt(F.greatest(F.lit(0.0), 1 - sinlat * sinlat))
    turn, tilt, roll = phi - F.radians(lon_deg), F.radians(lat_deg), F.radians(roll_deg)
    east, front = r0 * cos_lat * F.sin(turn), r0 * cos_lat * F.cos(turn)
    up = r0 * sinlat
    y, z = up * F.cos(tilt) - front * F.sin(tilt), up * F.sin(tilt) + front * F.cos(tilt)
    return east * F.cos(roll) + y * F.sin(roll), y * F.cos(roll) - east * F.sin(roll), z


def image_to_map(x: Column, y: Column, lon_deg: Column, lat_deg: Column, roll_deg: Column, r0: float = 1.0) -> tuple[Column, Column, Column]:
    """(phi in [0, 2 pi), sin latitude, mu) of an image point; nulls off the disk (M3)."""
    on = x * x + y * y <= r0 * r0
    z = F.when(on, F.sqrt(r0 * r0 - (x * x + y * y)))
    roll, tilt = F.radians(roll_deg), F.radians(lat_deg)
    east, up = x * F.cos(roll) - y * F.sin(roll), x * F.sin(roll) + y * F.cos(roll)
    north, front = up * F.cos(tilt) + z * F.sin(tilt), z * F.cos(tilt) - up * F.sin(tilt)
    sinlat = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), north / r0))
    return F.when(on, F.pmod(F.atan2(east, front) + F.radians(lon_deg), F.lit(TURN))), F.when(on, sinlat), z / r0


def perspective_scale(mu: Column, r0: float, distance: Column | float) -> Column:
    """What image x and y grow by if the observer stands at a finite distance (M4)."""
    d = distance if isinstance(distance, Column) else F.lit(float(distance))
    return 1 / (1 - mu * r0 / d)


def apparent_radius_scale(mu: Column, sin_radius: float = 0.004660, cos_radius: float = 0.99998914) -> Column:
    """The same from the apparent radius of the disk (M4)."""
    return cos_radius / (1 - mu * sin_radius)


def radial_field(los: Column, mu: Column, floor: float = 0.01) -> Column:
    """Radial field of a line-of-sight one (M5)."""
    return los / F.greatest(mu, F.lit(floor))


def cell_area(theta: Column, d_theta: Column, d_phi: Column) -> Column:
    """Area of a map cell; a pole row is taken a quarter cell inside."""
    quarter = d_theta / 4
    inside = F.when(F.abs(theta) < 1e-9, theta + quarter).when(F.abs(theta - pi) < 1e-9, theta - quarter).otherwise(theta)
    return F.sin(inside) * d_theta * d_phi


def gauss_longitude(lon: Column, lon0: Column, fwhm: float = 10.0) -> Column:
    """Gaussian weight of a longitude."""
    sigma = fwhm / 2.3548200450309493
    return F.exp(-F.pow((lon - lon0) / sigma, 2) / 2) / (sigma * TURN**0.5)


def overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Length that two intervals share (M13 divides it by a cell's width)."""
    return F.greatest(F.lit(0.0), F.least(hi1, hi2) - F.greatest(lo1, lo2))
