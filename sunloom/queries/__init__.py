"""Registered queries of the library's own operators, with their DuckDB SQL where it can express them."""

from . import catalog, grids, hists, scalars, streams, tracks  # noqa: F401  each registers its queries
from .base import ORACLE_SQL, QUERIES
from .catalog import flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
