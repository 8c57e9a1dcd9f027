"""All queries of the library."""

from __future__ import annotations

from . import aggregate_queries, building_queries, carving_queries, format_queries, iterative_oracles, join_queries, mesh_queries, more_queries, point_queries, shape_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

#: Columns that DuckDB's literals make decimals or wider integers, with the types that the queries return.
_TYPES = {
    "a09_a15_wall_cells": {"z_max": "DOUBLE"},
    "a18_histogram": {"centre": "DOUBLE"},
    "a20_mode": {"mode": "DOUBLE"},
    "f19_f20_range_scan": {"good": "BIGINT"},
    "f22_zoned_noise": {"sigma": "DOUBLE"},
    "j04_j10_clock": {"s": "DOUBLE"},
    "t06_t10_parse_ranges": {"n": "INTEGER"},
    "x15_x16_planes": {"x": "DOUBLE", "z": "DOUBLE"},
    "x28_x31_polygons": {"area": "DOUBLE"},
    "x32_x40_rigid": {"x": "DOUBLE"},
    "x35_x36_attitude": {"east": "DOUBLE", "up": "DOUBLE"},
    "x57_x59_text": {"f": "DOUBLE"},
    "x67_three_planes": {"x": "DOUBLE", "z": "DOUBLE"},
    "x79_window_corners": {"x": "DOUBLE", "z": "DOUBLE"},
}
for _name, _columns in _TYPES.items():
    _casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in _columns.items())
    ORACLES[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLES[_name]})"
