"""The named queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import q_extra, q_journeys, q_maps, q_more, q_rings, q_routes, q_scalar, q_tables, q_terrain

FLAGSHIP = "tile_draw_list"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _m in (q_scalar, q_tables, q_maps, q_more, q_extra, q_journeys, q_routes, q_rings, q_terrain):
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
