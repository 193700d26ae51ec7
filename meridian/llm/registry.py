"""Every query of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

MODULES = ("simhash", "quality", "decontaminate", "packing", "secret_scan", "language_id", "embedding_dedup", "html_extract", "substring_dedup", "lm_score", "centroids", "cut_packing", "divergence")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in MODULES:
    _m = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= getattr(_m, "ORACLE_SQL", {})
