"""Every query over the test tables, by name, with its DuckDB SQL."""

from __future__ import annotations

from framelake.plans import analytics, archive, crops, curation, keyframes, media, rasters, text, warehouse

MODULES = (curation, keyframes, warehouse, text, analytics, media, rasters, crops, archive)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
