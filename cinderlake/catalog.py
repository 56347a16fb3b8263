"""Every registered query by name, with the DuckDB SQL that its result is held against."""

from __future__ import annotations

from cinderlake.plans import fire_queries, incident_queries, layer_queries, order_queries, raster_queries, source_queries, stream_queries, view_queries

_modules = (incident_queries, fire_queries, raster_queries, source_queries, layer_queries, stream_queries, view_queries, order_queries)
QUERIES: dict = {name: q for m in _modules for name, q in m.query.queries.items()}
ORACLES: dict[str, str] = {name: q for m in _modules for name, q in m.query.oracles.items()}
FLAGSHIP = QUERIES["picture_order"]
