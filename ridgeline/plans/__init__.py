"""Queries over a folder's tables, and the same as SQL for another engine."""

from ridgeline.plans import catalog, classic, field, imaging, live, overlay, photo, pose, records, scene, store

_MODULES = (scene, records, imaging, live, classic, catalog, overlay, field, photo, pose, store)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
