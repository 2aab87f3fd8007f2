"""All queries of the engine proper with their SQL, gathered by family."""

from __future__ import annotations

from importlib import import_module

FAMILIES = (
    "siftline.operators.dedup",
    "siftline.sources.manifest",
    "siftline.operators.scalar_queries",
    "siftline.operators.labels",
    "siftline.operators.sampling",
    "siftline.operators.splits",
    "siftline.operators.grid",
    "siftline.operators.results",
    "siftline.operators.vectors",
    "siftline.operators.matching",
    "siftline.operators.losses",
    "siftline.streaming.state",
    "siftline.operators.images",
    "siftline.sources.archives",
    "siftline.sources.discovery",
    "siftline.sources.catalogs",
    "siftline.sources.features",
    "siftline.sources.pool",
)

QUERIES, ORACLES = {}, {}
for _name in FAMILIES:
    _family = import_module(_name)
    if _twice := QUERIES.keys() & _family.QUERIES.keys():
        raise ValueError(f"registered twice: {_twice}")
    QUERIES |= _family.QUERIES
    ORACLES |= _family.ORACLES
