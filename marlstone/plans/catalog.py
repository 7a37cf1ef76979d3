"""Imports every module of queries, so that the registry is full."""

from __future__ import annotations

from marlstone.plans import documents, extras, graph, ingest, more, registry, retrieval, upkeep  # noqa: F401

QUERIES, ORACLES, FLAGSHIP = registry.QUERIES, registry.ORACLES, registry.FLAGSHIP
