"""All registered queries of the library proper, gathered from the modules that hold them."""

from __future__ import annotations

from .queries import blocks, catalog, formats, network, peers, scalars, store, timeline  # noqa: F401
from .registry import QUERIES, SQL

FLAGSHIP = "search_bm25"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
