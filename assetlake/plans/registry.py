"""Importing this module registers every query."""

from assetlake.plans import (  # noqa: F401
    catalog_queries, function_queries, integrity_queries, layout_queries, publication_queries, relation_queries,
    source_queries, stream_queries,
)
from assetlake.plans.bound import ORACLES, QUERIES  # noqa: F401
