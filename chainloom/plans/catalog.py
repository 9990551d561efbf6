"""All registered queries of the library itself; importing it registers them."""

from chainloom.plans import catalog_layouts, catalog_relational, catalog_text, catalog_tokens
from chainloom.plans.registry import oracle_sql, queries

__all__ = ["catalog_layouts", "catalog_relational", "catalog_text", "catalog_tokens", "oracle_sql", "queries"]
