"""All registered queries."""

from pluvia.plans import (  # noqa: F401
    catalog_joins,
    catalog_metrics,
    catalog_models,
    catalog_series,
    catalog_sources,
    catalog_tables,
)
from pluvia.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
