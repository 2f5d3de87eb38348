"""All queries on signals."""

from signalspark.plans import catalog_coupling, catalog_epochs, catalog_graph, catalog_kernels, catalog_multichannel, catalog_series, catalog_spatial, catalog_sql, catalog_timeline  # noqa: F401
from signalspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
