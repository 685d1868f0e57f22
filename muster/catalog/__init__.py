"""One registered query per operator, over domain views of the bundled tables."""

from muster.catalog import (  # noqa: F401  (registers queries)
    q_aggregates,
    q_changes,
    q_filters,
    q_forecasts,
    q_joins,
    q_models,
    q_scalars,
    q_series,
    q_sources,
)
from muster.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
