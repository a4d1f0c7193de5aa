"""All registered queries."""

from pavement.plans.registry import QUERIES, SQL
from pavement.plans import (crop_queries, file_queries, learning_queries, network_queries, raster_queries,  # noqa: F401
                            sample_queries, scalar_queries, source_queries, spatial_queries, street_queries)

__all__ = ["QUERIES", "SQL"]
