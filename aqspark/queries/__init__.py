"""Every operator as a query over the given tables, with its SQL twin.

Importing this package fills ``CATALOG``.
"""

from aqspark.queries.base import CATALOG, Query
from aqspark.queries import (  # noqa: F401
    aggregates, cleaning, joining, learning, sampling, scalars, sources, streams, windows)

__all__ = ["CATALOG", "Query"]
