"""The registered queries: each operator on the given tables, with its SQL twin where there is one."""

from tallywork.catalog import (  # noqa: F401  (importing a module registers its queries)
    aggregating, files, jobs, joining, modelling, monitoring, ordering, profiling, projecting, reporting,
    scalar, statistical,
)
from tallywork.catalog.registry import QUERIES, Query

__all__ = ["QUERIES", "Query"]
