"""All registered queries of the library."""

from . import queries_flows  # noqa: F401  registers itself
from .queries_tables import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
