"""One query for each operator over the derived graph, and SQL for the same rows."""

from tessera.queries import extraction, graph, storage, tools  # noqa: F401  each registers its own
from tessera.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
