"""All plans, imported so that they register."""

from . import aggregates, clips, details, joins, mutations, ranks, search, services, sources, streams, studio, windows  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
