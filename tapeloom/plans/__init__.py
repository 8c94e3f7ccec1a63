"""Queries over the driver's tables, by name, each with the SQL it is compared with."""

from tapeloom.plans import audits, catalog, files, market, record_views, replays, research, scalars
from tapeloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "audits", "catalog", "files", "market", "record_views", "replays", "research", "scalars"]
