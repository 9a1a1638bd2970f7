"""Registered queries and their SQL. See :mod:`fleet_queries.base` for the catalogs they read."""

from fleet_queries import comparing, details, files, fleet, logs, replicating, scalars, scheduling, selecting, trees  # noqa: F401
from fleet_queries.base import QUERIES, SQL  # noqa: F401
