"""All queries of the library's core and their SQL, by name."""

from lodestrata.plans import asked, building, built, code, graph, places, snapshots, stored, templates, trials  # noqa: F401
from lodestrata.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
