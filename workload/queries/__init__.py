"""All registered queries."""

from workload.queries import aggregates, changes, functions, inserts, joins, listings, sources, views  # noqa: F401
