"""All queries of the core and their SQL."""

from millrace.plans import derived, found, records, round_trips, scored, texts

_MODULES = (found, texts, records, derived, scored, round_trips)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
