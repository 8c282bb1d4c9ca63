"""All queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from tallyweir.plans import checks, events, more, search, serving, streams

QUERIES: dict = {}
ORACLES: dict = {}

for _found in (events.FOUND, serving.FOUND, more.FOUND, checks.FOUND, search.FOUND, streams.FOUND):
    if twice := QUERIES.keys() & _found.queries.keys():
        raise ValueError(f"queries {sorted(twice)} are there twice")
    QUERIES.update(_found.queries)
    ORACLES.update(_found.oracles)
