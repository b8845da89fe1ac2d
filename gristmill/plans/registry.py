"""All queries of the change-review side, by name."""

from __future__ import annotations

from gristmill.plans import formats, gates, measures, modules, reviews, tampering

MODULES = (measures, formats, reviews, tampering, gates, modules)
QUERIES: dict = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
