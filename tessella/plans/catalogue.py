"""Every registered query of the engine proper, with its DuckDB oracle."""

from __future__ import annotations

from tessella.plans import imports, library, triage

PLANS = library.PLANS | triage.PLANS | imports.PLANS
QUERIES = {name: query for name, (query, _) in PLANS.items()}
ORACLE = {name: sql for name, (_, sql) in PLANS.items() if sql}
