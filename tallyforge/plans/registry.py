"""All queries over the driver's tables, gathered from the modules of this package."""

from __future__ import annotations

from tallyforge.plans import addresses, answers, appraisals, boards, details, jobs, listings, long_groups, progress, routes, scans, sequences, states

MODULES = (boards, addresses, answers, appraisals, jobs, listings, scans, routes, progress, sequences, long_groups, details, states)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
