"""All queries of the library and their oracle SQL, by name."""

from __future__ import annotations

from quillmass.plans import claim_queries
from quillmass.plans.oracles import ORACLE_SQL
from quillmass.plans.queries import QUERIES

FLAGSHIP = "library_search"


def queries() -> dict:
    return QUERIES | claim_queries.QUERIES


def oracle_sql() -> dict:
    return ORACLE_SQL | claim_queries.ORACLE_SQL
