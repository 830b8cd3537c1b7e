"""Registry of the core queries and their SQL equivalents."""

from __future__ import annotations

from tallyloom.plans import heavy, relational, served  # noqa: F401 (served registers its queries with relational's)

QUERIES = {**relational.QUERIES, **heavy.QUERIES}
ORACLE = {**relational.ORACLE, **heavy.ORACLE}
