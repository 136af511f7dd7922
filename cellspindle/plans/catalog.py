"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from cellspindle.plans import dense, files, genomics, problems

QUERIES = problems.QUERIES | genomics.QUERIES | files.QUERIES | dense.QUERIES
SQL = problems.SQL | genomics.SQL | files.SQL | dense.SQL
