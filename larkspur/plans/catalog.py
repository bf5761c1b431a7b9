"""All queries of the library and, where SQL expresses them, their SQL."""

from __future__ import annotations

from larkspur.plans import corpus, indexes, relational, retrieval, techniques

QUERIES = relational.QUERIES | retrieval.QUERIES | corpus.QUERIES | indexes.QUERIES | techniques.QUERIES
SQL = relational.SQL | retrieval.SQL | corpus.SQL | indexes.SQL | techniques.SQL
