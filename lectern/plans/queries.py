"""All queries over the library's own operators, and their DuckDB equivalents."""

from lectern.plans import cleaning_queries, job_queries, speech_queries, store_queries  # noqa: F401

QUERIES, SQL = cleaning_queries.QUERIES, cleaning_queries.SQL
