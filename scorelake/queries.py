"""The queries over score tables, and their SQL for DuckDB, by name."""

from scorelake.plans import bundle_queries, document_queries, file_queries, layout_queries, score_queries

_ALL = score_queries.QUERIES | layout_queries.QUERIES | document_queries.QUERIES | bundle_queries.QUERIES | file_queries.QUERIES
QUERIES = {name: query for name, (query, _) in _ALL.items()}
SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
