"""Reading source tables and the published warehouse."""

from doorflux.sources.scan import extract, jdbc_table, parquet_table, project
from doorflux.sources.warehouse import query

__all__ = ["extract", "jdbc_table", "parquet_table", "project", "query"]
