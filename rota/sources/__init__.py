"""Sources (given parquet tables, role views over them) and sinks."""

from rota.sources.tables import TABLES, read_table
from rota.sources.roles import RosterTables, role_tables, roster_tables
from rota.sources.sinks import write_documents

__all__ = ["TABLES", "read_table", "RosterTables", "role_tables", "roster_tables", "write_documents"]
