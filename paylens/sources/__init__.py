"""Table readers, fixed schemas, raw-table adapters and sinks."""

from paylens.sources.adapters import Dataset
from paylens.sources.tables import append_table, create_table, read_table, refresh_table, rows_to_frame, write_table

__all__ = ["Dataset", "append_table", "create_table", "read_table", "refresh_table", "rows_to_frame", "write_table"]
