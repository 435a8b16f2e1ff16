from tessera.sources.catalog import Catalog, SCHEMAS
from tessera.sources.columnfile import ColumnFileSource, register_columnfile, write_column, write_columns
from tessera.sources.scratch import scratch_folder
from tessera.sources.sinks import text_rows, write_table
from tessera.sources.runs import sorted_int_runs, sorted_tuple_runs

__all__ = ["Catalog", "SCHEMAS", "ColumnFileSource", "register_columnfile", "write_column", "write_columns", "scratch_folder",
           "text_rows", "write_table", "sorted_int_runs", "sorted_tuple_runs"]
