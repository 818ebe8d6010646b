"""Sources: files, generated rows, tables and SQL, and HTTP."""

from .files import csv_reader, csv_to_dictionary_list, load_typed_csv, local_file_reader, parse_csv
from .generate import constant_emitter, counter, environment_variables, sequence_cross, sequence_emitter
from .http import http_get, http_get_pages
from .sql import column_types, sql_execute, sql_to_csv, stream_table

__all__ = [
    "column_types", "constant_emitter", "counter", "csv_reader", "csv_to_dictionary_list", "environment_variables", "http_get", "http_get_pages", "load_typed_csv",
    "local_file_reader", "parse_csv", "sequence_cross", "sequence_emitter", "sql_execute", "sql_to_csv", "stream_table",
]
