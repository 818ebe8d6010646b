"""Operators on rows: each takes a DataFrame and returns one, as a plan for Catalyst."""

from .aggregate import aggregate_values, batch_messages, find_value, row_stats
from .filter import drop_nulls, filter_rows, json_valid, meets_condition, random_sample
from .join import stream_join, time_window
from .project import function_of_message, insert_data, remapper, serializer, simple_transforms, substitute_regex

__all__ = [
    "aggregate_values", "batch_messages", "drop_nulls", "filter_rows", "find_value", "function_of_message", "insert_data", "json_valid", "meets_condition", "random_sample",
    "remapper", "row_stats", "serializer", "simple_transforms", "stream_join", "substitute_regex", "time_window",
]
