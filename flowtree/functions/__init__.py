"""Scalar functions as column expressions, and the registry by which pipelines and queries name functions."""

from .registry import REGISTRY, load_function, register
from .scalar import (
    convert_date_format, datetime_to_milliseconds, datetime_to_redshift, engaging_networks_date, flatten, january_1_2016, list_to_dict, message_hash,
    milliseconds_epoch_to_datetime, nevermind, now_datetime, now_milliseconds, now_redshift, package, random_hash, seconds_epoch_to_datetime, string_to_datetime,
    string_to_redshift, sub_dictionary, template, timestamp_to_redshift, to_bool, two_weeks_ago, two_weeks_ago_datetime, unpackage,
)

__all__ = [
    "REGISTRY", "load_function", "register", "convert_date_format", "datetime_to_milliseconds", "datetime_to_redshift", "engaging_networks_date", "flatten", "january_1_2016",
    "list_to_dict", "message_hash", "milliseconds_epoch_to_datetime", "nevermind", "now_datetime", "now_milliseconds", "now_redshift", "package", "random_hash",
    "seconds_epoch_to_datetime", "string_to_datetime", "string_to_redshift", "sub_dictionary", "template", "timestamp_to_redshift", "to_bool", "two_weeks_ago",
    "two_weeks_ago_datetime", "unpackage",
]
