"""Scalar helpers: column-name rules (driver side, schema only) and Column expressions."""

from tablesmith.functions.names import is_id_like, sanitize_name, sanitize_names
from tablesmith.functions.numbers import js_number, to_double
from tablesmith.functions.text import file_extension, split_list

__all__ = ["is_id_like", "sanitize_name", "sanitize_names", "js_number", "to_double",
           "file_extension", "split_list"]
