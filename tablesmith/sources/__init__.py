"""Readers and writers."""

from tablesmith.sources.files import read_table, scan_csv, scan_csv_dir, scan_sample
from tablesmith.sources.sinks import (append_activity_log, json_records, load_model,
                                      save_model, write_csv, write_json_records)

__all__ = ["read_table", "scan_csv", "scan_csv_dir", "scan_sample", "append_activity_log",
           "json_records", "load_model", "save_model", "write_csv", "write_json_records"]
