"""Readers, sinks and the canonical input views."""

from barline.sources.formats import fenced_rows, pages_until_empty, unzip_csv, xml_facts, zip_texts
from barline.sources.readers import candles_from_json, read_csv, read_files, read_table, unnest_price_arrays, write_table

__all__ = ["candles_from_json", "fenced_rows", "pages_until_empty", "read_csv", "read_files", "read_table", "unnest_price_arrays", "unzip_csv", "write_table", "xml_facts", "zip_texts"]
