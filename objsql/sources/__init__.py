"""Requests, scans of stored objects, and encodings of results."""

from objsql.sources.readers import read_objects
from objsql.sources.request import CsvInput, CsvOutput, GlobRequest, JsonInput, JsonOutput, ParquetInput, SelectRequest, parse_select_xml

__all__ = ["CsvInput", "CsvOutput", "GlobRequest", "JsonInput", "JsonOutput", "ParquetInput", "SelectRequest", "parse_select_xml", "read_objects"]
