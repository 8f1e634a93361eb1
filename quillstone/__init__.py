"""Spark-native ledger standardisation engine."""

from .errors import MappingError, WorkbookError
from .functions.codes import normalize_device_code
from .functions.dates import normalize_date, normalize_native_date
from .plans.workbook import Conversion, convert, json_results, load_mapping, ordered, results
from .sources.workbook import entries, files, save

__all__ = ["Conversion", "MappingError", "WorkbookError", "convert", "entries", "files", "json_results", "load_mapping", "normalize_date", "normalize_device_code", "normalize_native_date", "ordered", "results", "save"]
