"""Errors that callers see."""


class WorkbookError(ValueError):
    """The package can't be read, or its result can't be written."""


class MappingError(WorkbookError):
    """The mapping isn't one name to one code, or its workbook can't be read."""
