"""Errors raised before any Spark job starts (bad or missing filter values, unknown tables)."""


class AnalysisError(ValueError):
    """A request cannot be answered as given (missing required filter, unparsable value...)."""
