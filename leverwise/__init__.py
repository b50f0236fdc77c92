"""Value-driver and what-if analytics as Spark DataFrame functions."""

from leverwise.sources.tables import Tables, as_input, load_tables

__all__ = ["Tables", "as_input", "load_tables"]
