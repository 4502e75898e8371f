"""Column helpers."""

from .expressions import as_columns, check_types, tuple_at_least, tuple_between, tuple_equals

__all__ = ["as_columns", "check_types", "tuple_at_least", "tuple_between", "tuple_equals"]
