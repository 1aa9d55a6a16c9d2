"""All functions and methods of the mapping language, by name."""

from millrace.functions import arrays, coding, context, numbers, parsing, strings, times  # noqa: F401
from millrace.functions.registry import FUNCTIONS, METHODS

__all__ = ["FUNCTIONS", "METHODS"]
