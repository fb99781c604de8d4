"""Scalar functions that several jobs share, as Column expressions."""

from ..operators.clock import hour_of_day
from ..operators.keyed import periodic
from ..operators.load import average

__all__ = ["average", "hour_of_day", "periodic"]
