"""Queries over the test tables, one or more per operator, and the SQL they are checked against."""

from . import ecology, flow, models, rates  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
