"""Registered queries and their equivalent SQL."""
from .base import ORACLES, QUERIES  # noqa: F401
from . import features, relational, evaluation, models, portfolio, streams  # noqa: F401,E402
