"""Registered queries and their independent SQL oracles, by family."""

from .base import QUERIES, oracles  # noqa: F401
from . import (  # noqa: F401
    load,
    joins,
    history,
    xs,
    outcomes,
    tests_and_trials,
    streams,
)
