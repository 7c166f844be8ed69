"""Queries over the given tables: one for each operator."""

from pairweave.plans import alignment, evaluation, features, models, sequences, sources, stats, structure  # noqa: F401
from pairweave.plans.registry import ORACLES, QUERIES  # noqa: F401
