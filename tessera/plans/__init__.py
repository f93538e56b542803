"""Queries of the engine over the driver's tables."""

from . import queries_a, queries_b, queries_c, queries_d, queries_e, queries_f, queries_g, queries_h, queries_i, queries_j, queries_k  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
