"""All registered queries of the numeric engine, by name, with their SQL."""

from __future__ import annotations

from veldt.plans import dense_queries, matrix_queries, more_queries, tensor_queries  # noqa: F401  they register themselves
from veldt.plans._register import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
