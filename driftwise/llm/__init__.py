"""Operators of a training-data pipeline; nothing else in the library imports them.

Operators may read their input more than once, so it must give the same rows each
time (a table or a checkpoint, not a ``limit`` without an order).

``QUERIES`` and ``ORACLE`` are their registered queries over the driver tables."""

from .queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
