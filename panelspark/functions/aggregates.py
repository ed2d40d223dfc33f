"""Aggregates with explicit order and null rules, as SQL text.

Text, because a wide feature table needs thousands of these and each is then a single call to
the JVM instead of one per operator in it. ``column`` and ``order`` are SQL text as well;
``order`` must be unique within a group. A numeric order keeps the buffers fixed-width, so
Spark stays with hash aggregation.
"""

from __future__ import annotations


def last_valid(column: str, order: str) -> str:
    """Last non-null value. ``max_by`` alone would return the null of the last row."""
    return f"max_by({column}, CASE WHEN {column} IS NOT NULL THEN {order} END)"


def first_valid(column: str, order: str) -> str:
    return f"min_by({column}, CASE WHEN {column} IS NOT NULL THEN {order} END)"


def last_valid_before(column: str, order: str, bound: int) -> str:
    """Last non-null value among the rows ordered strictly before ``bound``."""
    return f"max_by({column}, CASE WHEN {column} IS NOT NULL AND {order} < {bound} THEN {order} END)"


def from_order(column: str, order: str, start: int) -> str:
    """The column where the order is at least ``start``; feed it to any null-skipping aggregate."""
    return f"CASE WHEN {order} >= {start} THEN {column} END"
