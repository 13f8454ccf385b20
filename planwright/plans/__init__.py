"""Queries by subject; importing the package registers them."""

from planwright.plans import audits, bill, catalogue, commits, costs, export, finishes, lineage, names, pricing, quantities, queue, reading, rooms, rules, sheets  # noqa: F401
from planwright.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
