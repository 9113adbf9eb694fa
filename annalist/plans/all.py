"""All registered queries of the memory engine and the SQL that checks them."""

from annalist.plans import derivation, memory, recall, review  # noqa: F401
from annalist.plans.catalogue import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
