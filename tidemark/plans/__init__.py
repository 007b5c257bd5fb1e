"""Registered queries and their SQL."""

from tidemark.plans.oracles import ORACLES
from tidemark.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
