"""Registered queries over the survey-shaped and the relational tables."""

from surveyloom.plans import exploring, heart_queries, modelling, preparing
from surveyloom.plans.registry import ENTRIES

__all__ = ["ENTRIES", "exploring", "heart_queries", "modelling", "preparing"]
