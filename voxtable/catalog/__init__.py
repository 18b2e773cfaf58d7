"""All queries, imported for their registration."""

from voxtable.catalog import cleaning, ensembles, features, models, profiles, tables
from voxtable.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cleaning", "ensembles", "features", "models", "profiles", "tables"]
