"""Imports every query module so that the registry is complete."""

import importlib

from episodica.plans.registry import ORACLES, QUERIES

for _module in ("statistics_queries", "insight_queries", "sequence_queries", "language_queries", "curation_queries",
                "validation_queries", "catalog_queries", "storage_queries"):
    importlib.import_module(f"episodica.plans.{_module}")

__all__ = ["ORACLES", "QUERIES"]
