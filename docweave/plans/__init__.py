"""Whole-table queries; importing the modules fills the catalog."""

from importlib import import_module

from docweave.plans.catalog import QUERIES, SQL

MODULES = ["corpus", "retrieval", "evaluation", "operations", "knowledge", "answers", "windows", "deletions"]

for _name in MODULES:
    import_module(f"docweave.plans.{_name}")

__all__ = ["QUERIES", "SQL"]
