"""Registered queries; importing the package fills the registry."""

from importlib import import_module

MODULES = ("prices", "tree", "norms", "scalars", "books", "rates", "pages", "quality")
for _module in MODULES:
    import_module(f"costbook.plans.{_module}")
