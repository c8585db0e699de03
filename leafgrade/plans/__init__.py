"""Registered queries; ``load`` imports the modules that register them."""

from importlib import import_module

MODULES = ["layout", "grading", "text", "logs", "documents", "lessons", "exercises", "corrections"]


def load() -> None:
    for name in MODULES:
        import_module(f"leafgrade.plans.{name}")
