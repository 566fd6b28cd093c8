"""Imports every plan module so that the registry is complete."""

import importlib

MODULES = ("core", "tables", "signals", "ledgers", "streams")
for _name in MODULES:
    importlib.import_module(f"pricelake.plans.{_name}")
