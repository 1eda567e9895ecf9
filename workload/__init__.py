"""Registered queries over the given tables, each with its SQL where SQL can say it."""

import importlib
import pkgutil


def load():
    """Import every query module once; returns (queries, oracles)."""
    from workload import common

    for info in pkgutil.iter_modules(__path__):
        if info.name.endswith("_queries"):
            importlib.import_module(f"workload.{info.name}")
    return common.QUERIES, common.ORACLES
