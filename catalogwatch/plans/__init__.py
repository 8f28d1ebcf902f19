"""Registered queries over the driver tables, each with its SQL twin where one exists."""

from __future__ import annotations

import importlib

from catalogwatch.plans.registry import ORACLES, QUERIES

MODULES = (
    "catalogue",
    "snapshots",
    "urlsets",
    "requests",
    "proxies",
    "windows",
    "jobs",
    "pages",
    "variants",
    "selectors",
    "streams",
    "late",
    "landed",
    "files",
)


def load_all() -> tuple[dict, dict]:
    for name in MODULES:
        try:
            importlib.import_module(f"catalogwatch.plans.{name}")
        except ModuleNotFoundError as err:
            if err.name != f"catalogwatch.plans.{name}":
                raise
    return QUERIES, ORACLES
