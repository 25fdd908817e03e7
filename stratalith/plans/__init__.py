"""Registered queries: library operators wired to the given tables, with their SQL."""

from __future__ import annotations

import importlib

FAMILIES = ("points", "retrieval", "provenance", "mesh", "spatial", "kernel", "streams", "sources", "local_fit")


def load_all() -> None:
    for family in FAMILIES:
        importlib.import_module(f"{__name__}.{family}")
