"""Registered queries, grouped by family; importing a family fills the catalogue."""

from __future__ import annotations

import importlib

from .registry import CATALOGUE, Entry

FAMILIES = ["splitting", "selecting", "calibrating", "certifying", "harmonising", "auditing", "resampling", "claiming", "streams", "modelling"]


def catalogue() -> dict[str, Entry]:
    for family in FAMILIES:
        importlib.import_module(f"{__name__}.{family}")
    return CATALOGUE
