"""The engine's queries by name and their SQL."""

from __future__ import annotations

import importlib

MODULES = (
    "terrachron.operators.trend",
    "terrachron.functions.optics",
    "terrachron.operators.composite",
    "terrachron.operators.smooth",
    "terrachron.operators.events",
    "terrachron.operators.spatial",
    "terrachron.operators.som",
    "terrachron.operators.superpixel",
    "terrachron.operators.matching",
    "terrachron.functions.losses",
    "terrachron.sources.scenes",
    "terrachron.operators.breaks",
    "terrachron.operators.trajectory",
    "terrachron.operators.harmonic",
    "terrachron.operators.phenology",
    "terrachron.operators.classify",
)


def _all() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= importlib.import_module(m).QUERIES
    return out


def queries() -> dict:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all().items() if s}
