"""All catalogue queries (importing a module registers its queries)."""

from __future__ import annotations

import importlib

from ledgerfold.plans.registry import ORACLE, QUERIES

_MODULES = ["q_labels", "q_quality", "q_text", "q_vectors", "q_features", "q_eval", "q_linkage", "q_models"]
for _m in _MODULES:
    importlib.import_module(f"ledgerfold.plans.{_m}")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
