"""Bind the operators to the test tables; each module registers queries with their oracle."""

from __future__ import annotations

from importlib import import_module

MODULES = ["q_sources", "q_panel", "q_funnel", "q_plans", "q_text", "q_streams"]


def load_all():
    from atalaya.bindings.registry import REGISTRY

    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return REGISTRY
