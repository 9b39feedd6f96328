"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from workload.tables import Registry

MODULES = ("retrieval", "ingestion", "dialogue", "logs", "evaluation", "integrity", "streams")

REGISTRY = Registry()
for _name in MODULES:
    _module = import_module(f"workload.{_name}")
    for _key, _fn in _module.R.queries.items():
        REGISTRY.add(_key, _module.R.oracles.get(_key))(_fn)
