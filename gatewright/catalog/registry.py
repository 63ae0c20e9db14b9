"""Registration of named queries with their correctness SQL."""

from __future__ import annotations

from gatewright.sources.adapter import Views
from gatewright.sources.tables import Tables

REGISTRY: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    """Register fn(t, v): t gives the driver tables, v the workflow views."""

    def wrap(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn

    return wrap


def callable_for(fn):
    def run(spark, sf_dir):
        t = Tables(spark, sf_dir)
        return fn(t, Views(t))

    return run
