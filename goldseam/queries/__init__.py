"""Registered queries: each runs an operator over whole driver tables, most with a SQL check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    name: str
    run: Run
    oracle: str | None


REGISTRY: dict[str, Registered] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"Registered twice: {name}")
        REGISTRY[name] = Registered(name, run, oracle)
        return run

    return add


def load_all() -> dict[str, Registered]:
    from goldseam.queries import (  # noqa: F401
        casts,
        fingerprints,
        governance,
        ledgers,
        migrations,
        profiling,
        repairs,
        schemas,
        sources,
    )

    return REGISTRY
