"""Registered queries: a Spark callable and, where SQL can say the same, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from atalaya.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, "Entry"] = {}


@dataclass(frozen=True)
class Entry:
    run: Query
    oracle: str | None


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        REGISTRY[name] = Entry(run, oracle)
        return fn

    return register
