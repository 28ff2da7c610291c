"""Declarative pipelines: named DataFrame functions whose parameters name what they read."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession


class Pipeline:
    """Views are recomputed by each reader; tables are written once to the catalog, in dependency order."""

    def __init__(self, spark: SparkSession, sources: dict[str, DataFrame] | None = None):
        self.spark, self.made = spark, dict(sources or {})
        self.steps: dict[str, tuple[Callable[..., DataFrame], bool]] = {}

    def view(self, f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        self.steps[f.__name__] = (f, False)
        return f

    def table(self, f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        self.steps[f.__name__] = (f, True)
        return f

    def sql(self, name: str, text: str, *reads: str) -> None:
        """A step in SQL over named inputs."""

        def f(**inputs: DataFrame) -> DataFrame:
            return self.spark.sql(text, **inputs)

        f.__signature__ = inspect.Signature([inspect.Parameter(r, inspect.Parameter.KEYWORD_ONLY) for r in reads])
        self.steps[name] = (f, False)

    def run(self, *wanted: str) -> dict[str, DataFrame]:
        """Builds what is wanted, all steps if nothing is named, and returns it; raises on a cycle or an unknown input."""
        reads = {n: list(inspect.signature(f).parameters) for n, (f, _) in self.steps.items()}
        for n, needs in reads.items():
            for x in needs:
                if x not in self.steps and x not in self.made:
                    raise KeyError(f"{n} reads {x}, which nothing makes")
        for n in TopologicalSorter(reads).static_order():
            if n in self.steps and n not in self.made:
                f, keep = self.steps[n]
                df = f(**{x: self.made[x] for x in reads[n]})
                if keep:
                    df.write.mode("overwrite").saveAsTable(n)
                    df = self.spark.table(n)
                self.made[n] = df
        return {n: self.made[n] for n in (wanted or self.steps)}
