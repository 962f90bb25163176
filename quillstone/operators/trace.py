"""What each step of a flow took in and gave out, seen by Spark as it runs: named metrics on the plan, no pass of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Trace:
    """Steps in the order in which they were added. Its numbers are there once the flow's result has been written or collected."""

    def __init__(self) -> None:
        self._seen: list[tuple[str, Observation, list[str]]] = []

    def step(self, name: str, rows: DataFrame, **metrics: Column) -> DataFrame:
        """rows, observed: their number n (or what is given as n, where a row stands for many), and aggregates by name."""
        seen, metrics = Observation(), {"n": F.count(F.lit(1)), **metrics}
        self._seen.append((name, seen, list(metrics)))
        return rows.observe(seen, *[c.alias(k) for k, c in metrics.items()])

    def values(self) -> list[tuple[int, str, str, float | None]]:
        """(step from 1, name, metric, value) of each metric. Waits for the flow's first action; a step that its plan left out for lack of rows has n = 0."""
        out = []
        for k, (name, seen, metrics) in enumerate(self._seen, 1):
            found = seen.get
            out += [(k, name, m, None if found.get(m, 0 if m == "n" else None) is None else float(found.get(m, 0))) for m in metrics]
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.values(), "step int, name string, metric string, value double")
