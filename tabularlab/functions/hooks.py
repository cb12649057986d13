"""Plan composition helpers: ``DataFrame.transform`` chains and
an inspection hook at named stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Stage = Callable[[DataFrame], DataFrame]


def pipe(*stages: Stage) -> Stage:
    """Compose stages left to right: ``df.transform(pipe(a, b, c))``."""
    def run(df: DataFrame) -> DataFrame:
        for s in stages:
            df = df.transform(s)
        return df
    return run


def tap(name: str, callback: Callable[[str, DataFrame], None] | None = None) -> Stage:
    """Identity stage that hands the DataFrame to ``callback(name, df)`` - e.g.
    to print a schema or ``explain`` a plan.  Off (pure identity, no job) when
    no callback is given."""
    def run(df: DataFrame) -> DataFrame:
        if callback is not None:
            callback(name, df)
        return df
    return run
