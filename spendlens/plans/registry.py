"""Registered queries: a Spark callable and, where SQL can say it, an oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.plans.views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _rounded(c: str, digits: int):
    """Half-up, with the tie moved off the short decimals the data is full of."""
    scale = float(10**digits)
    return F.floor(F.col(c).cast("double") * scale + 0.500001).cast("double") / scale


def query(name: str, views: str = "", sql: str | None = None, r: str = "", digits: int = 4):
    """Register fn(tables) -> DataFrame under name.

    sql may use the named views as CTEs.  r names the double columns both sides round, so
    that summation order cannot show in the comparison.
    """
    doubles = r.split()

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Tables(spark, sf_dir))
            return df.select(*[
                _rounded(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])

        QUERIES[name] = run
        if sql is not None:
            text = sql.strip()
            if doubles:
                repl = ", ".join(f"floor({c}::double * 1e{digits} + 0.500001) / 1e{digits} as {c}" for c in doubles)
                text = f"select * replace ({repl}) from (\n{text}\n)"
            ORACLE[name] = with_views(views.split(), text)
        return fn

    return wrap
