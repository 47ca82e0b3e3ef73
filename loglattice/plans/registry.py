"""Registered queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.plans.fixtures import Frames, oracle

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        def run(spark, sf_dir) -> DataFrame:
            out = f(Frames(spark, sf_dir))
            small = [c.name for c in out.schema if isinstance(c.dataType, (T.IntegerType, T.ShortType, T.ByteType))]
            return out.withColumns({c: F.col(c).cast("long") for c in small}) if small else out

        _QUERIES[name] = run
        if sql:
            _ORACLES[name] = oracle(sql)
        return f

    return register


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
