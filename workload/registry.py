"""The table of queries: a name, a Spark callable and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from workload.fixtures import load, prologue


@dataclass
class Tables:
    """The fixtures of one scale directory, loaded by attribute."""

    spark: SparkSession
    sf_dir: str

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, needs: str = "", sql: str | None = None, recursive: bool = False):
    """Register a query ``f(tables)``; ``sql`` follows the WITH clause of the fixtures in ``needs``.

    SQL that starts with ``+`` adds tables to that clause, ``recursive`` ones if it says so.
    """

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            text = sql.strip()
            more = "," if text.startswith("+") else ""
            clause = prologue(*needs.split()) if needs else ""
            clause = clause.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else clause
            ORACLES[name] = f"{clause}{more}\n{text.lstrip('+ ')}" if needs else text
        return f

    return register
