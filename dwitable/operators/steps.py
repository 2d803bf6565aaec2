"""Steps of a user's own as table functions: for SQL, and for the flows.

A step sees the rows of one subject after the other, in an order it asks for, and keeps what it likes between them. Spark deals
the rows out by subject and passes them by; no subject is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

Schema = Callable[[StructType], StructType]


class SubjectStep:
    """What a user derives from: one object for each subject.

    ``schema`` tells the columns of the result from those of the table; the subject's are among them. ``row`` gets each row
    in order and yields result rows as tuples, ``end`` yields further ones after the last row.
    """

    @staticmethod
    def schema(given: StructType) -> StructType:
        return given

    def row(self, row: Row) -> Iterator[tuple]:
        yield tuple(row)

    def end(self) -> Iterator[tuple]:
        return iter(())


def table_function(step: type[SubjectStep], order: Sequence[str] = (), key: str = "subject") -> Any:
    """A table function of one table argument that runs the step on every value of ``key``, rows in order.

    Its ``analyze`` says partitioning, order and result schema, so a caller only names the table.
    """
    partition, ordering = [PartitioningColumn(key)], [OrderingColumn(c) for c in order]

    class Function:
        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable:
                raise ValueError("the argument must be a table")
            missing = {key, *order} - set(table.dataType.names)
            if missing:
                raise ValueError(f"the table has no column {', '.join(sorted(missing))}")
            free = StructType([StructField(f.name, f.dataType) for f in step.schema(table.dataType)])  # a step may yield NULLs anywhere
            return AnalyzeResult(schema=free, partitionBy=partition, orderBy=ordering)

        def __init__(self):
            self.step = step()

        def eval(self, row: Row):
            yield from self.step.row(row)

        def terminate(self):
            yield from self.step.end()

    return udtf(Function)


def register_step(spark: SparkSession, name: str, step: type[SubjectStep], order: Sequence[str] = (), key: str = "subject") -> None:
    """Make a step callable from SQL: ``SELECT * FROM name(TABLE(t))``."""
    spark.udtf.register(name, table_function(step, order, key))


def as_step(step: type[SubjectStep], order: Sequence[str] = (), key: str = "subject") -> Callable[[DataFrame], DataFrame]:
    """The step as a function from table to table, as a study profile's ``steps`` take it."""
    function = table_function(step, order, key)
    return lambda df: function(df.asTable())
