"""Queries over a graph."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row

from .cypher import ast as A
from .cypher.parser import parse
from .errors import QuerySyntaxError, ResourceLimitExceeded
from .plans.planner import Planner
from .sources.catalog import Graph

WRITES = (A.Create, A.SetProps, A.Delete)


@dataclass
class Prepared:
    """A parsed query; it can be run over and over with other parameters."""

    text: str
    query: A.Query
    extended: bool

    @property
    def writes(self) -> bool:
        return any(isinstance(c, WRITES) for c in self.query.clauses)

    def run(self, graph: Graph, params: dict | None = None) -> DataFrame:
        if self.writes:
            raise QuerySyntaxError("a query that writes must be run in a transaction")
        df, steps = Planner(graph, params, self.extended).query(self.query)
        if self.query.explain:
            return graph.spark.createDataFrame([(explained(steps, df),)], "plan string")
        return df


def explained(steps: list[str], df: DataFrame) -> str:
    """The operators, last first, and Spark's plan of them."""
    lines = [f"{'  ' * i}{s}" for i, s in enumerate(reversed(steps))]
    return "\n".join([*lines, "", df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))])


@dataclass(frozen=True)
class ExecuteOptions:
    """Limits of :meth:`Session.rows`; None for no limit."""

    soft_timeout_ms: int | None = 5000
    max_rows: int | None = None


@dataclass
class Session:
    """``extended``: also the clauses beyond the basic language (aggregation, ORDER BY, WITH, OPTIONAL MATCH, ...)."""

    graph: Graph
    extended: bool = False

    def prepare(self, text: str) -> Prepared:
        return Prepared(text, parse(text, self.extended), self.extended)

    def query(self, text: str, params: dict | None = None) -> DataFrame:
        return self.prepare(text).run(self.graph, params)

    def rows(self, text: str, params: dict | None = None, options: ExecuteOptions | None = None) -> list[Row]:
        """The rows themselves, within limits; beyond one the query's jobs are stopped and ``ResourceLimitExceeded`` is raised."""
        options = options or ExecuteOptions()
        df, spark, tag = self.query(text, params), self.graph.spark, f"lodegraph-{uuid.uuid4().hex}"
        late = threading.Event()

        def stop() -> None:
            late.set()
            spark.sparkContext.cancelJobsWithTag(tag)

        timer = threading.Timer(options.soft_timeout_ms / 1000, stop) if options.soft_timeout_ms else None
        spark.sparkContext.addJobTag(tag)
        try:
            if timer:
                timer.start()
            found = df.limit(options.max_rows + 1).collect() if options.max_rows is not None else df.collect()
        except Exception as e:
            if late.is_set():
                raise ResourceLimitExceeded(f"it took more than {options.soft_timeout_ms} ms") from e
            raise
        finally:
            if timer:
                timer.cancel()
            spark.sparkContext.removeJobTag(tag)
        if late.is_set():  # what the driver itself evaluated could not be stopped
            raise ResourceLimitExceeded(f"it took more than {options.soft_timeout_ms} ms")
        if options.max_rows is not None and len(found) > options.max_rows:
            raise ResourceLimitExceeded(f"it has more than {options.max_rows} rows")
        return found

    def explain(self, text: str, params: dict | None = None) -> str:
        return self.query(text if text.lstrip().upper().startswith("EXPLAIN") else f"EXPLAIN {text}", params).collect()[0]["plan"]
