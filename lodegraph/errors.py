"""What can go wrong with a query or a graph."""

from __future__ import annotations


class GraphError(Exception):
    """Base of all errors of this library."""


class QuerySyntaxError(GraphError):
    """The text is no query of the supported language, or breaks one of its static rules."""

    def __init__(self, message: str):
        super().__init__(f"syntax error: {message}")


class QueryRuntimeError(GraphError):
    """A value that a function can't take."""

    def __init__(self, message: str):
        super().__init__(f"runtime error: {message}")


class ResourceLimitExceeded(GraphError):
    """A query that took more than it may."""


class NotFound(GraphError):
    """A node, edge, label or graph that isn't there."""


class Duplicate(GraphError):
    """An external id that is taken."""


class StorageError(GraphError):
    """A stored graph that can't be read or written."""


class Conflict(StorageError):
    """Another writer holds the graph."""


def outside(what: str) -> QuerySyntaxError:
    return QuerySyntaxError(f"{what} is outside the supported language")
