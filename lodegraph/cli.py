"""``python -m lodegraph.cli``: queries and statements over a stored graph, rows as one JSON object a line."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import Row, SparkSession

from .admin import check_store, repair_store
from .errors import GraphError
from .session import Session
from .sources.store import Store


def params_of(text: str | None) -> dict:
    """A JSON object of scalars; floats are refused."""
    if not text:
        return {}
    found = json.loads(text)
    if not isinstance(found, dict):
        raise GraphError("parameters must be a JSON object")
    for k, v in found.items():
        if isinstance(v, float) or isinstance(v, (list, dict)):
            raise GraphError(f"parameter {k} must be null, true, false, a whole number or text")
    return found


def plain(x: object) -> object:
    if isinstance(x, Row):
        d = {k: plain(v) for k, v in x.asDict().items()}
        if set(d) == {"id", "labels", "properties"}:
            return {"internal_node_id": d["id"], "labels": d["labels"], "properties": {k: v for k, v in (d["properties"] or {}).items() if v is not None}}
        if set(d) == {"src", "type", "dst", "properties"}:
            return {"src": d["src"], "rel": d["type"], "dst": d["dst"], "properties": {k: v for k, v in (d["properties"] or {}).items() if v is not None}}
        return d
    if isinstance(x, list):
        return [plain(v) for v in x]
    return x if x is None or isinstance(x, (bool, int, float, str)) else str(x)


def show(df, out) -> None:
    for row in df.toLocalIterator():
        out.write(json.dumps({c: plain(row[i]) for i, c in enumerate(df.columns)}, ensure_ascii=False) + "\n")


HELP = """:param NAME VALUE  set a parameter to a JSON value or quoted text
:params            show the parameters
:unparam NAME      forget one
:clearparams       forget all
:help              show this
:exit              leave"""


def command(text: str, params: dict, out) -> bool:
    """Do what a line with a colon says; false to leave."""
    word, _, rest = text.partition(" ")
    name, _, value = rest.strip().partition(" ")
    if word in (":quit", ":exit"):
        return False
    if word == ":param" and name and value.strip():
        value = value.strip()
        quoted = len(value) > 1 and value[0] == value[-1] == "'"
        params |= params_of(json.dumps({name: value[1:-1] if quoted else json.loads(value)}))
    elif word == ":params":
        out.write(json.dumps(params, sort_keys=True) + "\n")
    elif word == ":unparam" and name:
        params.pop(name, None)
    elif word == ":clearparams":
        params.clear()
    elif word == ":help":
        out.write(HELP + "\n")
    else:
        raise GraphError(f"no command {text!r}; :help shows them")
    return True


def repl(spark: SparkSession, store: Store, extended: bool, source, out) -> None:
    params: dict = {}
    for line in source:
        text = line.strip()
        try:
            if text.startswith(":"):
                if not command(text, params, out):
                    return
            elif text:
                run(store, text, params, extended, out)
        except (GraphError, ValueError) as e:
            out.write(f"error: {e}\n")


def run(store: Store, text: str, params: dict, extended: bool, out) -> None:
    prepared = Session(store.graph(), extended).prepare(text)
    if prepared.writes:
        out.write(json.dumps({"count": store.execute(text, params)}) + "\n")
    else:
        show(prepared.run(store.graph(), params), out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    out = out or sys.stdout
    parser = argparse.ArgumentParser(prog="lodegraph")
    parser.add_argument("command", choices=["query", "write", "repl", "check", "repair", "vacuum"])
    parser.add_argument("graph", help="folder of the stored graph")
    parser.add_argument("text", nargs="?", help="the query")
    parser.add_argument("--file", help="a file with the query")
    parser.add_argument("--params", help="a JSON object")
    parser.add_argument("--extended", action="store_true", help="also take aggregation, ORDER BY, WITH, OPTIONAL MATCH and the like")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("lodegraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if args.command == "check":
            bad = check_store(spark, args.graph)
            show(bad, out)
            return int(not bad.isEmpty())
        if args.command == "repair":
            out.write(json.dumps({"version": repair_store(spark, args.graph)}) + "\n")
            return 0
        store = Store.open(spark, args.graph)
        if args.command == "vacuum":
            out.write(json.dumps({"count": store.vacuum()}) + "\n")
            return 0
        if args.command == "repl":
            repl(spark, store, args.extended, sys.stdin, out)
            return 0
        text = Path(args.file).read_text() if args.file else args.text or ""
        run(store, text, params_of(args.params), args.extended, out)
        return 0
    except (GraphError, ValueError) as e:
        sys.stderr.write(f"error: {e}\n")
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
