"""Integrity checks of graphs with many rows."""

import re

import pytest

from lodegraph import admin
from lodegraph.sources.catalog import Graph


@pytest.fixture(scope="module")
def damaged(spark):
    g = Graph(spark).add_nodes("N", spark.createDataFrame([(k,) for k in [*range(1000), 5]], "n long"), "n")
    likes = spark.createDataFrame([(0, 1), (0, 1), (1, 5000), (2, 3)], "a long, b long")
    took = spark.createDataFrame([(2, 7000), (2, 7000), (2, 3), (8000, 2), (None, 2)], "a long, b long")
    return g.add_rels("LIKES", likes, ("N", "a"), ("N", "b")).add_rels("TOOK", took, ("N", "a"), ("N", "b"), unique=False)


@pytest.mark.parametrize("rows", [100, 1 << 20])
def test_damage_is_found_whatever_the_number_of_tasks(damaged, monkeypatch, rows):
    monkeypatch.setattr(admin, "ROWS", rows, raising=False)
    assert sorted(tuple(r) for r in admin.check_graph(damaged).collect()) == [
        ("DuplicateEdge", "LIKES", 1), ("DuplicateNodeId", "", 1), ("OrphanEdge", "LIKES.dst", 1), ("OrphanEdge", "TOOK.dst", 1), ("OrphanEdge", "TOOK.src", 1),
    ]


def test_tasks_follow_the_rows(damaged, monkeypatch):
    monkeypatch.setattr(admin, "ROWS", 100, raising=False)
    plan = admin.check_graph(damaged)._jdf.queryExecution().executedPlan().toString()
    tasks = [int(n) for n in re.findall(r"hashpartitioning\(.*, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert tasks and min(tasks) == 11 and "BroadcastHashJoin" not in plan
