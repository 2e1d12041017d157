"""Joins that make many more rows than either side has, dealt out to tasks by the pairs they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.expressions import ref

#: Pairs of a task and rows of a task's sides, about; rows of a side that meet in a cell, the smallest lot that is dealt out.
PAIRS, ROWS, SIDE = 1 << 23, 1 << 22, 1 << 10
#: A join with fewer pairs for each row of its sides is left as it is: Spark's own tasks follow the rows.
FEW = 16


def paired(left: DataFrame, right: DataFrame, keys: list[tuple[Column, Column]], counted: tuple[DataFrame, DataFrame], ids: tuple[list[str], list[str]], tag: str) -> DataFrame | None:
    """The inner join on ``keys`` (all pairs, if there are none), in as many tasks as its pairs need; None where that isn't worth while.

    The pairs are counted by key at once, over ``counted``: the rows of either side that count, at most those of the sides.
    A key with many pairs is cut into cells, for which rows of either side are repeated once for every lot of the other, so
    the rows dealt out are a few hundredths of the pairs.  ``ids`` are the columns that a side's rows are dealt by.
    """
    names, n, total, rows, cut = [f"{tag}|key{i}" for i in range(len(keys))], F.count(F.lit(1)), F.col("l") * F.col("r"), F.col("l") + F.col("r"), []
    sums = [counted[side].groupBy(*[k[side].alias(name) for k, name in zip(keys, names, strict=True)]).agg(n.cast("double").alias("lr"[side])) for side in (0, 1)]
    if keys:
        many = F.when(total > SIDE * SIDE, F.struct(*map(ref, names), "l", "r"))
        one = sums[0].join(sums[1], names, "full").fillna(0.0, ["l", "r"]).agg(F.sum(total).alias("total"), F.sum(rows).alias("rows"), F.collect_list(many).alias("cut"))
    else:
        one = sums[0].crossJoin(sums[1]).select(total.alias("total"), rows.alias("rows"), F.array(F.struct("l", "r")).alias("cut"))
    found = one.collect()[0]
    if (found["total"] or 0) <= max(PAIRS, FEW * found["rows"]):
        return None
    lots = lambda c: F.ceil(F.col(c) / SIDE).cast("int").alias(f"{tag}|{c}")
    cut = F.broadcast(left.sparkSession.createDataFrame(found["cut"], one.schema["cut"].dataType.elementType).select(*map(ref, names), lots("l"), lots("r")))
    parts, cell = int(max(found["total"] / PAIRS, found["rows"] / ROWS)) + 1, [f"{tag}|lot_l", f"{tag}|lot_r"]

    def dealt(side: int, df: DataFrame) -> DataFrame:
        df = df.withColumns({name: k[side] for k, name in zip(keys, names, strict=True)})
        df = df.join(cut, names, "left") if keys else df.crossJoin(cut)
        own, other = ("l", "r") if side == 0 else ("r", "l")
        lot = F.coalesce(F.pmod(F.xxhash64(*map(ref, ids[side])), ref(f"{tag}|{own}").cast("long")).cast("int"), F.lit(0)) if ids[side] else F.lit(0)
        every = F.explode(F.sequence(F.lit(0), F.coalesce(ref(f"{tag}|{other}"), F.lit(1)) - 1))
        df = df.withColumn(f"{tag}|lot_{own}", lot).withColumn(f"{tag}|lot_{other}", every).drop(f"{tag}|l", f"{tag}|r")
        return df.repartition(parts, *map(ref, names), *map(ref, cell))

    # a broadcast side would hold its rows as often as they are repeated
    return dealt(0, left).join(dealt(1, right).hint("merge"), [*names, *cell]).drop(*names, *cell)
