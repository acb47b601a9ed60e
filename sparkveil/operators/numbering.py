"""Row numbers within groups of any size, by blocks, so that no task has to see a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TURNS = 4096


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, turn: str = "turn_id", major: list[str] | None = None, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """df with the 1-based number of each row of its group in the order of (major, turn, order).

    Rows are numbered within blocks of `block_turns` turns, and each block is moved by the number of rows in those before it: the
    only window over a whole group is over one row a block.
    """
    major = major or []
    blocks = [*group, *major, "_block"]
    placed = df.withColumn("_block", F.floor(F.col(turn) / block_turns))
    within = Window.partitionBy(*blocks)
    inner = placed.withColumns({"_n": F.row_number().over(within.orderBy(turn, *order)), "_rows": F.count("*").over(within)})
    counts = inner.where("_n = 1").select(*blocks, "_rows")
    before = Window.partitionBy(*group).orderBy(*major, "_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*blocks, F.sum("_rows").over(before).alias("_before")).where("_before > 0")
    return inner.join(counts, blocks, "left").withColumn(name, (F.col("_n") + F.coalesce("_before", F.lit(0))).cast("int")).drop("_n", "_rows", "_before", "_block")
