"""The store's floor as constant tables: a grid of cells, who can stand where, and walking distances.

The grid is a plan constant of a few hundred cells, so paths are worked out while the plan is made.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS, COLS = 8, 14
ENTRANCE = (7, 7)


def walkable(blocked: set[tuple[int, int]], rows: int = ROWS, cols: int = COLS) -> set[tuple[int, int]]:
    return {(r, c) for r in range(rows) for c in range(cols)} - blocked


def distances(cells: set[tuple[int, int]], start: tuple[int, int]) -> dict[tuple[int, int], int]:
    """Steps from ``start`` to every cell that can be reached, by four neighbours."""
    out, todo = {start: 0}, deque([start])
    while todo:
        r, c = todo.popleft()
        for nxt in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
            if nxt in cells and nxt not in out:
                out[nxt] = out[(r, c)] + 1
                todo.append(nxt)
    return out


def grid(spark: SparkSession, blocked: set[tuple[int, int]]) -> DataFrame:
    """(r, c, walkable)."""
    free = walkable(blocked)
    return spark.createDataFrame([(r, c, (r, c) in free) for r in range(ROWS) for c in range(COLS)], "r long, c long, walkable boolean")


def access_cells(cells: DataFrame) -> DataFrame:
    """Walkable cells next to a blocked one: where a shelf can be reached from; (r, c, shelf_r, shelf_c)."""
    shelf = cells.where(~F.col("walkable")).select(F.col("r").alias("shelf_r"), F.col("c").alias("shelf_c"))
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))]))
    near = shelf.withColumn("s", step).select("shelf_r", "shelf_c", (F.col("shelf_r") + F.col("s.dr")).alias("r"), (F.col("shelf_c") + F.col("s.dc")).alias("c"))
    return near.join(cells.where("walkable").select("r", "c"), ["r", "c"], "left_semi").distinct()


def walking_distances(spark: SparkSession, blocked: set[tuple[int, int]], start: tuple[int, int] = ENTRANCE) -> DataFrame:
    """(r, c, steps) of the cells that can be reached."""
    return spark.createDataFrame([(r, c, s) for (r, c), s in distances(walkable(blocked), start).items()], "r long, c long, steps int")
