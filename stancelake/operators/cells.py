"""Scoring every row of one table against every row of another, in blocks.

Both sides are dealt into blocks of bounded size inside their group (an
election, or everything).  Each (left block, right block) of a group is a
cell: a cogroup of its own that a caller's function turns into rows.  No side is
collected or broadcast, a hot group is many blocks, and what a task holds
is two blocks and their cell.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CellFn = Callable[[pa.Table, pa.Table], pa.Table]


def _blocks(side: DataFrame, group: Sequence[str], rows_per_block: int, name: str) -> DataFrame:
    """(group, name): the number of blocks of each group."""
    return side.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_block)).cast("int").alias(name))


def cell_join(left: DataFrame, right: DataFrame, group: Sequence[str], left_key: str, right_key: str, fn: CellFn, schema: str,
              left_rows: int = 2048, right_rows: int = 512) -> DataFrame:
    """``fn(left rows, right rows)`` for every pair of blocks of the same group.

    ``left_key`` and ``right_key`` name the rows of each side; blocks are dealt by their
    hash.  A group without rows on one side gives nothing.  ``fn`` sees a cell
    in the order it arrives and must not depend on it.
    """
    group = list(group)
    counts = _blocks(left, group, left_rows, "lb_").join(_blocks(right, group, right_rows, "rb_"), group)
    dealt = lambda side, key, n, no: side.join(counts, group).withColumn(no, F.pmod(F.xxhash64(key), F.col(n)).cast("int"))
    other = lambda n, no: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(no)
    a = dealt(left, left_key, "lb_", "l_no_").select(*left.columns, "l_no_", other("rb_", "r_no_"))
    b = dealt(right, right_key, "rb_", "r_no_").select(*right.columns, "r_no_", other("lb_", "l_no_"))
    cell = [*group, "l_no_", "r_no_"]

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        return fn(x.select(left_names), y.select(right_names))

    left_names, right_names = left.columns, right.columns
    return a.groupBy(*cell).cogroup(b.groupBy(*cell)).applyInArrow(run, schema)
