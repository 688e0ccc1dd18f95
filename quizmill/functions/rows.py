"""Plans whose columns are made once, and whose tasks stay of a size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task is dealt to sort: up to 200 MB of narrow ones. 240 million then make 200 tasks, the most that Spark deals rows to without sorting them first.
ROWS_A_TASK = 1_200_000


def tasks(df: DataFrame) -> int:
    """How many tasks to deal df's rows to, so that each has ROWS_A_TASK of them at most, on average, and every core a task.

    Left to itself, Spark goes by compressed bytes: millions of narrow rows to a task. df is counted: files hold their counts.
    """
    n = -(-df.count() // ROWS_A_TASK)
    return max(n, df.sparkSession.sparkContext.defaultParallelism)


def once(df: DataFrame, *columns: str) -> DataFrame:
    """df with these columns (none named: all) through a generator: they are made once, and not again in each place, filters among them, that reads them.

    The optimiser writes a column's expression into later projections and into the filters that it puts before explode;
    it doesn't do so across a generator. Columns that don't go through it are still left out where nothing reads them.
    """
    through = columns or df.columns
    named = [f"`{c}`" for c in df.columns]
    made = F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in through))))
    return df.select(*(c for c in named if c.strip("`") not in through), made).select(*named)
