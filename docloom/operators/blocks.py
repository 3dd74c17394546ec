"""Two tables that must meet row by row, in blocks of bounded size.

Every block of one side meets every block of the other in a task of its own: nothing
is collected, broadcast or paired by Spark, and neither side needs to fit anywhere. A
row is shuffled once for each block of the other side."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import ship


def meet(left: DataFrame, right: DataFrame, key_left: str, key_right: str, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, rows_left: int = 4096, rows_right: int = 65_536) -> DataFrame:
    """``kernel`` over each pair of blocks of about so many rows; columns must differ
    from ``__left`` and ``__right``. An empty side gives no calls with rows of both."""
    ship(left.sparkSession)
    blocks = [max(1, -(-df.count() // rows)) for df, rows in ((left, rows_left), (right, rows_right))]

    def dealt(df: DataFrame, key: str, own: int):
        names = ("__left", "__right")
        df = df.withColumn(names[own], F.pmod(F.xxhash64(key), F.lit(blocks[own])).cast("int"))
        return df.withColumn(names[1 - own], F.explode(F.sequence(F.lit(0), F.lit(blocks[1 - own] - 1)))).groupBy(*names)

    return dealt(left, key_left, 0).cogroup(dealt(right, key_right, 1)).applyInPandas(kernel, schema)
