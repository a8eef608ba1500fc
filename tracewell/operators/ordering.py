"""Row numbers and running sums over a whole table without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .projection import stored


def numbered(df: DataFrame, keys: Sequence[Column], running: dict[str, str] | None = None, name: str = "number") -> DataFrame:
    """``df`` with its row number by ``keys`` from 1 and, for each ``running`` (new column: column), the sum of the column
    up to and with the row (null counts as zero).

    A range shuffle puts the rows in order, each partition numbers its own, and the sizes and sums of the partitions, one
    small row each, say where the next one begins. Rows with equal keys are numbered in any order."""
    running = running or {}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The id holds the partition in its upper 31 bits and the row's place there in the lower 33.
    placed = stored(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumns({"__part": F.shiftright("__id", 33).cast("int"), "__at": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(n) for n, c in running.items()]
    before, begin = [0] * (1 + len(running)), []
    for row in sorted(tuple(r) for r in placed.groupBy("__part").agg(F.count("*").alias("__n"), *sums).collect()):
        begin.append((row[0], *before))
        before = [x + y for x, y in zip(before, row[1:], strict=True)]
    starts = df.sparkSession.createDataFrame(begin, "__part int, __before long" + "".join(f", __{n} long" for n in running))
    out = placed.join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + F.col("__at") + 1)
    if running:
        within = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({n: F.col(f"__{n}") + F.sum(F.coalesce(F.col(c), F.lit(0))).over(within) for n, c in running.items()})
    return out.select(*df.columns, name, *running)
