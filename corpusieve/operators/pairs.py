"""A short list that meets all rows of a table: stated queries, keywords, seeds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are broadcast at most.
FEW = 10_000


def met(few: DataFrame, rows: DataFrame, most: int = FEW) -> DataFrame:
    """Every row with every one of ``few``. Up to ``most`` of these are broadcast, which is counted
    first. More of them are dealt to blocks of that size, to each of which all rows are sent in as many
    parts as there are shuffle partitions; so no task holds more than a block, and none all rows."""
    n = few.limit(most + 1).count()
    if n <= most:
        return rows.join(F.broadcast(few), F.lit(True), "inner")
    blocks = math.ceil(few.count() / most)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block, part = "_met_block", "_met_part"
    left = few.withColumn(block, F.pmod(F.xxhash64(*few.columns), F.lit(blocks)).cast("int")).withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = rows.withColumn(part, F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int")).withColumn(block, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return right.join(left, [block, part]).drop(block, part)
