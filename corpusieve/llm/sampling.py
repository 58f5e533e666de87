"""Bounded samples by hash: the same rows each time, wherever they are stored."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

_RANGE = 1 << 31
#: A text that is learned from has at most this part of the characters that all together may have.
SHARE = 64


def place(*key: str) -> Column:
    """A row's place in hash order, 0 to 2^31."""
    return F.pmod(F.xxhash64(*key), F.lit(_RANGE))


def _cut(n: int, total: Column) -> Column:
    """A bound of places below which about 2 n + 100 of ``total`` rows lie."""
    return F.least(F.lit(1.0), (2 * n + 100) / F.greatest(total, F.lit(1))) * _RANGE


def sampled(rows: DataFrame, n: int, *key: str) -> DataFrame:
    """The ``n`` rows that are first in hash order of ``key``. Counted first, so that all but about
    twice as many are dropped where they are read."""
    return rows.where(place(*key) < _cut(n, F.lit(rows.count()))).orderBy(place(*key), *key).limit(n)


def sampled_by(rows: DataFrame, group: str, n: int, most: int, groups: int, *key: str) -> DataFrame:
    """The first ``n`` rows of each group, ``most`` in all, in turns. Only the ``groups`` largest
    groups count, of equal ones the first by name."""
    cuts = rows.groupBy(group).agg(F.count("*").alias("_total")).orderBy(F.desc("_total"), group).limit(groups)
    kept = rows.join(F.broadcast(cuts), group).where(place(*key) < _cut(n, F.col("_total"))).drop("_total")  # at most ``groups`` rows
    turn = F.row_number().over(Window.partitionBy(group).orderBy(place(*key), *key))
    return kept.withColumn("_turn", turn).where(F.col("_turn") <= n).orderBy("_turn", group).limit(most).drop("_turn")


def learnable(rows: DataFrame, chars: int) -> DataFrame:
    """Rows with a text of at most a SHARE-th of ``chars`` characters: longer ones are never learned from,
    so one text can't take the place of others, and their length is seen before they leave an executor."""
    return rows.where(F.length("text") <= chars // SHARE)


def taken(rows: DataFrame, chars: int, *key: str) -> Iterator[Row]:
    """Rows with a text, in hash order of ``key``, as long as their texts have ``chars`` characters
    together; one that would be too much is left out and the next one tried. They come to the driver
    partition by partition, so what it holds is bounded."""
    for row in rows.orderBy(place(*key), *key).toLocalIterator():
        if len(row.text) <= chars:
            chars -= len(row.text)
            yield row
