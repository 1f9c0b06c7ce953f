"""Hot keys: measure them, and split their rows over several tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chaintrail.session import materialise

ROWS_PER_PART = 1_000_000
BROADCAST_ROWS = 50_000


def broadcast_checked(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the frame was counted to be small; otherwise shuffle."""
    if rows is None:
        rows = df.limit(limit + 1).count()
    return F.broadcast(df) if rows <= limit else df


class HotKeySplit:
    """Joins `many` (rows per key unbounded) with frames that hold few rows per key.

    Keys with more than `rows_per_part` rows are cut into parts: their rows in
    `many` are spread by a hash, and matching rows on the other side are repeated
    once per part. Without a hot key nothing is added to either side.
    """

    def __init__(self, many: DataFrame | None, key: str, rows_per_part: int = ROWS_PER_PART, counts: DataFrame | None = None):
        """`counts` (key, count) saves counting `many` where the counts are known."""
        if counts is None:
            counts = many.where(F.col(key).isNotNull()).groupBy(key).count()
        counts = counts.where(F.col("count") > rows_per_part)
        hot = materialise(
            counts.select(
                F.col(key).alias("_hot"), F.ceil(F.col("count") / rows_per_part).cast("int").alias("_parts")
            ),
            "hot-keys",
        )
        rows = hot.count()
        self.key = key
        self.hot = broadcast_checked(hot, rows) if rows else None

    @classmethod
    def none(cls, key: str) -> HotKeySplit:
        """For a frame that has too few rows for a hot key; nothing is counted."""
        split = object.__new__(cls)
        split.key, split.hot = key, None
        return split

    def by(self, key: str) -> HotKeySplit:
        """The same hot values under another column, for a frame with no more rows per value."""
        other = HotKeySplit.none(key)
        other.hot = self.hot
        return other

    def _parts(self, df: DataFrame, key: str) -> DataFrame:
        return df.join(self.hot, F.col(key) == F.col("_hot"), "left").drop("_hot")

    def spread(self, many: DataFrame, by: list[str]) -> DataFrame:
        """Add `_part` to the big side; `by` are the columns whose hash picks the part."""
        if self.hot is None:
            return many
        part = F.pmod(F.xxhash64(*by), F.coalesce(F.col("_parts"), F.lit(1))).cast("int")
        return self._parts(many, self.key).withColumn("_part", part).drop("_parts")

    def repeat(self, few: DataFrame, key: str) -> DataFrame:
        """Repeat rows of a hot key once per part."""
        if self.hot is None:
            return few
        last = F.coalesce(F.col("_parts"), F.lit(1)) - 1
        return self._parts(few, key).withColumn("_of_part", F.explode(F.sequence(F.lit(0), last))).drop("_parts")

    def on(self, many: DataFrame, few: DataFrame, key: str) -> Column:
        condition = many[self.key] == few[key]
        return condition if self.hot is None else condition & (many["_part"] == few["_of_part"])

    def keys(self) -> list[str]:
        return [self.key] if self.hot is None else [self.key, "_part"]
