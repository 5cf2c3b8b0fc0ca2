"""Tables that several rules need, built and stored once: plans that mean the same are told by their structure."""

from __future__ import annotations

from pyspark.sql import DataFrame

from latticework.sources.shared import stored


class Kept:
    """A store of tables by the meaning of their plans. What is asked for again, by the same or by another plan of equal structure over the same
    tables, is the table that was stored the first time. Plans without a fixed result (random numbers) are never the same.
    """

    def __init__(self) -> None:
        self.tables: dict[int, list[tuple[DataFrame, DataFrame]]] = {}
        self.built = self.asked = 0

    def once(self, df: DataFrame, name: str = "kept") -> DataFrame:
        self.asked += 1
        same = self.tables.setdefault(df.semanticHash(), [])
        for known, table in same:
            if known.sameSemantics(df):
                return table.select(*(table[a].alias(b) for a, b in zip(table.columns, df.columns)))
        table = stored(df, name)
        same.append((df, table))
        self.built += 1
        return table
