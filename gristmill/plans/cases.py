"""Stand-in rows that mix several choices: every event takes one option of each list, in all combinations.

The oracle gets the numbers of the options as columns and says by rule what follows from them, so thousands of
combinations are held against it and not a list of examples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.plans import standins as S


class Book:
    """Queries of a module with their oracles."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str):
        def add(f):
            self.queries[f.__name__] = f
            self.oracles[f.__name__] = sql
            return f

        return add


def mixed(spark, d, **sizes: int) -> DataFrame:
    """id and a column for each list with the number of the option that the event takes."""
    at, out = 1, []
    for name, n in sizes.items():
        out.append((F.floor(F.col("event_id") / at) % n).cast("int").alias(name))
        at *= n
    return S.table(spark, d, "events").select(F.col("event_id").alias("id"), *out)


def mixed_sql(**sizes: int) -> str:
    """The same as a common table ``c``."""
    at, out = 1, []
    for name, n in sizes.items():
        out.append(f"(event_id // {at}) % {n} AS {name}")
        at *= n
    return f"c AS (SELECT event_id AS id, {', '.join(out)} FROM events)"


def pick(options: list, number: str) -> Column:
    return F.get(F.array(*map(F.lit, options)), F.col(number))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick_sql(options: list, number: str) -> str:
    """The option in SQL; None is NULL."""
    return f"list_value({', '.join('NULL' if x is None else quoted(x) if isinstance(x, str) else str(x) for x in options)})[{number} + 1]"
