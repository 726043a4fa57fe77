"""A fluent query builder that ends in a DataFrame plan instead of SQL text."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Comparison operators that ``where`` takes.
OPERATORS = ("=", "!=", "<", ">", "<=", ">=", "IN", "NOT IN", "LIKE", "NOT LIKE", "BETWEEN", "IS NULL", "IS NOT NULL")


def predicate(column: str, operator: str, value=None) -> Column:
    """One condition; LIKE ignores ASCII case, an empty IN matches nothing."""
    c, op = F.col(column), operator.upper()
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {operator!r}")
    if op in ("IN", "NOT IN"):
        hit = c.isin(list(value)) if value else F.lit(False)
        return hit if op == "IN" else ~hit
    if op in ("LIKE", "NOT LIKE"):
        return c.ilike(value) if op == "LIKE" else ~c.ilike(value)
    if op == "BETWEEN":
        return c.between(*value)
    if op in ("IS NULL", "IS NOT NULL"):
        return c.isNull() if op == "IS NULL" else c.isNotNull()
    return {"=": c == value, "!=": c != value, "<": c < value, ">": c > value, "<=": c <= value, ">=": c >= value}[op]


@dataclass
class Query:
    """``Query(spark).table(df).where(...).group_by(...).select(...)``; nothing runs before ``build().collect()`` or the like."""

    spark: SparkSession
    _from: DataFrame | None = None
    _columns: list = field(default_factory=list)
    _where: list = field(default_factory=list)
    _joins: list = field(default_factory=list)
    _group: list = field(default_factory=list)
    _having: list = field(default_factory=list)
    _order: list = field(default_factory=list)
    _distinct: bool = False
    _limit: int | None = None
    _offset: int | None = None

    def table(self, source: DataFrame | str) -> Query:
        self._from = self.spark.table(source) if isinstance(source, str) else source
        return self

    def select(self, *columns) -> Query:
        self._columns += [F.expr(c) if isinstance(c, str) else c for c in columns]
        return self

    def distinct(self) -> Query:
        self._distinct = True
        return self

    def where(self, column: str, operator: str, value=None) -> Query:
        self._where.append(predicate(column, operator, value))
        return self

    def where_raw(self, sql: str) -> Query:
        self._where.append(F.expr(sql))
        return self

    def join(self, other: DataFrame, on, how: str = "inner") -> Query:
        self._joins.append((other, on, how))
        return self

    def left_join(self, other: DataFrame, on) -> Query:
        return self.join(other, on, "left")

    def group_by(self, *columns: str) -> Query:
        self._group += columns
        return self

    def having(self, sql: str) -> Query:
        self._having.append(F.expr(sql))
        return self

    def order_by(self, column: str, direction: str = "ASC") -> Query:
        """Nulls come first in ascending order and last in descending order."""
        self._order.append(F.col(column).desc_nulls_last() if direction.upper() == "DESC" else F.col(column).asc_nulls_first())
        return self

    def limit(self, n: int) -> Query:
        self._limit = n
        return self

    def offset(self, n: int) -> Query:
        self._offset = n
        return self

    def build(self) -> DataFrame:
        if self._from is None:
            raise ValueError("no table")
        if self._offset is not None and self._limit is None:
            raise ValueError("OFFSET needs LIMIT")
        df = reduce(lambda d, j: d.join(j[0], j[1], j[2]), self._joins, self._from)
        df = reduce(lambda d, c: d.where(c), self._where, df)
        if self._group:
            aggregates = self._columns or [F.count(F.lit(1)).alias("count")]
            df = df.groupBy(*self._group).agg(*aggregates)
            df = reduce(lambda d, c: d.where(c), self._having, df)
        elif self._columns:
            df = df.select(*self._columns)
        df = df.distinct() if self._distinct else df
        df = df.orderBy(*self._order) if self._order else df
        df = df.offset(self._offset) if self._offset else df
        return df.limit(self._limit) if self._limit is not None else df

    def count(self) -> int:
        return self.build().count()
