"""Joins whose left side may have hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes, by the caller's measure of a row, up to which the right side is broadcast.
MAX_BROADCAST_BYTES = 16 << 20
#: Parts into which each key's rows are split beyond that.
SALTS = 16


def join_hot(
    rows: DataFrame, table: DataFrame, on: list[str], spread: Column, how: str = "inner", *, width: Column | int = 64, where: Column | None = None, max_bytes: int = MAX_BROADCAST_BYTES, salts: int = SALTS,
) -> DataFrame:
    """rows joined with a staged table that has few rows for each key, while rows may have many.

    width is about how many bytes a row of table takes; its sum is measured. Up to max_bytes the
    table is broadcast, so rows are not shuffled at all. Beyond, each key's rows are split by
    spread, a whole number that differs between them, and the table is copied to every split.
    how is inner, left or left_anti; where is a further condition of left_anti. Rows and results are the same either way; null keys match
    nothing, as in any join.
    """
    size = table.agg(F.sum(F.lit(width) if isinstance(width, int) else width)).first()[0] or 0
    if size <= max_bytes:
        return _join(rows, F.broadcast(table), on, how, where)
    salt = "_salt"
    while salt in rows.columns or salt in table.columns:
        salt += "_"
    split = rows.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return _join(split, copies, [*on, salt], how, where).drop(salt)


def _join(rows: DataFrame, table: DataFrame, on: list[str], how: str, where: Column | None) -> DataFrame:
    if where is None:
        return rows.join(table, on, how)
    for name in on:
        table = table.withColumnRenamed(name, f"_of_table_{name}")
        where = where & (F.col(name) == F.col(f"_of_table_{name}"))
    return rows.join(table, where, how)
