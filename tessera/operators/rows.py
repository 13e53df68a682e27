"""Structure of row sets: stacking and unstacking, gathers, folds, checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stacked(parts: list[DataFrame], name: str = "part") -> DataFrame:
    """All rows, with the number of the part that each comes from; the parts' columns must have equal names and types."""
    first = [(f.name, f.dataType) for f in parts[0].schema]
    for k, p in enumerate(parts):
        if [(f.name, f.dataType) for f in p.schema] != first:
            raise ValueError(f"part {k} has other columns than part 0")
    return reduce(DataFrame.unionByName, [p.withColumn(name, F.lit(k)) for k, p in enumerate(parts)])


def unstacked(whole: DataFrame, count: int, name: str = "part") -> list[DataFrame]:
    """The parts of a stack again; one may be empty."""
    return [whole.where(F.col(name) == k).drop(name) for k in range(count)]


def gathered(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows by key, once for each time that `wanted` names it, with wanted's other columns (for instance a place)."""
    return wanted.join(rows, key)


def single(rows: DataFrame) -> DataFrame:
    """The one row; an error with none or several."""
    n = rows.limit(2).count()
    if n != 1:
        raise ValueError("not one row")
    return rows


def with_column_of(rows: DataFrame, key: str, values: DataFrame, column: str) -> DataFrame:
    """rows with a column taken from values by key, in place of one that they have; null where there is none."""
    return rows.drop(column).join(values.select(key, column), key, "left")


def folded(rows: DataFrame, keys: list[str], start: Callable[[pa.Table], pa.Table], merge: Callable[[pa.Table], pa.Table], schema: str, spread: int = 32) -> DataFrame:
    """A fold over groups of any size: `start` turns a batch into small states, `merge` joins states of one group into one.

    merge must not mind order or grouping. States are merged in two levels, so
    a hot group's batches don't all go to one task.
    """

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from start(pa.Table.from_batches([b])).to_batches()

    states = rows.mapInArrow(begin, schema)
    names = states.columns
    halfway = states.withColumn("fold_part", F.pmod(F.monotonically_increasing_id(), F.lit(spread)))
    halfway = halfway.groupBy(*keys, "fold_part").applyInArrow(lambda t: merge(t.select(names)), schema)
    return halfway.groupBy(*keys).applyInArrow(lambda t: merge(t.select(names)), schema)


def finite(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows, but an error as soon as an array in one of the columns holds NaN or an infinity."""

    def bad(c: str) -> Column:
        return F.exists(F.col(c), lambda v: F.isnan(v) | (F.abs(v) == float("inf")))

    for c in columns:
        rows = rows.withColumn(c, F.when(F.coalesce(bad(c), F.lit(False)), F.raise_error(F.lit(f"{c} isn't finite")).cast(rows.schema[c].dataType)).otherwise(F.col(c)))
    return rows


def not_finite(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many rows have NaN or an infinity in an array, by column."""
    return rows.agg(*[F.count_if(F.exists(F.col(c), lambda v: F.isnan(v) | (F.abs(v) == float("inf")))).alias(c) for c in columns])
