"""Places for functions of the user: over groups, dates, entities and folds, a bounded block of rows at a time.

Functions take and give Arrow tables with a declared schema. Groups of any size are cut into blocks of consecutive rows, each with the
rows before it as context, so a task holds ``block_rows`` rows and the context, whatever the group's size.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written

Transform = Callable[[pa.Table], pa.Table]


def _blocks(df: DataFrame, keys: list[str], order: list[str], block_rows: int, context: int) -> DataFrame:
    """The rows with _b (block), _n (place in the group) and _own; context rows are copies from the blocks before."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    placed = df.withColumn("_n", n.cast("long"))
    own, last = F.floor(F.col("_n") / block_rows).cast("long"), F.floor((F.col("_n") + context) / block_rows).cast("long")
    return placed.withColumn("_mine", own).withColumn("_b", F.explode(F.sequence(own, last))).withColumn("_own", F.col("_b") == F.col("_mine")).drop("_mine")


def transform_groups(df: DataFrame, keys: list[str], order: list[str], f: Transform, schema: str, context: int = 0, block_rows: int = 100_000) -> DataFrame:
    """Each group's rows through ``f``, which gives one row for each row, in order; the rows of the context are dropped after.

    ``f`` sees at least ``context`` rows before each row of its own, or all there are: a function that looks back no further gives
    what it would over whole groups. It gets the columns of the table alone.
    """
    columns = df.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_n")
        return f(table.select(columns)).filter(table.column("_own"))

    return _blocks(df, keys, order, block_rows, context).groupBy(*keys, "_b").applyInArrow(run, schema)


def reduce_groups(df: DataFrame, keys: list[str], partial: Transform, merge: Transform, partial_schema: str, schema: str, buckets: int = 64) -> DataFrame:
    """Each group through ``partial`` in up to ``buckets`` parts by a hash of the row, and their rows through ``merge``.

    For a function that needs its group whole, ``buckets=1`` and groups that are known to be small, such as the rows of a date.
    """
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(*df.columns), F.lit(buckets)))
    parts = dealt.groupBy(*keys, "_b").applyInArrow(lambda table: partial(table.drop_columns(["_b"])), partial_schema)
    return parts.groupBy(*keys).applyInArrow(merge, schema)


def detect(df: DataFrame, entity: str, date: str, detectors: dict[str, Transform], schema: str, context: int, block_rows: int = 100_000) -> DataFrame:
    """The rows that the detectors find in each entity's series, with the detector's name: any number for each.

    ``schema`` is that of a detector's rows and must have the date by which a finding belongs to a block; findings on context rows
    are dropped, since the block before has them.
    """
    columns = df.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_n")
        mine = table.filter(table.column("_own")).column(date)
        out = []
        for name, f in detectors.items():
            found = f(table.select(columns))
            found = found.filter(pc.is_in(found.column(date), value_set=mine.combine_chunks()))
            out.append(found.append_column("detector", pa.array([name] * found.num_rows, pa.string())))
        return pa.concat_tables(out)

    return _blocks(df, [entity], [date], block_rows, context).groupBy(entity, "_b").applyInArrow(run, f"{schema}, detector string")


def fold_scores(df: DataFrame, folds: DataFrame, place: str, fit: Callable[[DataFrame], object], score: Callable[[DataFrame, object], DataFrame]) -> DataFrame:
    """The rows of every fold's test, scored by what ``fit`` made of the rows of its training, with the fold's number.

    Folds (fold, train_from, train_to, test_from, test_to in places of a calendar) are a few rows; each is a Spark job of ``fit``'s own.
    ``place`` names the column that holds a row's place, so training and test are range filters. The rows are written once and read for
    each fold: what they come from is not computed again.
    """
    df, out = written(df), None
    for k in folds.orderBy("fold").collect():
        model = fit(df.where(F.col(place).between(k.train_from, k.train_to)))
        one = score(df.where(F.col(place).between(k.test_from, k.test_to)), model).withColumn("fold", F.lit(k.fold))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no folds")
    return out
