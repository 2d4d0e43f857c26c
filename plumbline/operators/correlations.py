"""Pearson correlation of every pair of columns over the complete rows, from one scan.

Few columns are one aggregate of built-in functions.  Many columns become a blocked matrix of
centred co-moments: a task keeps, per column and block of columns, counts, means, sums of squares
and sums of products about the means, updates them a batch at a time by one matrix product, and
emits one short row per column and block.  Such rows merge pairwise and in any order, so they are
merged as a stream in two shuffles; no task holds more than one batch of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.clean import Frame
from plumbline.operators.local import local_table
from plumbline.operators.profile import Column_

#: Up to so many columns are one aggregate: its generated code grows with the number of pairs.
FEW_COLUMNS = 20
BLOCK_COLUMNS = 256
BATCH_CELLS = 1 << 22
#: Partial rows of one column and block are merged in so many groups first.
MERGE_GROUPS = 64

MOMENTS = (
    "i int, block int, part long, n double, mean_i double, squares_i double, "
    "means array<double>, squares array<double>, products array<double>"
)
_NAMES = [f.split()[0] for f in MOMENTS.split(", ")]
_LIST = pa.list_(pa.float64())
_SCHEMA = pa.schema(
    list(zip(_NAMES, [pa.int32(), pa.int32(), pa.int64(), *[pa.float64()] * 3, *[_LIST] * 3]))
)


class Moments:
    """Centred co-moments of the rows seen so far; needs width² doubles."""

    def __init__(self, width: int):
        self.n, self.means, self.products = 0, np.zeros(width), np.zeros((width, width))

    def add(self, rows: np.ndarray) -> None:
        if not len(rows):
            return
        with np.errstate(invalid="ignore"):  # a column with an infinite value has no correlation
            means = rows.mean(axis=0)
            centred = rows - means
            total = self.n + len(rows)
            away = means - self.means
            self.products += centred.T @ centred + np.outer(away, away) * (self.n * len(rows) / total)
            self.means = self.means + away * (len(rows) / total)
        self.n = total

    def rows(self, part: int) -> Iterator[pa.RecordBatch]:
        """One row per column i and block of columns that holds a column from i on."""
        width, squares = len(self.means), np.diag(self.products)
        for i in range(width):
            starts = range(i // BLOCK_COLUMNS * BLOCK_COLUMNS, width, BLOCK_COLUMNS)
            blocks = [slice(s, s + BLOCK_COLUMNS) for s in starts]
            columns = [
                [i] * len(blocks), [s // BLOCK_COLUMNS for s in starts], [part] * len(blocks), [float(self.n)] * len(blocks),
                [self.means[i]] * len(blocks), [squares[i]] * len(blocks),
                [self.means[b] for b in blocks], [squares[b] for b in blocks], [self.products[i, b] for b in blocks],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _partial(rows: DataFrame, width: int) -> DataFrame:
    """The co-moments of each task's complete rows."""

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found, step = Moments(width), max(1, BATCH_CELLS // width)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns])
                found.add(values[~np.isnan(values).any(axis=1)])  # NULL arrives as NaN
        if found.n:
            yield from found.rows(TaskContext.get().partitionId())

    return rows.mapInArrow(sum_up, MOMENTS)


def _merged(partial: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key, merged while the sorted rows stream by."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*now, *held], _SCHEMA)], schema=_SCHEMA)

        for batch in batches:
            fields = [c.to_pylist() if c.type != _LIST else c for c in batch.columns]
            for k in range(batch.num_rows):
                i, block, part, n, mean, own = (f[k] for f in fields[:6])
                arrays = [f[k].values.to_numpy() for f in fields[6:]]
                key = (i, block, part if "part" in keys else 0)
                if key != now:
                    if now is not None:
                        yield out()
                    now, held = key, [n, mean, own, *arrays]
                    continue
                total = held[0] + n
                weight, share = held[0] * n / total, n / total
                with np.errstate(invalid="ignore"):
                    away, aways = mean - held[1], arrays[0] - held[3]
                    held = [
                        total, held[1] + away * share, held[2] + own + away * away * weight, held[3] + aways * share,
                        held[4] + arrays[1] + aways * aways * weight, held[5] + arrays[2] + away * aways * weight,
                    ]
        if now is not None:
            yield out()

    dealt = partial.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(merge, MOMENTS)


def _of_many(rows: DataFrame, width: int) -> DataFrame:
    """(i, j, r) of the pairs i < j by place; no row if there are no complete rows."""
    groups = _partial(rows, width).withColumn("part", F.pmod(F.col("part"), F.lit(MERGE_GROUPS).cast("long")))
    merged = _merged(_merged(groups, ["i", "block", "part"]), ["i", "block"])
    cells = merged.select("i", "block", "squares_i", F.posexplode(F.arrays_zip("squares", "products")).alias("k", "cell"))
    j = F.col("block") * BLOCK_COLUMNS + F.col("k")
    spread = F.sqrt("squares_i") * F.sqrt("cell.squares")
    r = F.when(spread != 0, F.col("cell.products") / spread)
    return cells.select("i", j.cast("int").alias("j"), r.alias("r")).where("j > i")


def _of_few(rows: DataFrame, width: int) -> DataFrame:
    """(i, j, r) of all pairs by place, from one aggregate row."""
    spreads = [F.stddev_samp(f"x{i}").alias(f"s{i}") for i in range(width)]
    pairs = [(i, j) for i in range(width) for j in range(i + 1, width)]
    row = rows.agg(*spreads, *[F.covar_samp(f"x{i}", f"x{j}").alias(f"v{i}_{j}") for i, j in pairs])
    found = []
    for i, j in pairs:
        spread = F.col(f"s{i}") * F.col(f"s{j}")
        r = F.when(spread != 0, F.col(f"v{i}_{j}") / spread)
        found.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), r.alias("r")))
    return row.select(F.inline(F.array(*found)))


def correlations(frame: Frame, columns: Sequence[Column_], few: int = FEW_COLUMNS) -> DataFrame:
    """(pos_1, pos_2, r) of every pair of columns, in their order, as a distributed table.

    Rows that miss one of the columns are left out.  r is NULL where a column does not vary, holds
    an infinite value, or fewer than two rows are complete.
    """
    spark, width = frame.df.sparkSession, len(columns)
    if width < 2:
        return local_table(spark, [], "pos_1 int, pos_2 int, r double")
    places = local_table(spark, [(i, c.pos) for i, c in enumerate(columns)], "i int, pos_1 int")
    cells = [f"CAST(c{c.pos} AS DOUBLE) AS x{i}" for i, c in enumerate(columns)]
    if width <= few:
        found = _of_few(frame.df.where(frame.all_present([c.pos for c in columns])).selectExpr(*cells), width)
    else:  # pairs stay in the table when no row is complete
        later = F.when(F.col("i") < width - 1, F.sequence(F.col("i") + 1, F.lit(width - 1)))
        every = places.select("i", F.explode(later).alias("j"))
        found = every.join(_of_many(frame.df.selectExpr(*cells), width), ["i", "j"], "left")
    other = places.toDF("j", "pos_2")
    named = found.join(F.broadcast(places), "i").join(F.broadcast(other), "j")  # one row per column
    return named.select("pos_1", "pos_2", F.when(~F.isnan("r"), F.col("r")).alias("r"))
