"""Duplicate rows: counts, and positions of second and later copies."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import values as V
from plumbline.operators.clean import Frame, normalized
from plumbline.operators.local import local_table
from plumbline.operators.shared import ensure_checkpoint_dir

#: Bits of the filter of a second scan; its broadcast has a word of 64 bits per row.
FILTER_BITS = 1 << 26
#: Rows of a repeated key that are written out by one step.
ROWS_PER_STEP = 1 << 16

# Nested values as text keep microseconds and say which fields are NULL.
_EXACT = (
    "map('timestampFormat', \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX\", "
    "'timestampNTZFormat', \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\", 'ignoreNullFields', 'false')"
)


def _values(frame: Frame) -> list[str]:
    """The cells of a row as they are compared."""
    return [
        f"to_json(struct(c{p}), {_EXACT})" if kind == "nested" else f"c{p}"
        for p, kind in enumerate(frame.kinds)
    ]


def fingerprint(frame: Frame) -> list[Column]:
    """128-bit row key: two hashes of all columns, started from different values.

    A row costs 16 bytes in the shuffle however wide it is.  Which columns are NULL is
    hashed too (one bit mask per 32 columns), because the hash function skips NULLs.
    """
    masks = [
        " + ".join(f"if(c{p} IS NULL, {1 << (p - start)}L, 0L)" for p in range(start, min(start + 32, frame.width)))
        for start in range(0, frame.width, 32)
    ]
    parts = ", ".join(_values(frame) + masks)
    return [
        F.expr(f"xxhash64(17, {parts})").alias("h1"),
        F.expr(f"xxhash64(1000003, 'row', {parts})").alias("h2"),
    ]


Key = Callable[[Frame], list[Column]]


def _groups(frame: Frame, key: Key, summed: Sequence[str]) -> DataFrame:
    """Rows by row key: combined on the map side, a row repeated billions of times is one row per task."""
    rows = frame.df.select(*key(frame), *summed)
    return rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("cnt"), *[F.sum(c).alias(c) for c in summed])


def _place(h1: str) -> tuple[Column, Column]:
    """Word and bit of a key in the bit table.

    Neither can be NULL if the key isn't, so no test of them is pushed below the projection of the
    rows, where it would evaluate the whole key a second time.
    """
    place = F.col(h1).bitwiseAND(F.lit(FILTER_BITS - 1).cast("bigint"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
    return F.shiftright(place, 6), bit


def _among(frame: Frame, key: Key, words: DataFrame) -> DataFrame:
    """The rows, cells ``v0`` ..., that may repeat others, from a second scan.

    ``words``, the bit table of repeated keys (at most 2^20 words), is broadcast and drops nearly all
    other rows where they are read.
    """
    cells = [F.expr(v).alias(f"v{i}") for i, v in enumerate(_values(frame))]
    word, bit = _place("h1")
    rows = frame.df.select(*key(frame), *cells).withColumns({"word": word, "bit": bit})
    near = rows.join(F.broadcast(words.select("word", "bits")), "word").where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
    return near.select(*[f"v{i}" for i in range(frame.width)])


def duplicate_figures(frame: Frame, summed: Sequence[str] = (), key: Key = fingerprint) -> dict[str, int]:
    """Row count, duplicate rows (copies after the first), and sums of ``summed``, from one scan.

    Copies are found by their row key.  Only if some are found, the rows of those groups are read
    once more and compared whole, so rows that merely share a key, or a bit of the table, are not
    counted: each is a group of its own there.
    """
    sums = [F.sum(c).alias(c) for c in summed]
    word, bit = _place("h1")
    # the groups of one row in a task are one row without a word
    words = (
        _groups(frame, key, summed)
        .groupBy(F.when(F.col("cnt") > 1, word).alias("word"))
        .agg(F.bit_or(bit).alias("bits"), F.sum("cnt").alias("cnt"), *sums)
        .persist()
    )
    try:
        head = words.agg(
            F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_rows"),
            F.count("word").alias("repeated"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in summed],
        ).first()
        duplicates = 0
        if head["repeated"]:
            rows = _among(frame, key, words.where("word IS NOT NULL"))
            same = rows.groupBy(*rows.columns).agg((F.count(F.lit(1)) - 1).alias("later"))
            duplicates = same.agg(F.coalesce(F.sum("later"), F.lit(0)).alias("later")).first()["later"]
    finally:
        words.unpersist()
    return {"total_rows": head["total_rows"], "duplicate_count": duplicates, **{c: head[c] for c in summed}}


def duplicate_summary(frame: Frame, key: Key = fingerprint) -> DataFrame:
    """One row: row count, duplicate rows (copies after the first), their share."""
    found = duplicate_figures(frame, key=key)
    row = local_table(frame.df.sparkSession, [(found["total_rows"], found["duplicate_count"])], "total_rows bigint, duplicate_count bigint")
    return row.withColumn("duplicate_rate", V.ratio(F.col("duplicate_count"), F.col("total_rows")))


def duplicate_positions(
    df: DataFrame,
    order_by: Sequence[str],
    compare: Sequence[str] | None = None,
    user_missing_codes: Sequence[object] | None = None,
    rows_per_step: int = ROWS_PER_STEP,
) -> DataFrame:
    """Keys of every row that repeats an earlier row in the ``compare`` columns.

    ``order_by`` names the columns that give the order of the rows (add one with
    :func:`with_row_position` when the table has none).  The first key of each group is
    found with a mergeable ``min``, and one row with that key is the first; so keys may
    repeat, and one huge group of copies never meets in a task.  A key that repeats is written out
    in steps of ``rows_per_step`` rows, which are dealt to all tasks before they become rows.
    """
    names = list(df.columns)
    compare = [n for n in names if n not in order_by] if compare is None else list(compare)
    view = df.toDF(*[f"x{i}" for i in range(len(names))])
    dtypes = [df.schema.fields[names.index(n)].dataType for n in compare]
    cells = [
        F.expr(normalized(f"x{names.index(n)}", t, user_missing_codes)).alias(f"c{i}")
        for i, (n, t) in enumerate(zip(compare, dtypes))
    ]
    keys = [F.col(f"x{names.index(n)}").alias(f"k{i}") for i, n in enumerate(order_by)]
    # one plain column keeps the aggregate in hash tables
    key = keys[0] if len(keys) == 1 else F.struct(*keys)
    frame = Frame(view.select(key.alias("key"), *cells), tuple(compare), tuple(dtypes))
    hashed = frame.df.select("key", *fingerprint(frame))
    counted = hashed.groupBy("h1", "h2", "key").agg(F.count(F.lit(1)).alias("copies"))
    firsts = counted.groupBy("h1", "h2").agg(F.min("key").alias("first"))
    later = counted.join(firsts, ["h1", "h2"]).withColumn(
        "later", F.col("copies") - F.col("key").eqNullSafe(F.col("first")).cast("bigint")
    )
    rows = _written_out(later.where("later > 0").select("key", "later"), rows_per_step).select("key")
    cells = [F.col("key") if len(keys) == 1 else F.col(f"key.k{i}") for i in range(len(keys))]
    return rows.select(*[cell.alias(name) for cell, name in zip(cells, order_by)])


def _written_out(counted: DataFrame, rows_per_step: int) -> DataFrame:
    """``later`` rows per row of ``counted``, by way of steps that any task may take.

    The first expansion has one row per step, the second at most ``rows_per_step`` rows; neither
    builds an array as long as the count.
    """
    one, size = F.lit(1).cast("bigint"), F.lit(rows_per_step).cast("bigint")
    steps = counted.withColumn("step", F.explode(F.sequence(one, F.ceil(F.col("later") / size))))
    left = F.least(size, F.col("later") - (F.col("step") - 1) * size)
    dealt = steps.select("key", "step", left.alias("left")).repartition("key", "step")
    return dealt.select("key", F.explode(F.sequence(one, "left")))


def _places(df: DataFrame, *names: str) -> DataFrame | None:
    """``df`` with the named places of its rows in their files as _f0, _f1, ...; None if it has none."""
    try:
        return df.select("*", *[F.col("_metadata")[n].alias(f"_f{i}") for i, n in enumerate(names)])
    except AnalysisException:
        return None


def _offsets(rows: DataFrame, keys: Sequence[str], index: str) -> tuple[DataFrame, bool]:
    """Per key the rows before it, in the order of the keys, and whether ``index`` counts each key's rows without a gap."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(index).alias("_low"), F.max(index).alias("_high"))
    before = F.sum("_n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("_offset", F.coalesce(before, F.lit(0)))
    whole = sizes.agg(F.bool_and(F.col("_high") - F.col("_low") + 1 == F.col("_n")).alias("whole")).first()["whole"]
    return sizes.select(*keys, "_low", "_offset"), whole is not False


def with_row_position(df: DataFrame, name: str = "position") -> DataFrame:
    """Number the rows 1..n in file order (files by path) without moving them to one task.

    Rows of Parquet files carry their index, so positions are the same whatever the splits, and any
    task that is run again finds the same ones.  Rows of other files are numbered within their byte
    range, rows without files within their partition; such a number depends on the run, and the
    numbered rows are therefore checkpointed before they are used twice.  Only one row per file,
    range or partition goes into the running sums and back as a broadcast.
    """
    indexed = _places(df, "file_path", "row_index")
    if indexed is not None:
        offsets, whole = _offsets(indexed.select("_f0", "_f1"), ["_f0"], "_f1")
        if whole:  # no row was left out between the files and here
            place = F.col("_offset") + F.col("_f1") - F.col("_low") + 1
            return indexed.join(F.broadcast(offsets), "_f0").select(*_quoted(df), place.alias(name))
    ensure_checkpoint_dir(df.sparkSession)
    ranged = _places(df, "file_path", "file_block_start")
    if ranged is None:
        ranged = df.withColumns({"_f0": F.lit(""), "_f1": F.lit(0)})
    tagged = ranged.withColumn("_tag", F.monotonically_increasing_id()).checkpoint()
    offsets, whole = _offsets(tagged, ["_f0", "_f1"], "_tag")
    if not whole:  # ranges were shuffled since they were read
        tagged = tagged.withColumns({"_f0": F.lit(""), "_f1": F.shiftright("_tag", 33)})
        offsets, _ = _offsets(tagged, ["_f0", "_f1"], "_tag")
    place = F.col("_offset") + F.col("_tag") - F.col("_low") + 1
    return tagged.join(F.broadcast(offsets), ["_f0", "_f1"]).select(*_quoted(df), place.alias(name))


def _quoted(df: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
