"""CSV whose quoted fields may hold line breaks, read by many tasks, each file in its own encoding.

Where a record starts depends on the number of quotes before it, in the whole file.  So a first scan
lets every byte range report its parity of quotes, whether its lines are valid UTF-8, and the header
of its file; a running sum over the ranges of a file (one short row each) then tells every range
whether it starts inside quotes.  The second scan joins lines to records within its range; the parts
of a record that crosses a border of ranges are the only text that is shuffled.  Fields are parsed
by Spark's own CSV expression, record by record.

Line ends and quotes are single bytes in all supported encodings and no part of other characters,
so ranges need not be decoded for that.  Quotes must enclose whole fields and be doubled inside
them; a first scan that meets other quotes says so (``Layout.regular``), and the caller reads the
files in another way.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.local import local_table

# Encodings a caller may name, with the codec that decodes them.
CODECS = {"UTF-8": "utf-8", "UTF-8-BOM": "utf-8", "CP949": "cp949", "EUC-KR": "euc_kr"}
BOM = b"\xef\xbb\xbf"

BLOCKS = "file long, start long, size long, odd int, closes_open int, valid int, regular int, header binary"
RECORDS = "file long, owner long, start long, record string"

# What a field must look like to be a number or a truth value.
WHOLE = "^[+-]?[0-9]+$"
DOUBLE = "^([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?[dDfF]?|NaN|[+-]?Infinity|[+-]?Inf)$"
LONGEST_DECIMAL = 38


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file, start, size of the byte range, and line (bytes without the line feed), in file order per range."""
    where = F.col("_metadata")
    return spark.read.text(list(paths), lineSep="\n").select(
        F.xxhash64(F.input_file_name()).alias("file"),
        where["file_block_start"].alias("start"),
        where["file_block_length"].alias("size"),
        F.col("value").cast("binary").alias("line"),
    )


def _ranges(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """The batch cut where another byte range begins."""
    if not batch.num_rows:
        return
    file, start = (batch.column(n).to_numpy() for n in ("file", "start"))
    cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(file)]):
        yield int(file[a]), int(start[a]), batch.slice(a, b - a)


def _quotes(lines: pa.Array) -> np.ndarray:
    return pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64)


def _is_utf8(lines: pa.Array) -> bool:
    try:
        lines.cast(pa.string())
    except pa.ArrowInvalid:
        return False
    return True


@dataclass
class _Block:
    """What a byte range reports; parities count from its own start."""

    size: int
    odd: int = 0
    closes_open: int = 0  # a line ends outside quotes if the range starts inside
    valid: int = 1
    regular: int = 1
    header: bytes | None = None
    whole_header: bool = False


def _blocks(lines: DataFrame, sep: str, multi_line: bool) -> DataFrame:
    apart = "\\" + sep if sep in r"\^]-" else sep
    stray = f'[^"\\r{apart}]"[^"\\r{apart}]'

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], _Block] = {}
        for batch in batches:
            for file, start, part in _ranges(batch):
                block = found.setdefault((file, start), _Block(part.column("size")[0].as_py()))
                held = part.column("line")
                counts = _quotes(held) if multi_line else np.zeros(len(held), np.int64)
                after = (block.odd + np.cumsum(counts)) % 2
                if start == 0 and not block.whole_header:
                    ends = np.flatnonzero(after == 0)
                    upto = int(ends[0]) + 1 if len(ends) else len(held)
                    lines = held.slice(0, upto).to_pylist()
                    block.header = b"\n".join(lines if block.header is None else [block.header, *lines])
                    block.whole_header = len(ends) > 0
                block.odd = int(after[-1])
                block.closes_open |= int((after == 1).any())
                block.valid &= int(block.valid and _is_utf8(held))
                if multi_line and block.regular and counts.any():
                    quoted = held.filter(pa.array(counts > 0))
                    block.regular = int(not pc.any(pc.match_substring_regex(quoted, stray)).as_py())
        rows = [
            (file, start, b.size, b.odd, b.closes_open, b.valid, b.regular, b.header if b.whole_header else None)
            for (file, start), b in found.items()
        ]
        kinds = [pa.int64()] * 3 + [pa.int32()] * 4 + [pa.binary()]
        names = [f.split()[0] for f in BLOCKS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return lines.mapInArrow(report, BLOCKS)


@dataclass(frozen=True)
class Layout:
    """The ranges of all files with their true state, and what the driver needs to know of them.

    ``blocks`` has one short row per byte range, like the scan's own task list.
    """

    blocks: DataFrame
    header: bytes | None
    regular: bool
    crossing: bool


def layout(spark: SparkSession, paths: Sequence[str], encoding: str, sep: str, multi_line: bool) -> Layout:
    """Scan the files once and settle every range's state, every file's encoding, and the header."""
    lines = _lines(spark, paths)
    found = _blocks(lines, sep, multi_line)
    in_file, before = Window.partitionBy("file"), Window.partitionBy("file").orderBy("start")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    states = found.withColumn("inside", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2 == 1)
    after = (F.col("inside").cast("int") + F.col("odd")) % 2 == 1
    opens = after & (~F.col("inside") | (F.col("closes_open") == 1))
    states = states.withColumn("owner", F.last(F.when(opens, F.col("start")), ignorenulls=True).over(earlier))
    if encoding == "auto":  # CP949 contains EUC-KR, so nothing is left to try after it
        codec = F.when(F.min("valid").over(in_file) == 1, CODECS["UTF-8"]).otherwise(CODECS["CP949"])
    else:
        codec = F.lit(CODECS[encoding])
    states = states.withColumn("codec", codec).withColumn("balanced", F.sum("odd").over(in_file) % 2 == 0)
    states = states.persist()
    facts = states.agg(
        F.coalesce(F.bool_and((F.col("regular") == 1) & F.col("balanced")), F.lit(True)).alias("regular"),
        F.coalesce(F.bool_or("inside"), F.lit(False)).alias("crossing"),
    ).first()
    names = local_table(spark, [(i, p) for i, p in enumerate(sorted(lines.inputFiles()))], "place int, path string")
    named = names.select("place", F.xxhash64("path").alias("file"))
    first = states.where("start = 0").join(named, "file").orderBy("place").select("header", "codec").first()
    header = None
    if first is not None:
        if first["header"] is None:
            raise ValueError("the header is longer than the first byte range of its file")
        header = bytes(first["header"]).removeprefix(BOM).decode(first["codec"], "replace").removesuffix("\r")
    return Layout(states.select("file", "start", "size", "inside", "owner", "codec"), header, facts["regular"], facts["crossing"])


def _records(lines: DataFrame, blocks: DataFrame, multi_line: bool, crossing: bool) -> DataFrame:
    """Records that lie in one range (``owner`` NULL), or the parts of those that cross a border.

    A part belongs to the range in which its record opens.  Headers and blank records are left out.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codec, owner, opened, pending, at_header = None, "utf-8", None, None, None, False

        def cells(texts: pa.Array, owners: list[int | None]) -> pa.RecordBatch:
            if codec == "utf-8" and _is_utf8(texts):
                decoded = texts.cast(pa.string())
            else:
                decoded = pa.array([t.decode(codec, "replace") for t in texts.to_pylist()], pa.string())
            if not crossing:  # a record's last line may end in a carriage return, a part keeps it
                decoded = pc.replace_substring_regex(decoded, "\r$", "")
                kept = pc.not_equal(decoded, "")
                decoded = decoded.filter(kept)
                owners = owners[: len(decoded)]
            size = len(decoded)
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]] * size, pa.int64()), pa.array(owners, pa.int64()), pa.array([now[1]] * size, pa.int64()), decoded],
                names=[f.split()[0] for f in RECORDS.split(", ")],
            )

        def left_over() -> Iterator[pa.RecordBatch]:
            if crossing and now is not None and pending is not None:
                yield cells(pa.array([pending], pa.binary()), [opened])

        for batch in batches:
            for file, start, part in _ranges(batch):
                held = part.column("line")
                if (file, start) != now:
                    yield from left_over()
                    now, pending, at_header = (file, start), None, start == 0
                    state, owner, codec = (part.column(n)[0].as_py() for n in ("inside", "owner", "codec"))
                    state, opened = int(state), owner if state else start
                    if start == 0 and held[0].as_py().startswith(BOM):
                        held = pa.concat_arrays([pa.array([held[0].as_py()[3:]], pa.binary()), held.slice(1).cast(pa.binary())])
                counts = _quotes(held) if multi_line else np.zeros(len(held), np.int64)
                after = (state + np.cumsum(counts)) % 2
                state = int(after[-1])
                ends = np.flatnonzero(after == 0) + 1
                offsets = np.append(np.append(0, ends), np.full(state, len(held)))
                groups = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), held.cast(pa.binary()))
                texts = pc.binary_join(groups, b"\n")
                if pending is not None:  # the first group goes on with what the last batch left
                    first = pa.array([pending + b"\n" + texts[0].as_py()], pa.binary())
                    texts, pending = pa.concat_arrays([first, texts.slice(1)]), None
                if state:
                    pending = texts[-1].as_py()
                    texts = texts.slice(0, len(texts) - 1)
                if len(texts) and opened != start:  # the end of a record from an earlier range
                    if crossing:
                        yield cells(texts.slice(0, 1), [opened])
                    texts, opened = texts.slice(1), start
                if len(texts) and at_header:
                    texts, at_header = texts.slice(1), False
                if len(texts) and not crossing:
                    yield cells(texts, [None] * len(texts))
        yield from left_over()

    checked = F.when(F.col("inside").isNull(), F.raise_error(F.lit("the files or their byte ranges changed between two scans")))
    known = lines.join(F.broadcast(blocks), ["file", "start", "size"], "left")  # one row per byte range
    known = known.withColumn("inside", F.coalesce(checked.cast("boolean"), F.col("inside")))
    return known.select("file", "start", "line", "inside", "owner", "codec").mapInArrow(join, RECORDS)


def records(spark: SparkSession, paths: Sequence[str], plan: Layout, multi_line: bool) -> DataFrame:
    """One column ``record``: every record of the files but the headers, as text."""
    lines = _lines(spark, paths)
    whole = _records(lines, plan.blocks, multi_line, False).select("record")
    if not plan.crossing:
        return whole
    parts = _records(lines, plan.blocks, multi_line, True)
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("start", "record"))), lambda p: p["record"])
    met = parts.groupBy("file", "owner").agg(F.array_join(in_order, "\n").alias("record"))
    return whole.union(met.select(F.regexp_replace("record", "\r$", "").alias("record")))


def header_names(header: str, sep: str, null_value: str = "NA") -> list[str]:
    """Column names as Spark's reader makes them: blank ones are numbered, repeated ones get their place."""
    values = next(csv.reader([header], delimiter=sep), [])
    lowered = [v.lower() for v in values]
    return [
        f"_c{i}" if v in ("", null_value) else f"{v}{i}" if lowered.count(v.lower()) > 1 else v
        for i, v in enumerate(values)
    ]


def inferred(cells: DataFrame) -> T.StructType:
    """The types of text columns by position: whole numbers, doubles, truth values, else text; one aggregate."""
    tests = []
    for i in range(len(cells.columns)):
        c = f"c{i}"
        tests += [
            f"count({c}) AS n{i}",
            f"bool_and({c} RLIKE '{WHOLE}') AS whole{i}",
            f"bool_and(try_cast({c} AS INT) IS NOT NULL) FILTER (WHERE {c} IS NOT NULL) AS int{i}",
            f"bool_and(try_cast({c} AS BIGINT) IS NOT NULL) FILTER (WHERE {c} IS NOT NULL) AS long{i}",
            f"max(length(regexp_replace({c}, '^[+-]?0*', ''))) AS digits{i}",
            f"bool_and({c} RLIKE '{DOUBLE}') AS double{i}",
            f"bool_and(lower({c}) IN ('true', 'false')) AS flag{i}",
        ]
    row = cells.agg(*[F.expr(t) for t in tests]).first()

    def kind(i: int) -> T.DataType:
        if not row[f"n{i}"]:
            return T.StringType()
        if row[f"whole{i}"] and row[f"int{i}"]:
            return T.IntegerType()
        if row[f"whole{i}"] and row[f"long{i}"]:
            return T.LongType()
        if row[f"whole{i}"] and row[f"digits{i}"] <= LONGEST_DECIMAL:
            return T.DecimalType(max(1, row[f"digits{i}"]), 0)
        if row[f"double{i}"]:
            return T.DoubleType()
        return T.BooleanType() if row[f"flag{i}"] else T.StringType()

    return T.StructType([T.StructField(f"c{i}", kind(i)) for i in range(len(cells.columns))])


def read_split(
    spark: SparkSession,
    paths: Sequence[str],
    encoding: str,
    schema: T.StructType | str | None,
    multi_line: bool,
    parse_options: dict[str, str],
) -> DataFrame | None:
    """The table of CSV files, or None if their quotes are not regular."""
    sep = parse_options.get("sep", ",")
    plan = layout(spark, paths, encoding, sep, multi_line)
    if not plan.regular or plan.header is None:
        return None
    rows = records(spark, paths, plan, multi_line)

    def parsed(fields: T.StructType) -> DataFrame:
        by_place = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields.fields)])
        struct: Column = F.from_csv("record", by_place.toDDL(), parse_options)
        return rows.select(struct.alias("r")).select("r.*")

    if schema is not None:
        given = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return parsed(given).toDF(*given.names)
    names = header_names(plan.header, sep, parse_options["nullValue"])
    texts = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    return parsed(inferred(parsed(texts))).toDF(*names)
