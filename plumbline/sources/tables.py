"""Reading tables, previewing them, and writing result tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.split_csv import read_split

# Encodings a caller may name, with the Java character set.
ENCODINGS = {
    "UTF-8": "UTF-8",
    "UTF-8-BOM": "UTF-8",
    "CP949": "x-windows-949",
    "EUC-KR": "EUC-KR",
}
FORMATS = ("csv", "parquet", "json", "orc")
PREVIEW_ROWS = 10
#: Names the staged folder and the tables of a complete report that is taking its place.
MANIFEST = "_complete"

# A format no text matches: date-like text in a CSV stays text, so the type check can
# report it; the profile recognises it as a date either way.
_NEVER = "'\u0001'yyyy'\u0001'"


class UnsupportedFormat(ValueError):
    """The file format is not one of csv, parquet, json, orc."""


def detect_encoding(spark: SparkSession, path: str | list[str]) -> str:
    """UTF-8 when every line of the file is valid UTF-8 (with or without BOM), else CP949.

    CP949 contains EUC-KR, so nothing is left to try after it.  The test stops at the
    first bad line.
    """
    lines = spark.read.text(path)
    bad = lines.where(~F.is_valid_utf8("value")).limit(1).count()
    return "CP949" if bad else "UTF-8"


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    encoding: str = "UTF-8",
    schema: T.StructType | str | None = None,
    multi_line: bool = True,
    **options: object,
) -> DataFrame:
    """CSV with a header; only ``NA`` (and an empty field) is read as missing.

    Quoted fields may hold commas, doubled quotes and line breaks, and large files are still read by
    many tasks (:mod:`plumbline.sources.split_csv`).  ``multi_line=False`` says that there are no line
    breaks in fields.  ``encoding`` is ``auto`` (for each file its own), ``UTF-8``, ``UTF-8-BOM``,
    ``CP949`` or ``EUC-KR``.  Give a schema for large inputs: inferring one reads the files once more.

    Files whose quotes don't enclose whole fields, and calls with options other than ``sep``, are
    read by Spark's own reader, one task a file if ``multi_line``.
    """
    if encoding != "auto" and encoding not in ENCODINGS:
        raise ValueError(f"unknown encoding {encoding!r}, use one of {sorted(ENCODINGS)}")
    paths = [path] if isinstance(path, str) else list(path)
    parse = {
        "nullValue": "NA",
        "quote": '"',
        "escape": '"',
        "multiLine": str(multi_line).lower(),
        "preferDate": "false",
        "timestampFormat": _NEVER,
        "timestampNTZFormat": _NEVER,
    }
    plain = multi_line or encoding not in ("UTF-8", "UTF-8-BOM")  # Spark splits the rest itself
    if plain and set(options) <= {"sep", "delimiter"}:
        separator = str(options.get("sep", options.get("delimiter", ",")))
        if len(separator) == 1:
            split = read_split(spark, paths, encoding, schema, multi_line, {**parse, "sep": separator})
            if split is not None:
                return split
    return _read_by_spark(spark, paths, encoding, schema, {**parse, **options})


def _read_by_spark(
    spark: SparkSession, paths: list[str], encoding: str, schema: T.StructType | str | None, options: dict[str, object]
) -> DataFrame:
    """Spark's reader, one encoding for all files.

    The Korean encodings need ``spark.sql.legacy.javaCharsets``, which Spark looks up whenever the
    table is scanned; it is therefore switched on in the session and stays on.
    """
    if encoding == "auto":
        encoding = detect_encoding(spark, paths)
    if ENCODINGS[encoding] != "UTF-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    reader = spark.read.options(header=True, encoding=ENCODINGS[encoding]).options(**options)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(paths)


def load_table(
    spark: SparkSession, path: str, fmt: str | None = None, **options: object
) -> DataFrame:
    """Read a table by its format (default: the file extension)."""
    fmt = (fmt or PurePosixPath(path.rstrip("/")).suffix.lstrip(".")).lower()
    if fmt not in FORMATS:
        raise UnsupportedFormat(f"cannot read {fmt or path!r}: supported are {', '.join(FORMATS)}")
    if fmt == "csv":
        return read_csv(spark, path, **options)
    return spark.read.options(**options).format(fmt).load(path)


def preview(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows of a table."""
    return df.limit(n)


def report_name(base: str, purpose: str, when: datetime | None = None) -> str:
    """Name of a report: base name, purpose and minute."""
    stamp = (when or datetime.now()).strftime("%Y%m%d_%H%M")
    return f"{base}_{purpose}_{stamp}"


def write_report(
    tables: dict[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "overwrite"
) -> None:
    """Write each result table (``tables()`` of a report or a verdict) to ``path/report=<name>``.

    Overwriting replaces the report as a whole: all tables are first written beside it, a manifest
    then says that they are complete, and only then they take the place of the old ones.  A failure
    before the manifest leaves the old report as it was; after it, :func:`recover_report` (or the
    next ``write_report``) finishes the work.
    """
    root = path.rstrip("/")
    if mode != "overwrite":
        for name, table in tables.items():
            table.write.mode(mode).format(fmt).save(f"{root}/report={name}")
        return
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession
    recover_report(spark, root)
    stage = f"_staged-{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.format(fmt).save(f"{root}/{stage}/report={name}")
    files = _Files(spark, root)
    files.write(f"{stage}/{MANIFEST}", "\n".join([stage, *tables]))
    files.rename(f"{stage}/{MANIFEST}", MANIFEST)  # from here on the new report counts
    recover_report(spark, root)


def recover_report(spark: SparkSession, path: str) -> bool:
    """Finish a report whose manifest is there; true if there was one.  May be run again at any time."""
    files = _Files(spark, path.rstrip("/"))
    if not files.exists(MANIFEST):
        return False
    stage, *names = files.read(MANIFEST).split("\n")
    for name in names:
        if files.exists(f"{stage}/report={name}"):  # else it took its place before
            files.delete(f"report={name}")
            files.rename(f"{stage}/report={name}", f"report={name}")
    files.delete(stage)
    files.delete(MANIFEST)
    return True


class _Files:
    """The few file operations of a report, by the file system of its folder."""

    def __init__(self, spark: SparkSession, root: str):
        self._hadoop = spark._jvm.org.apache.hadoop
        self._root = self._hadoop.fs.Path(root)
        self._system = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.fs.Path(self._root, name)

    def exists(self, name: str) -> bool:
        return self._system.exists(self._at(name))

    def delete(self, name: str) -> None:
        self._system.delete(self._at(name), True)

    def rename(self, source: str, target: str) -> None:
        if not self._system.rename(self._at(source), self._at(target)):
            raise OSError(f"could not rename {source} to {target} in {self._root}")

    def write(self, name: str, text: str) -> None:
        out = self._system.create(self._at(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str:
        stream = self._system.open(self._at(name))
        size = self._system.getFileStatus(self._at(name)).getLen()
        text = bytes(stream.readNBytes(size)).decode()
        stream.close()
        return text
