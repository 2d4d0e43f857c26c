"""Token ids as Parquet lists: delta-encoded, in small pages with an index, ordered by document.

Spark's own writer makes the files.  Version 2 pages without a dictionary store int32 lists
and offsets as DELTA_BINARY_PACKED; the row group and page sizes are options, and the writer
adds column and offset indexes.  Rows ascend by doc_id over and inside the files, so a
filter on doc_id reads few row groups and pages, and a projection without ``tokens`` reads
the metadata columns only.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import TextEncoder
from .common import scratch_path, table

IDS = np.dtype("<u4")
END_ID = 0
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 64 << 10
FILE_SCHEMA = "part int, part_start long, doc_id long, n_tokens long, tokens array<int>"

#: Texts are encoded together up to so many bytes; a longer text is encoded alone.
BATCH_BYTES = 4 << 20

#: A blank before white space of any kind or at the end, as ``chunks.UNSAFE`` says it.
UNSAFE_RE2 = (
    r" ([\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"
)

_LOADED: dict[str, BatchEncoder] = {}


def parts_of(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds (from, to) of texts that are encoded together."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + BATCH_BYTES, side="right")))
        yield at, upto
        at = upto


def byte_alphabet() -> dict[int, int]:
    """How the vocabulary writes bytes: printable Latin-1 as itself, others from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


class BatchEncoder:
    """The tokenizer over Arrow arrays of texts, behind caches that live as long as a Python worker.

    The file's pre-tokenizer matches the public pattern and writes bytes in its alphabet; its
    model then sees one piece at a time, so a piece's ids can be kept.  Texts are cut at blanks
    (:mod:`.chunks`) and each distinct chunk of a batch is looked up once.  A text in which a blank
    doesn't open a chunk is encoded alone, and one that holds an added token of the file, such as
    an end-of-text mark, is left to the library, which finds those tokens first.
    """

    def __init__(self, path: str):
        import public_tokenizers as P
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        model, alphabet, pieces = self.library.model, byte_alphabet(), regex.compile(P.PATTERN)
        blank = chr(alphabet[ord(" ")])

        def piece(text: str) -> bytes:
            if text[0] == " " and text.isascii() and text[1:].isalpha():  # letters stand for themselves
                written = blank + text[1:]
            else:
                written = text.encode("utf-8").decode("latin-1").translate(alphabet)
            return array("I", [t.id for t in model.tokenize(written)]).tobytes()

        self.encode = TextEncoder(pieces.findall, piece)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def alone(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, IDS).tobytes()
        return self.encode(text)

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of non-null texts, each closed by ``end_id``."""
        n = len(texts)
        apart = pc.match_substring_regex(texts, UNSAFE_RE2)
        for token in self.added:
            apart = pc.or_(apart, pc.match_substring(texts, token))
        cut = pc.split_pattern(pc.if_else(apart, "", texts), " ")
        coded = cut.flatten().dictionary_encode()
        starts = cut.offsets.to_numpy().astype(np.int64)
        sizes, starts = np.diff(starts), starts[:-1] - starts[0]
        # codes of all chunks in order, with the end mark behind each text's last
        codes = np.empty(len(coded) + n, np.int64)
        codes[np.arange(len(coded)) + np.repeat(np.arange(n), sizes)] = coded.indices.to_numpy()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # no scalar per chunk
        held = list(map(self.encode.rest.__getitem__, known))
        heads = starts + np.arange(n)
        held.append(np.array([end_id], IDS).tobytes())
        codes[heads + sizes] = len(known)
        # a text's first chunk has no blank before it, and a text set apart is one chunk
        for i, (code, alone) in enumerate(zip(codes[heads].tolist(), apart.to_pylist())):
            held.append(self.alone(texts[i].as_py()) if alone else self.encode.first[known[code]])
        codes[heads] = len(known) + 1 + np.arange(n)
        lengths = np.fromiter(map(len, held), np.int64, len(held)) // IDS.itemsize
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(held), IDS).astype(np.int32)))
        ends = np.cumsum(lengths[codes])[heads + sizes]
        return np.concatenate(([0], ends)), ids.take(pa.array(codes)).flatten().to_numpy()


def encoder(path: str) -> BatchEncoder:
    if path not in _LOADED:
        _LOADED[path] = BatchEncoder(path)
    return _LOADED[path]


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str | None = None,
    end_id: int = END_ID,
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
) -> None:
    """Encode ``doc_id, text`` and write the token files to ``path`` in ascending doc_id order.

    One range shuffle of the texts; each task then streams its range.  A null text is the
    empty text and holds the end id alone; a null doc_id sorts first; repeated rows stay;
    other columns are not written; an empty table writes files without rows.
    """
    if tokenizer_path is None:
        import public_tokenizers as P

        tokenizer_path = P.path("byte_bpe_50k.json")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, encode_texts = TaskContext.get().partitionId(), 0, encoder(tokenizer_path)
        for batch in batches:
            for a, b in parts_of(batch.column(1)):
                offsets, flat = encode_texts(batch.column(1).slice(a, b - a), end_id)
                columns = [
                    pa.array(np.full(b - a, part, np.int32)),
                    pa.array(offsets[:-1] + done),
                    batch.column(0).slice(a, b - a),
                    pa.array(np.diff(offsets)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)),
                ]
                done += int(offsets[-1])
                yield pa.RecordBatch.from_arrays(columns, names=["part", "part_start", "doc_id", "n_tokens", "tokens"])

    (
        docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(encode, FILE_SCHEMA)
        .write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .parquet(path)
    )


def read_tokens(
    spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None
) -> DataFrame:
    """Chosen columns of the files, and only the row groups and pages that ``where`` may need."""
    df = spark.read.schema(FILE_SCHEMA).parquet(path)
    df = df if where is None else df.where(where)
    return df if columns is None else df.select(*columns)


def with_start(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files with ``start``: how many ids all documents before them hold.

    Tasks wrote the running count within their range; the sums of the ranges (one row per
    file, metadata columns only) are added up and joined.
    """
    from pyspark.sql import Window

    sums = read_tokens(spark, path, ["part", "n_tokens"]).groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    rows = read_tokens(spark, path).join(F.broadcast(bases), "part")  # one row per file
    return rows.withColumn("start", F.col("base") + F.col("part_start")).drop("base")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of the ids as little-endian uint32."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [zlib.crc32(row.values.to_numpy().astype(IDS).tobytes()) for row in batch.column(3)]
            columns = [*batch.columns[:3], pa.array(ids, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(
        crc, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return digests(with_start(spark, path))
