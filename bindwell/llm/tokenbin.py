"""Token ids as compressed planes.

A segment file holds the ids of consecutive documents:

    header   magic, ids a block, plane width in bits (8 or 1), planes a block, ids, documents, blocks,
             place of the index
    planes   block by block, plane by plane, each a zstandard frame
    index    (its place is in the header) for each block and plane: offset and size of its frame (unsigned 64 and 32 bit)
    documents  a zstandard frame: for each document its number of ids (unsigned 64 bit)

Ids of a block are transposed: plane ``k`` has byte ``k`` (or bit ``k``) of every id, so that the
seldom used high planes compress to almost nothing; planes above the largest id are not stored. The
index makes every block readable by itself.

Segments are the ``file`` cells of a Parquet dataset beside the ids of their documents, because a
shared store that only Spark's writers reach is all that executors and driver have in common.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bindwell.llm.encode import SLICE_BYTES, encoder
from bindwell.llm.store import fresh_path
from bindwell.llm.text import buffers, in_batches, portions

MAGIC = b"BWPLANE1"
_HEADER = struct.Struct("<8sIBBQQIQ")
_ENTRY = np.dtype([("offset", "<u8"), ("size", "<u4")])


def _planes(ids: np.ndarray, width: int, n: int) -> list[bytes]:
    if width == 8:
        return [np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4)[:, k]).tobytes() for k in range(n)]
    bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(n)]


def _ids(planes: list[bytes], width: int, n: int) -> np.ndarray:
    if width == 8:
        out = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            out[:, k] = np.frombuffer(plane, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, plane in enumerate(planes):
            bits[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
        out = np.packbits(bits, axis=1, bitorder="little")
    return out.reshape(-1).view("<u4")


def write_segment(ids: np.ndarray, lengths: np.ndarray, width: int = 8, block: int = 1 << 16, level: int = 3) -> bytes:
    """One segment file for ``ids`` (unsigned 32 bit), cut into documents of ``lengths`` ids."""
    ids = np.ascontiguousarray(ids, "<u4")
    n_planes = -(-int(ids.max()).bit_length() // width) if len(ids) else 0
    n_blocks = -(-len(ids) // block)
    packer, body = zstandard.ZstdCompressor(level=level), []
    index, at = np.zeros(n_blocks * n_planes, _ENTRY), _HEADER.size
    for b in range(n_blocks):
        for k, plane in enumerate(_planes(ids[b * block : (b + 1) * block], width, n_planes)):
            body.append(packer.compress(plane))
            index[b * n_planes + k] = (at, len(body[-1]))
            at += len(body[-1])
    header = _HEADER.pack(MAGIC, block, width, n_planes, len(ids), len(lengths), n_blocks, at)
    return b"".join([header, *body, index.tobytes(), packer.compress(np.asarray(lengths, "<u8").tobytes())])


class Segment:
    """A segment file, read block by block through its index."""

    def __init__(self, file: bytes):
        magic, self.block, self.width, self.n_planes, self.n_ids, n_docs, n_blocks, at = _HEADER.unpack_from(file)
        if magic != MAGIC:
            raise ValueError("not a plane file")
        self.file = file
        self.index = np.frombuffer(file, _ENTRY, n_blocks * self.n_planes, at).reshape(n_blocks, self.n_planes)
        documents = zstandard.ZstdDecompressor().decompress(file[at + self.index.nbytes :], max_output_size=max(1, n_docs * 8))
        self.lengths = np.frombuffer(documents, "<u8").astype(np.int64)

    def read_block(self, b: int) -> np.ndarray:
        n = min(self.block, self.n_ids - b * self.block)
        unpack = zstandard.ZstdDecompressor().decompress
        most = n if self.width == 8 else -(-n // 8)
        planes = [unpack(self.file[o : o + size], max_output_size=most) for o, size in self.index[b].tolist()]
        return _ids(planes, self.width, n)

    def read(self) -> np.ndarray:
        blocks = -(-self.n_ids // self.block)
        if not self.n_planes:
            return np.zeros(self.n_ids, "<u4")
        return np.concatenate([self.read_block(b) for b in range(blocks)])


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    width: int = 8,
    segment_ids: int = 1 << 21,
    slice_bytes: int = SLICE_BYTES,
) -> None:
    """Write the ids of all documents, in ascending order of ``id_col``, as segment files at ``path``.

    Rows: part, segment, n_ids, ids (of the documents), file. A segment ends with the document that
    brings it to ``segment_ids`` ids, so it is at most that and one document long. Texts are encoded in
    slices of ``slice_bytes``, of which a word that recurs in one is handled once. A null id comes
    first, equal ids in the order of their texts; null texts are the end id alone.
    """
    schema = T.StructType([
        T.StructField("part", T.LongType()), T.StructField("segment", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)), T.StructField("file", T.BinaryType()),
    ])

    def run(batches):
        part, segment = TaskContext.get().partitionId(), 0
        held, names, kind = [], [], None

        def flush():
            lengths = np.array([len(x) for x in held], np.int64)
            ids = np.concatenate(held)
            cells = [[part], [segment], [len(ids)], [names], [write_segment(ids, lengths, width)]]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(kind), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names=schema.names)

        size = 0
        for batch in batches:
            kind = batch.column(0).type
            for some in portions(batch, 1, slice_bytes):
                data, offsets = buffers(some.column(1))
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
                for name, ids in zip(some.column(0).to_pylist(), encoder(tokenizer_path).encode(texts), strict=True):
                    held.append(np.append(ids, np.uint32(end_id)))
                    names.append(name)
                    size += len(held[-1])
                    if size >= segment_ids:
                        yield flush()
                        held, names, size, segment = [], [], 0, segment + 1
        if held:
            yield flush()

    ordered = in_batches(docs).select(id_col, text_col).repartitionByRange(id_col).sortWithinPartitions(id_col, text_col)
    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """The documents of the segment files at ``path``: ``id_col``, ``start``, ``n_tokens``, ``ids_crc32``."""
    files = spark.read.parquet(path)
    schema = T.StructType([
        T.StructField(id_col, files.schema["ids"].dataType.elementType), T.StructField("part", T.LongType()), T.StructField("segment", T.LongType()),
        T.StructField("within", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                segment = Segment(batch.column(3)[k].as_buffer().to_pybytes())
                ids, ends = segment.read(), np.cumsum(segment.lengths)
                begins = ends - segment.lengths
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends, strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(2)[k].values, pa.array(np.full(n, batch.column(0)[k].as_py())), pa.array(np.full(n, batch.column(1)[k].as_py())),
                        pa.array(begins), pa.array(segment.lengths), pa.array(crc, pa.int64()),
                    ],
                    names=schema.names,
                )

    documents = files.select("part", "segment", "ids", "file").mapInArrow(run, schema)
    # ids before each part, then before each segment of it: one row a part meets in one task, no more
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")
    before = files.select("part", "segment", inner.alias("before")).join(parts, "part")
    return documents.join(before, ["part", "segment"]).select(
        id_col, (F.col("before_part") + F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_file_digest(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write all documents as segment files in the shared folder and read them back.

    Returns for each row: ``id_col``, ``start``, ``n_tokens``, ``ids_crc32``. An empty table gives
    an empty result. Other columns are not read.
    """
    path = fresh_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer_path, id_col, text_col, **options)
    return read_token_files(docs.sparkSession, path, id_col)
