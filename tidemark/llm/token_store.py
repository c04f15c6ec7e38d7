"""Token ids in files of independent zstandard frames.

A file is a run of frames, one a document and each with zstandard's own content
checksum, followed by a seek table in a skippable frame (so that any zstandard
tool still reads the file):

    "TDSK" entries (32 bytes each: frame offset u64, frame bytes u32, ids u64,
    CRC-32 of the ids as stored u32, row ordinal u64)
    footer: entry count u64, CRC-32 of the entries u32, id width u8, "TIDEZ01"

``read_frames`` opens the table alone and decompresses only the frames asked for.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.encoding import chunks, encoder
from tidemark.llm.streams import ordered_cells

ENTRY = struct.Struct("<QIQIQ")
FOOTER = struct.Struct("<QIB7s")
MAGIC = b"TIDEZ01"
SKIPPABLE = struct.Struct("<II")
SKIPPABLE_MAGIC = 0x184D2A5E


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class FrameWriter:
    """Writes frames to a sink with ``write``; ``close`` appends the seek table."""

    def __init__(self, sink, width: int):
        self.sink, self.width, self.at, self.table = sink, width, 0, bytearray()

    def add(self, frame: bytes, n_ids: int, crc: int, ordinal: int) -> None:
        self.sink.write(frame)
        self.table += ENTRY.pack(self.at, len(frame), n_ids, crc, ordinal)
        self.at += len(frame)

    def close(self) -> None:
        body = bytes(self.table)
        # A skippable frame holds less than 4 GB: 100 million documents a file.
        self.sink.write(SKIPPABLE.pack(SKIPPABLE_MAGIC, len(body) + FOOTER.size))
        self.sink.write(body)
        self.sink.write(FOOTER.pack(len(body) // ENTRY.size, zlib.crc32(body), self.width, MAGIC))


def seek_table(source, size: int) -> tuple[list[tuple], int]:
    """Entries of a file and its id width; raises ``ValueError`` if it is damaged."""
    source.seek(size - FOOTER.size)
    n, crc, width, magic = FOOTER.unpack(source.read(FOOTER.size))
    if magic != MAGIC:
        raise ValueError("not a token file")
    source.seek(size - FOOTER.size - n * ENTRY.size)
    body = source.read(n * ENTRY.size)
    if zlib.crc32(body) != crc:
        raise ValueError("damaged seek table")
    return list(ENTRY.iter_unpack(body)), width


def read_frames(uri: str, wanted: list[int] | None = None):
    """Yields (index, ordinal, ids) of the frames ``wanted`` (all if None), checking each frame's checksums."""
    import zstandard

    files, path = _filesystem(uri)
    with files.open_input_file(path) as source:
        entries, width = seek_table(source, source.size())
        unzip = zstandard.ZstdDecompressor()
        for k in range(len(entries)) if wanted is None else wanted:
            at, size, n, crc, ordinal = entries[k]
            source.seek(at)
            raw = unzip.decompress(source.read(size), max_output_size=max(1, n * width))
            if len(raw) != n * width or zlib.crc32(raw) != crc:
                raise ValueError(f"damaged frame {k} of {uri}")
            yield k, ordinal, np.frombuffer(raw, f"<u{width}")


def write_tokens(docs: DataFrame, root: str, tokenizer: str, style: str = "word", end_id: int = 2, level: int = 3) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) to files under ``root``, documents in ascending doc_id order (NULL first,
    equal ids by text hash); returns the manifest (cell, path, doc_ids, n_tokens array) read back from ``root``.

    Frames are made before the shuffle, which so moves compressed data only. A
    task writes under a name of its own and a file counts only if the manifest
    names it, so a task that runs again does no harm.
    """
    spark = docs.sparkSession
    n = docs.count()
    cell = ordered_cells(docs, "doc_id", min(65_536, max(1024, n // 256)))
    end = end_id.to_bytes(2, "little")
    rows = docs.select("doc_id", cell.alias("cell"), F.xxhash64("text").alias("h"), "text")
    id_type = dict(docs.dtypes)["doc_id"]

    def encode(batches):
        import pyarrow as pa
        import zstandard

        enc, zipper = encoder(tokenizer, style), zstandard.ZstdCompressor(level=level, write_checksum=True)
        for b in batches:
            for i, texts in chunks(b.column("text")):
                ids = [x + end for x in enc.encode(texts)]
                part = b.slice(i, len(texts))
                cols = [part.column(c) for c in ("doc_id", "cell", "h")]
                cols += [pa.array([zipper.compress(x) for x in ids], pa.binary()), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "cell", "h", "frame", "n", "crc"])

    frames = rows.mapInArrow(encode, f"doc_id {id_type}, cell long, h long, frame binary, n long, crc long")
    data = f"{root}/data"

    def write(batches):
        import pyarrow as pa

        files, base = _filesystem(data)
        files.create_dir(base, recursive=True)
        attempt = uuid.uuid4().hex
        cell, sink, writer, docs_of, tokens_of, out = None, None, None, [], [], []

        def finish():
            writer.close()
            sink.close()
            out.append((cell, f"{data}/{cell}-{attempt}.tz", list(docs_of), list(tokens_of)))

        for b in batches:
            for doc, c, frame, n_ids, crc in zip(*[b.column(k).to_pylist() for k in ("doc_id", "cell", "frame", "n", "crc")], strict=True):
                if c != cell:
                    if writer:
                        finish()
                    cell, docs_of, tokens_of = c, [], []
                    sink = files.open_output_stream(f"{base}/{c}-{attempt}.tz")
                    writer = FrameWriter(sink, 2)
                writer.add(frame, n_ids, crc, len(docs_of))
                docs_of.append(doc)
                tokens_of.append(n_ids)
        if writer:
            finish()
        if out:
            cells, paths, ids, tokens = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells, pa.int64()), pa.array(paths), pa.array(ids, pa.list_(pa.int64())), pa.array(tokens, pa.list_(pa.int64()))], ["cell", "path", "doc_ids", "n_tokens"]
            )

    sorted_rows = frames.repartition("cell").sortWithinPartitions("cell", F.col("doc_id").asc_nulls_first(), "h", "crc")
    manifest = sorted_rows.mapInArrow(write, "cell long, path string, doc_ids array<long>, n_tokens array<long>")
    manifest.write.parquet(f"{root}/manifest")
    return read_manifest(spark, root)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("cell long, path string, doc_ids array<long>, n_tokens array<long>").parquet(f"{root}/manifest")


def read_index(manifest: DataFrame, batch: int = 2048) -> DataFrame:
    """Reads every frame back: (doc_id, start, n_tokens, ids_crc32), the CRC-32 of the ids as little-endian 32-bit integers.

    ``start`` counts the ids of all documents before; files are summed first and
    documents within a file by its own task.
    """
    per_file = manifest.select("cell", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_file.select("cell", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for cell, path, ids in zip(*[b.column(k).to_pylist() for k in ("cell", "path", "doc_ids")], strict=True):
                at, rows = 0, []
                for _, ordinal, tokens in read_frames(path):
                    rows.append((ids[ordinal], cell, at, len(tokens), zlib.crc32(tokens.astype("<u4"))))
                    at += len(tokens)
                    if len(rows) == batch:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "cell", "local", "n_tokens", "ids_crc32"])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "cell", "local", "n_tokens", "ids_crc32"])

    # A number of its own, since a few small manifest rows stand for much to read.
    tasks = max(1, min(100_000, manifest.count() // 4))
    files = manifest.select("cell", "path", "doc_ids").repartition(tasks, "path")
    rows = files.mapInArrow(read, "doc_id long, cell long, local long, n_tokens long, ids_crc32 long")
    return rows.join(bases, "cell").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(manifest: DataFrame, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids array<long>) of the documents named, decompressing their frames alone."""
    wanted = [int(x) for x in doc_ids]

    def read(batches):
        import pyarrow as pa

        for b in batches:
            for path, ids in zip(b.column("path").to_pylist(), b.column("doc_ids").to_pylist(), strict=True):
                at = [k for k, x in enumerate(ids) if x in set(wanted)]
                for k, _, tokens in read_frames(path, at):
                    yield pa.RecordBatch.from_arrays([pa.array([ids[k]], pa.int64()), pa.array([tokens.astype("i8")], pa.list_(pa.int64()))], ["doc_id", "ids"])

    some = manifest.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(x).cast("long") for x in wanted])))
    return some.select("path", "doc_ids").mapInArrow(read, "doc_id long, ids array<long>")
