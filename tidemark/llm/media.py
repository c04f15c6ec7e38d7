"""Media columns: signature sniffing, validation, carving, and lossless storage of payloads.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass
over a blob; a validator per format then walks the structure from there and says
where the file ends, or that there is none. The first valid file at offset 0
corrects the declared type; valid files elsewhere are carved.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize

#: Bytes of a payload line: a row of 192 grey samples, 64 pixels of three.
UNIT = 192
PAD = b" "

# The signatures of the formats.
MAGIC = {
    "image/png": b"\x89PNG\r\n\x1a\n",
    "audio/wav": b"RIFF",
    "image/gif": b"GIF8",
    "image/bmp": b"BM",
    "image/jpeg": b"\xff\xd8\xff",
    "audio/ogg": b"OggS",
}


def _png_end(b: bytes, at: int) -> int | None:
    """Chunks with right CRCs from IHDR to IEND."""
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, pos)
        end = pos + 12 + size
        if end > len(b) or (first and (kind != b"IHDR" or size != 13)):
            return None
        if zlib.crc32(memoryview(b)[pos + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end
        pos, first = end, False
    return None


def _wav_end(b: bytes, at: int) -> int | None:
    """RIFF size, then chunks that fill it exactly, fmt before data."""
    if len(b) < at + 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    pos, seen = at + 12, []
    while pos + 8 <= end <= len(b):
        kind, size = struct.unpack_from("<4sI", b, pos)
        seen.append(kind)
        pos += 8 + size + size % 2
    return end if pos == end and b"fmt " in seen and b"data" in seen and seen.index(b"fmt ") < seen.index(b"data") else None


def _gif_end(b: bytes, at: int) -> int | None:
    if b[at + 3 : at + 6] not in (b"87a", b"89a") or len(b) < at + 14:
        return None
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    pos = at + 13 + table(b[at + 10])

    def blocks(pos: int) -> int | None:
        while pos < len(b):
            if not b[pos]:
                return pos + 1
            pos += b[pos] + 1
        return None

    while pos is not None and pos < len(b):
        mark = b[pos]
        if mark == 0x3B:
            return pos + 1
        if mark == 0x21:
            pos = blocks(pos + 2)
        elif mark == 0x2C and pos + 10 < len(b):
            pos = blocks(pos + 11 + table(b[pos + 9]))
        else:
            return None
    return None


def _bmp_end(b: bytes, at: int) -> int | None:
    """File size, pixel offset and header size agree with the dimensions."""
    if len(b) < at + 54:
        return None
    size, _, offset, header, w, h, planes, depth, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if header not in (40, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or packed != 0 or w <= 0 or not h:
        return None
    need = offset + (w * depth + 31) // 32 * 4 * abs(h)
    return at + size if need == size and at + size <= len(b) else None


def _jpeg_end(b: bytes, at: int) -> int | None:
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        mark = b[pos + 1]
        if mark == 0xD9:
            return pos + 2
        pos += 2 + struct.unpack_from(">H", b, pos + 2)[0]
        if mark == 0xDA:  # entropy-coded data runs to the next marker
            while pos + 1 < len(b) and not (b[pos] == 0xFF and b[pos + 1] not in (0, *range(0xD0, 0xD8))):
                pos += 1
    return pos + 2 if pos + 2 <= len(b) and b[pos : pos + 2] == b"\xff\xd9" else None


def _ogg_end(b: bytes, at: int) -> int | None:
    """Pages of one stream, from a first to a last page."""
    pos, pages, last = at, 0, False
    while b[pos : pos + 4] == b"OggS" and pos + 27 <= len(b) and b[pos + 4] == 0:
        kind, parts = b[pos + 5], b[pos + 26]
        end = pos + 27 + parts + sum(b[pos + 27 : pos + 27 + parts])
        if end > len(b) or (not pages and not kind & 2):
            return None
        pos, pages, last = end, pages + 1, bool(kind & 4)
        if last:
            break
    return pos if pages and last else None


VALIDATORS = {"image/png": _png_end, "audio/wav": _wav_end, "image/gif": _gif_end, "image/bmp": _bmp_end, "image/jpeg": _jpeg_end, "audio/ogg": _ogg_end}
_AUTOMATON = None


def _automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        _AUTOMATON = ahocorasick.Automaton()
        for kind, magic in MAGIC.items():
            _AUTOMATON.add_word(magic.decode("latin-1"), (kind, len(magic)))
        _AUTOMATON.make_automaton()
    return _AUTOMATON


def sniff(blob: bytes) -> list[tuple[str, int, int]]:
    """(type, start, end) of the valid media in ``blob``, by start; files inside another are not listed again."""
    found, covered = [], 0
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in _automaton().iter(blob.decode("latin-1")))
    for start, kind in hits:
        if start >= covered and (end := VALIDATORS[kind](blob, start)) is not None:
            found.append((kind, start, end))
            covered = end
    return found


def sniff_nested(blob: bytes) -> list[tuple[str, int, int, int]]:
    """(type, start, end, depth) of all valid media in ``blob``, by start, those inside others too: a thumbnail in an image, a cover in a sound.

    ``depth`` counts the files a file lies in; one that reaches out of the file it begins in is none.
    """
    found, around = [], []
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in _automaton().iter(blob.decode("latin-1")))
    for start, kind in hits:
        while around and start >= around[-1]:
            around.pop()
        end = VALIDATORS[kind](blob, start)
        if end is not None and (not around or end <= around[-1]):
            found.append((kind, start, end, len(around)))
            around.append(end)
    return found


def write_png(payload: bytes) -> bytes:
    """8-bit grey image of rows of 192 samples."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = len(payload) // UNIT
    lines = np.zeros((rows, UNIT + 1), np.uint8)  # each line begins with filter 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, UNIT)
    return MAGIC["image/png"] + chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + chunk(b"IEND", b"")


def write_wav(payload: bytes) -> bytes:
    """8-bit mono samples at 8 kHz."""
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_samples(blob: bytes, kind: str, start: int = 0) -> bytes:
    """The 8-bit samples of a file that ``write_png`` or ``write_wav`` made, at ``start``."""
    if kind == "audio/wav":
        size = struct.unpack_from("<I", blob, start + 40)[0]
        return blob[start + 44 : start + 44 + size]
    width, rows = struct.unpack_from(">II", blob, start + 16)
    pos, packed = start + 8, b""
    while True:
        size, name = struct.unpack_from(">I4s", blob, pos)
        if name == b"IDAT":
            packed += blob[pos + 8 : pos + 8 + size]
        elif name == b"IEND":
            break
        pos += 12 + size
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(rows, width + 1)[:, 1:].tobytes()


def sniff_column(df: DataFrame, blob: str, declared: str, out: str = "media", nested: bool = False) -> DataFrame:
    """Adds ``out``: struct<type, corrected, carved array<struct<type, start, end, depth>>>; files inside others with ``nested`` only.

    ``type`` is that of the valid file at offset 0; without one it is NULL, and a
    declared type that is contradicted counts as corrected. A NULL blob has a NULL
    result.
    """
    kind = "struct<type: string, corrected: boolean, carved: array<struct<type: string, start: long, end: long, depth: int>>>"

    @F.pandas_udf(kind)
    def run(blobs, names):
        import pandas as pd

        rows = []
        for b, name in zip(blobs, names, strict=True):
            found = [] if b is None else sniff_nested(bytes(b)) if nested else [(*f, 0) for f in sniff(bytes(b))]
            own = found[0][0] if found and found[0][1] == 0 else None
            rows.append((own, bool(b is not None and own != name), [{"type": k, "start": s, "end": e, "depth": d} for k, s, e, d in found]))
        return pd.DataFrame(rows, columns=["type", "corrected", "carved"])

    return df.withColumn(out, F.when(F.col(blob).isNotNull(), run(blob, declared)))


def store_texts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, n_bytes, declared, blob): texts as media, written to the shared folder.

    The payload is the UTF-8 text (NULL: empty) with blanks to a positive multiple
    of 192. By its checksum it becomes an image or a sound, and every third is
    declared wrongly, as collected media often are.
    """
    id_type = dict(docs.dtypes)["doc_id"]

    def store(batches):
        import pyarrow as pa

        for b in batches:
            out, size = [[], [], [], []], 0
            for doc, text in zip(b.column("doc_id"), b.column("text").to_pylist(), strict=True):
                raw = (text or "").encode()
                payload = raw + PAD * (-len(raw) % UNIT or UNIT * (not raw))
                crc = zlib.crc32(payload)
                blob = write_wav(payload) if crc % 2 else write_png(payload)
                name = "image/jpeg" if crc % 3 == 0 else ("audio/wav" if crc % 2 else "image/png")
                for col, x in zip(out, (doc.as_py(), len(raw), name, blob), strict=True):
                    col.append(x)
                size += len(blob)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], b.column("doc_id").type), pa.array(out[1], pa.int64()), pa.array(out[2]), pa.array(out[3], pa.binary())], ["doc_id", "n_bytes", "declared", "blob"])
                    out, size = [[], [], [], []], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], b.column("doc_id").type), pa.array(out[1], pa.int64()), pa.array(out[2]), pa.array(out[3], pa.binary())], ["doc_id", "n_bytes", "declared", "blob"])

    return materialize(docs.select("doc_id", "text").mapInArrow(store, f"doc_id {id_type}, n_bytes long, declared string, blob binary"), "media")


def media_features(stored: DataFrame) -> DataFrame:
    """Reads stored media back: payload and file digests, and ``feature``.

    ``feature`` holds the sniffed type, the number of carved files, and the mean,
    deviation and entropy (bits) of the samples. A blob without a valid file at
    offset 0 raises, as its payload can't be read.
    """
    id_type = dict(stored.dtypes)["doc_id"]

    def read(batches):
        import hashlib

        import pyarrow as pa

        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared", "corrected"]
        for b in batches:
            rows = []
            for doc, n, declared, blob in zip(*[b.column(c) for c in ("doc_id", "n_bytes", "declared", "blob")], strict=True):
                blob = blob.as_py()
                found = sniff(blob)
                if not found or found[0][1]:
                    raise ValueError(f"no valid media for document {doc}")
                kind = found[0][0]
                got = read_samples(blob, kind)
                counts = np.bincount(np.frombuffer(got, np.uint8), minlength=256)
                p = counts[counts > 0] / len(got)
                mean = counts @ np.arange(256) / len(got)
                sd = np.sqrt(counts @ (np.arange(256) - mean) ** 2 / len(got))
                feature = f"{kind};files={len(found)};mean={mean:.3f};sd={sd:.3f};entropy={-(p * np.log2(p)).sum():.4f}"
                rows.append((doc.as_py(), n.as_py(), len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), feature, declared.as_py(), kind != declared.as_py()))
            kinds = [b.column("doc_id").type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    schema = f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, corrected boolean"
    return stored.select("doc_id", "n_bytes", "declared", "blob").mapInArrow(read, schema)
