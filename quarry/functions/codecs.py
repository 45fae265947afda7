"""Compression with limits and detection of formats."""

from __future__ import annotations

import bz2
import io
import lzma

LIMIT = 1 << 30
#: What a function called from SQL takes or gives at most.
CALL_LIMIT = 256 << 20
#: The magic numbers of the formats.
MAGIC = (("zstd", bytes.fromhex("28b52ffd")), ("xz", bytes.fromhex("fd377a585a00")), ("bzip2", b"BZh"), ("lz4", bytes.fromhex("04224d18")))
STRATEGY = {"fastest": "lz4", "balanced": "zstd", "smallest": "xz"}


class SizeExceeded(ValueError):
    pass


def detect(data: bytes) -> str | None:
    return next((name for name, m in MAGIC if len(data) >= 4 and data.startswith(m)), None)


def compress(codec: str, data: bytes, level: int | None = None, dictionary: bytes | None = None) -> bytes:
    if codec == "zstd":
        import zstandard

        kw = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        return zstandard.ZstdCompressor(level=3 if level is None or dictionary else level, **kw).compress(data)
    if codec == "xz":
        return lzma.compress(data)  # one setting: levels do not apply
    if codec == "bzip2":
        return bz2.compress(data, level or 6)
    if codec == "lz4":
        import pyarrow as pa

        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, "lz4") as out:
            out.write(data)
        return sink.getvalue().to_pybytes()
    raise ValueError(f"unknown codec {codec}")


def compress_for(strategy: str, data: bytes) -> bytes:
    """fastest, balanced or smallest."""
    return compress(STRATEGY[strategy], data)


def decompress(codec: str, data: bytes, limit: int = LIMIT, dictionary: bytes | None = None, truncate: bool = False) -> bytes:
    """At most limit bytes; one more is SizeExceeded, or cut off if truncate, found without inflating the rest."""
    if codec == "zstd":
        import zstandard

        kw = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        stream = zstandard.ZstdDecompressor(**kw).stream_reader(io.BytesIO(data), read_across_frames=True)
    elif codec == "xz":
        stream = lzma.open(io.BytesIO(data))
    elif codec == "bzip2":
        stream = bz2.open(io.BytesIO(data))
    elif codec == "lz4":
        import pyarrow as pa

        stream = pa.CompressedInputStream(pa.BufferReader(data), "lz4")
    else:
        raise ValueError(f"unknown codec {codec}")
    parts, held = [], 0
    while part := stream.read(min(1 << 20, limit + 1 - held)):
        parts.append(bytes(part))
        held += len(part)
        if held > limit and truncate:
            return b"".join(parts)[:limit]
        if held > limit:
            raise SizeExceeded("decompressed_size_exceeded")
    return b"".join(parts)


def decompress_auto(data: bytes, limit: int = LIMIT, passthrough: bool = False) -> bytes:
    """By the format that data begins with. passthrough reads as a stream does: unknown formats come as they are, and
    everything ends at limit bytes."""
    codec = detect(data)
    if codec is None:
        if passthrough:
            return data[:limit]
        raise ValueError("unknown_format")
    return decompress(codec, data, limit, truncate=passthrough)
