"""Media columns: payloads in ISO base media containers, read back box by box.

The writer stores a payload as frames of 8-bit samples of a raw video track
(8 x 8 pixels of three bytes): ftyp, mdat, moov with one trak whose stbl holds
the sample tables. The reader knows nothing of the writer: it walks the nested
boxes, decodes stsd, mdhd, stts, stsc, stsz, stco/co64 and stss, and derives
codec, duration and the byte ranges of samples and keyframes without decoding
any payload. It reads whole files: fragments (moof), edit lists and compact sample
sizes (stz2) are not decoded.

Defined cases: null text counts as empty and is stored as one frame of spaces;
a file without stss has keyframes only; equal texts give equal bytes (no times,
no names); repeated rows give repeated rows; bytes that are no container (a box
that doesn't fit, a table cut short) have no tracks and say why (inspect()).
"""

from __future__ import annotations

import struct
from itertools import accumulate

from pyspark.sql import DataFrame

from glosswork.llm.common import ROOT, table, text_of

FRAME = 192
TIMESCALE, TICKS = 1000, 40
#: Every so many frames one is listed as a random-access point, and so many
#: frames form a chunk.
KEY_EVERY, CHUNK = 16, 64
#: Box types that hold boxes (a fixed list of the format).
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes, unit: int = FRAME) -> bytes:
    return data + b" " * (-len(data) % unit or (unit if not data else 0))


def write(payload: bytes) -> bytes:
    """A container of payload, whose length is a positive multiple of FRAME."""
    frames = len(payload) // FRAME
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")
    mdat = box(b"mdat", payload)
    first = len(ftyp) + len(mdat) - len(payload)
    chunks = -(-frames // CHUNK)
    offsets = [first + i * CHUNK * FRAME for i in range(chunks)]
    rest = frames - (chunks - 1) * CHUNK
    runs = [(1, CHUNK, 1)] if rest == CHUNK else [(1, rest, 1)] if chunks == 1 else [(1, CHUNK, 1), (chunks, rest, 1)]
    keys = range(1, frames + 1, KEY_EVERY)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    length = frames * TICKS
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 24, -1))
    wide = offsets[-1] >= 1 << 32
    tables = box(
        b"stbl",
        full_box(b"stsd", struct.pack(">I", 1), entry),
        full_box(b"stts", struct.pack(">III", 1, frames, TICKS)),
        full_box(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
        full_box(b"stsz", struct.pack(">II", FRAME, frames)),
        full_box(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        full_box(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
    )
    header = full_box(b"mvhd", struct.pack(">QQIQ", 0, 0, TIMESCALE, length), struct.pack(">IHH", 0x10000, 0x100, 0), bytes(8), matrix, bytes(24), struct.pack(">I", 2), version=1)
    track = full_box(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, length), bytes(16), matrix, struct.pack(">II", 8 << 16, 8 << 16), version=1, flags=3)
    media = full_box(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, length, 0x55C4, 0), version=1)
    handler = full_box(b"hdlr", bytes(4), b"vide", bytes(13))
    where = box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1)))
    minf = box(b"minf", full_box(b"vmhd", bytes(8), flags=1), where, tables)
    return ftyp + mdat + box(b"moov", header, box(b"trak", track, box(b"mdia", media, handler, minf)))


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()):
    """Yields (path, start of body, end) of every box, parents first."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {start} does not fit")
        yield (*path, kind), body, stop
        if kind in NESTED:
            yield from walk(data, body, stop, (*path, kind))
        start = stop


def read(data: bytes) -> list[dict]:
    """Per track: codec, timescale, duration (ticks), samples and keyframes as (offset, length)."""
    tracks: list[dict] = []
    for path, at, _ in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({"codec": "", "timescale": 0, "header_duration": 0, "sync": None})
        if not tracks:
            continue
        t = tracks[-1]
        if kind == b"mdhd":
            t["timescale"], t["header_duration"] = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
        elif kind == b"stsd":
            t["codec"] = data[at + 12 : at + 16].decode("latin-1").strip()
        elif kind in (b"stts", b"stsc", b"stco", b"co64", b"stss"):
            (n,) = struct.unpack_from(">I", data, at + 4)
            width = {b"stts": 2, b"stsc": 3}.get(kind, 1)
            values = struct.unpack_from(f">{n * width}{'Q' if kind == b'co64' else 'I'}", data, at + 8)
            name = {b"stss": "sync", b"co64": "offsets", b"stco": "offsets"}.get(kind, kind.decode())
            t[name] = [values[i : i + width] for i in range(0, len(values), width)] if width > 1 else list(values)
        elif kind == b"stsz":
            size, n = struct.unpack_from(">II", data, at + 4)
            t["sizes"] = [size] * n if size else list(struct.unpack_from(f">{n}I", data, at + 12))
    for t in tracks:
        t["duration"] = sum(n * ticks for n, ticks in t.get("stts", []))
        offsets, sizes, samples, i = t.get("offsets", []), t.get("sizes", []), [], 0
        runs = t.get("stsc", [])
        for (first, per_chunk, _), after in zip(runs, [r[0] for r in runs[1:]] + [len(offsets) + 1], strict=True):
            for chunk in range(first, after):
                held = sizes[i : i + per_chunk]
                starts = accumulate(held, initial=offsets[chunk - 1])
                samples += zip(starts, held, strict=False)
                i += per_chunk
        t["samples"] = samples
        t["keyframes"] = samples if t["sync"] is None else [samples[s - 1] for s in t["sync"]]
    return tracks


def inspect(data: bytes) -> tuple[list[dict], str]:
    """The tracks of read() and "ok", or no tracks and what is wrong."""
    try:
        return read(data), "ok"
    except (ValueError, struct.error, IndexError, KeyError) as e:
        return [], f"malformed: {e}"


def feature(track: dict) -> str:
    """codec, duration in ms, frames, keyframes, and the first and last keyframe's byte range."""
    keys = track["keyframes"]
    ms = track["duration"] * 1000 // max(1, track["timescale"])
    ends = ",".join(f"{at}+{n}" for at, n in (keys[:1] + keys[-1:]))
    return f"{track['codec']};{ms}ms;{len(track['samples'])};{len(keys)};{ends}"


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the container), codec, duration_ms, keyframes, payload, feature."""
    root = ROOT

    def run(batches):
        import sys

        import pyarrow as pa

        if root not in sys.path:
            sys.path.append(root)
        from glosswork.llm.media import feature, pad, read, write

        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("codec", pa.string()), ("duration_ms", pa.int64()), ("keyframes", pa.list_(pa.list_(pa.int64()))), ("payload", pa.binary()), ("feature", pa.string())])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    raw = text.encode()
                    media = write(pad(raw))
                    (track,) = read(media)
                    payload = b"".join(media[a : a + n] for a, n in track["samples"])
                    rows.append((doc_id, len(raw), media, track["codec"], track["duration"] * 1000 // track["timescale"], [list(k) for k in track["keyframes"]], payload, feature(track)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    kinds = "doc_id long, n_bytes long, media binary, codec string, duration_ms long, keyframes array<array<bigint>>, payload binary, feature string"
    return text_of(docs).mapInArrow(run, kinds)


def digest(rows: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    payload, media = F.col("payload"), F.col("media")
    return rows.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"),
        F.octet_length(media).cast("long").alias("media_bytes"),
        F.sha2(media, 256).alias("media_sha256"),
        "feature",
    )


def query(spark, sf_dir):
    return digest(media_columns(table(spark, sf_dir, "documents")))
