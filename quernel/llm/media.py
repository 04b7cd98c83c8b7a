"""Media columns: ISO base media files in binary columns.

``write_track`` stores a payload as the samples of one raw 8-bit track; ``read_tracks`` walks the nested boxes of any such
file, decodes the sample tables (stsd, mdhd, stts, stsc, stsz, stco/co64, stss) and gives codec, duration and the byte range
of every keyframe. No payload byte is decoded; a range is read only when asked for.

A file is one row, so work per row is bounded by its size; rows are independent and nothing is shuffled.

Defined results: a null or empty text is the empty payload, padded to one unit; equal texts give equal files; a file that is
cut short, has a box that overruns its parent or lacks a table gives the tracks read so far and an ``error``; a null file
has no tracks; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

UNIT = 576  # bytes of a sample
TIMESCALE = 8000  # 8-bit samples a second
PER_CHUNK = 32  # samples of a chunk
PART_BYTES, PART_ROWS = 8_000_000, 64  # of a batch that are turned into files at a time
KEY_EVERY = 16  # each so many samples one is a sync sample
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}  # fixed values


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full_box(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def pad(payload: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of UNIT."""
    return payload + b"\xff" * (-len(payload) % UNIT or (UNIT if not payload else 0))


def write_track(payload: bytes) -> bytes:
    """An ISO media file whose samples are the payload's units of UNIT bytes; the payload's length is a positive multiple."""
    samples = len(payload) // UNIT
    chunks = -(-samples // PER_CHUNK)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    duration = len(payload)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    mdat_header = 16 if len(payload) + 8 >= 1 << 32 else 8
    first = len(head) + mdat_header
    offsets = first + np.arange(chunks, dtype=np.int64) * PER_CHUNK * UNIT
    wide = bool(chunks) and int(offsets[-1]) >= 1 << 32
    places = full_box(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes())
    runs = [(1, min(PER_CHUNK, samples))] + ([(chunks, samples - (chunks - 1) * PER_CHUNK)] if chunks > 1 and samples % PER_CHUNK else [])
    keys = np.arange(1, samples + 1, KEY_EVERY, dtype=">u4")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16))
    table = box(
        b"stbl",
        full_box(b"stsd", struct.pack(">I", 1), entry),
        full_box(b"stts", struct.pack(">III", 1, samples, UNIT)),
        full_box(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, n, 1) for a, n in runs)),
        full_box(b"stsz", struct.pack(">II", UNIT, samples)),
        places,
    )
    info = box(b"minf", full_box(b"smhd", bytes(4)), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), table)
    clock = struct.pack(">IIII", 0, 0, TIMESCALE, min(duration, 2**32 - 1))
    media = box(b"mdia", full_box(b"mdhd", clock, struct.pack(">HH", 0x55C4, 0)), full_box(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), info)
    track_head = full_box(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, min(duration, 2**32 - 1)), bytes(8), struct.pack(">HHHH", 0, 0, 0x0100, 0), matrix, bytes(8), flags=7)
    movie_head = full_box(b"mvhd", clock, struct.pack(">IH", 0x10000, 0x0100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
    return head + box(b"mdat", payload) + box(b"moov", movie_head, box(b"trak", track_head, media))


class Truncated(ValueError):
    pass


def walk(data: memoryview, start: int = 0, end: int | None = None, path: tuple = ()):
    """(path, start of body, end) of every box, depth first. Size 1 means a 64-bit size follows, size 0 to the end."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise Truncated("box header cut short")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise Truncated("box header cut short")
            size, body = struct.unpack_from(">Q", data, body)[0], start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise Truncated(f"{kind.decode('latin-1')} overruns its parent")
        here = (*path, kind)
        yield here, body, start + size
        if kind in CONTAINERS:
            yield from walk(data, body, start + size, here)
        start += size


def _array(data: memoryview, start: int, end: int, count: int, kind: str, fields: int = 1) -> np.ndarray:
    width = np.dtype(kind).itemsize * fields * count
    if start + width > end:
        raise Truncated("table cut short")
    return np.frombuffer(data[start : start + width], dtype=kind).astype(np.int64).reshape(-1, fields)


def _track(data: memoryview, tables: dict[bytes, tuple[int, int]]) -> dict:
    def number(name: bytes, at: int, kind: str = ">I") -> int:
        start, end = tables[name]
        if start + at + struct.calcsize(kind) > end:
            raise Truncated(f"{name.decode('latin-1')} cut short")
        return struct.unpack_from(kind, data, start + at)[0]

    def rows(name: bytes, at: int, fields: int, kind: str = ">u4") -> np.ndarray:
        return _array(data, tables[name][0] + at, tables[name][1], number(name, at - 4), kind, fields)

    missing = [b for b in (b"mdhd", b"stsd", b"stts", b"stsc", b"stsz") if b not in tables]
    if missing or not ({b"stco", b"co64"} & set(tables)):
        raise Truncated("track lacks " + ", ".join(b.decode() for b in missing or [b"stco"]))
    long_clock = number(b"mdhd", 0) >> 24 == 1
    timescale = number(b"mdhd", 20 if long_clock else 12)
    codec = bytes(data[tables[b"stsd"][0] + 12 : tables[b"stsd"][0] + 16]).decode("latin-1") if number(b"stsd", 4) else ""
    times = rows(b"stts", 8, 2)
    duration = int((times[:, 0] * times[:, 1]).sum())
    fixed, count = number(b"stsz", 4), number(b"stsz", 8)
    sizes = np.full(count, fixed, dtype=np.int64) if fixed else _array(data, tables[b"stsz"][0] + 12, tables[b"stsz"][1], count, ">u4")[:, 0]
    chunk_at = (rows(b"co64", 8, 1, ">u8") if b"co64" in tables else rows(b"stco", 8, 1))[:, 0]
    runs = rows(b"stsc", 8, 3)
    if len(runs):
        repeat = np.diff(np.append(runs[:, 0], len(chunk_at) + 1))
        per_chunk = np.repeat(runs[:, 1], np.maximum(repeat, 0))[: len(chunk_at)]
    else:
        per_chunk = np.zeros(0, np.int64)
    chunk = np.repeat(np.arange(len(per_chunk)), per_chunk)[:count]
    if len(chunk) < count:
        raise Truncated("fewer samples in chunks than sizes")
    ends = np.cumsum(sizes)
    first = np.concatenate([[0], np.cumsum(per_chunk)])[chunk] if count else np.zeros(0, np.int64)
    starts = chunk_at[chunk] + (ends - sizes) - (ends - sizes)[first] if count else np.zeros(0, np.int64)
    keys = rows(b"stss", 8, 1)[:, 0] - 1 if b"stss" in tables else np.arange(count)
    keys = keys[(keys >= 0) & (keys < count)]
    return {"codec": codec, "timescale": timescale, "duration": duration, "starts": starts, "sizes": sizes, "keys": keys}


def read_tracks(blob: bytes) -> tuple[list[dict], str | None]:
    """The tracks of a file and what was wrong with it, if anything."""
    data, tracks, tables, error = memoryview(blob), [], None, None
    try:
        for path, start, end in walk(data):
            if path[-1] == b"trak":
                if tables:
                    tracks.append(_track(data, tables))
                tables = {}
            elif tables is not None and b"trak" in path:
                tables.setdefault(path[-1], (start, end))
        if tables is not None:
            tracks.append(_track(data, tables))
    except Truncated as broken:
        error = str(broken)
    return tracks, error


def read_payload(blob: bytes, track: dict) -> bytes:
    """The stored bytes of a track's samples, in order."""
    data = memoryview(blob)
    starts, sizes = track["starts"], track["sizes"]
    if not len(starts):
        return b""
    joins = np.flatnonzero(starts[1:] != starts[:-1] + sizes[:-1]) + 1
    edges = np.concatenate([[0], joins, [len(starts)]])
    return b"".join(data[int(starts[a]) : int(starts[b - 1] + sizes[b - 1])] for a, b in zip(edges[:-1], edges[1:]))


def describe(tracks: list[dict]) -> list[dict]:
    return [
        {"codec": t["codec"], "timescale": t["timescale"], "duration": t["duration"], "samples": len(t["sizes"]),
         "keyframes": [{"start": int(t["starts"][k]), "end": int(t["starts"][k] + t["sizes"][k])} for k in t["keys"]]}
        for t in tracks
    ]


TRACKS = (
    "array<struct<codec: string, timescale: long, duration: long, samples: long, "
    "keyframes: array<struct<start: long, end: long>>>>"
)


def _by_bytes(batch: pa.RecordBatch, column: int):
    """A batch in parts of about PART_BYTES bytes of a text or binary column; a longer value is alone."""
    values = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    ends, first = np.cumsum(sizes, dtype=np.int64), 0
    while first < batch.num_rows:
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + PART_BYTES, "right")))
        yield batch.slice(first, min(last, first + PART_ROWS) - first)
        first = min(last, first + PART_ROWS)


def _describe_batches(batches):
    keyframe = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    track = pa.struct([("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("keyframes", keyframe)])
    for batch in batches:
        for part in _by_bytes(batch, 1):
            read = [read_tracks(m.as_py()) if m.is_valid else ([], None) for m in part.column(1)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([describe(t) for t, _ in read], pa.list_(track)), pa.array([e for _, e in read], pa.string())],
                ["row_id", "tracks", "error"],
            )


def describe_media(files: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """row_id, tracks (codec, timescale, duration, samples, keyframe byte ranges) and error of each file."""
    rows = files.selectExpr(f"CAST(`{id_col}` AS LONG) AS row_id", f"CAST(`{media_col}` AS BINARY) AS media")
    return rows.mapInArrow(_describe_batches, f"row_id long, tracks {TRACKS}, error string")


def _store_batches(batches):
    for batch in batches:
        for part in _by_bytes(batch, 1):
            media = [write_track(pad((t.as_py() or "").encode("utf-8"))) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], ["row_id", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id and the media file of each text."""
    rows = docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS row_id", f"`{text_col}` AS text")
    return rows.mapInArrow(_store_batches, "row_id long, media binary")


DIGESTS = [("row_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def _digest_batches(batches):
    schema = pa.schema(DIGESTS)
    for batch in batches:
        rows = []
        for row_id, media in zip(batch.column(0).to_pylist(), batch.column(1)):
            blob = media.as_py()
            tracks, error = read_tracks(blob)
            payload = read_payload(blob, tracks[0]) if tracks else b""
            seen = describe(tracks)
            keyframes = seen[0]["keyframes"] if seen else []
            feature = ";".join(
                [f"{t['codec'].strip()},{t['timescale']},{t['duration']},{t['samples']}" for t in seen]
                + [f"keys={len(keyframes)}", f"first={keyframes[0]['start'] if keyframes else -1}", f"last={keyframes[-1]['end'] if keyframes else -1}", f"error={error or ''}"]
            )
            rows.append((row_id, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def op7_media_columns(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.selectExpr("CAST(doc_id AS LONG) AS row_id", "text", "CAST(octet_length(coalesce(text, '')) AS LONG) AS n_bytes")

    def run(batches):
        for batch in batches:
            for part in _by_bytes(batch, 1):
                media = pa.Table.from_batches(list(_store_batches([part.select(["row_id", "text"])]))).combine_chunks().to_batches()
                for digests in _digest_batches(media):
                    yield digests.append_column("n_bytes", part.column("n_bytes"))

    schema = "row_id long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_bytes long"
    return rows.mapInArrow(run, schema).selectExpr(
        "row_id AS doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )
