import hashlib
import struct
import zlib

import pytest

from quernel.llm import media as M


@pytest.mark.parametrize("text", ["", "x", "é" * 300, "a" * 576, "a" * 577, "long " * 40_000])
def test_round_trip(text):
    payload = M.pad(text.encode())
    assert len(payload) % 576 == 0 and len(payload) > 0 and payload.startswith(text.encode()) and set(payload[len(text.encode()) :]) <= {255}
    blob = M.write_track(payload)
    tracks, error = M.read_tracks(blob)
    assert error is None and M.read_payload(blob, tracks[0]) == payload
    seen = M.describe(tracks)[0]
    assert (seen["codec"], seen["duration"], seen["samples"]) == ("raw ", len(payload), len(payload) // 576)
    assert [k["start"] for k in seen["keyframes"]] == [blob.index(b"mdat") + 4 + i * 576 for i in range(0, seen["samples"], 16)]


def test_other_layouts():
    """Variable sizes, several chunks, 64-bit offsets, no sync table, a box that runs to the end of the file."""
    head = M.box(b"ftyp", b"isom")
    data = b"AAABBBBBCC" + b"-" * 5 + b"DDDD"
    table = M.box(
        b"stbl", M.full_box(b"stsd", struct.pack(">I", 1), M.box(b"avc1", bytes(8))), M.full_box(b"stts", struct.pack(">IIIII", 2, 3, 10, 1, 7)), M.full_box(b"stsc", struct.pack(">IIIIIII", 2, 1, 3, 1, 2, 1, 1)),
        M.full_box(b"stsz", struct.pack(">II4I", 0, 4, 3, 5, 2, 4)), M.full_box(b"co64", struct.pack(">IQQ", 2, len(head) + 8, len(head) + 8 + 15)),
    )
    movie = M.box(b"moov", M.box(b"trak", M.box(b"mdia", M.full_box(b"mdhd", bytes(8), struct.pack(">II", 90000, 37), bytes(4)), M.box(b"minf", table))))
    blob = head + M.box(b"mdat", data) + struct.pack(">I", 0) + movie[4:]
    tracks, error = M.read_tracks(blob)
    assert error is None and M.read_payload(blob, tracks[0]) == b"AAABBBBBCCDDDD"
    seen = M.describe(tracks)[0]
    assert (seen["codec"], seen["timescale"], seen["duration"], len(seen["keyframes"])) == ("avc1", 90000, 37, 4)


def test_damaged_files():
    blob = M.write_track(M.pad(b"x" * 2000))
    for cut in range(0, len(blob), 37):
        tracks, error = M.read_tracks(blob[:cut])
        assert not tracks or error is None
    assert M.read_tracks(blob[:-10])[1]
    assert M.read_tracks(struct.pack(">I4s", 4, b"free"))[1]
    assert M.read_tracks(b"") == ([], None)


def plain_file(payload):
    """The file of a payload below 4 GB, box by box, and the feature that its tables say."""
    word = lambda *n: b"".join(x.to_bytes(4, "big") for x in n)
    sized = lambda kind, body: word(len(body) + 8) + kind + body
    samples, clock = len(payload) // 576, word(0, 0, 8000, len(payload))
    unit = word(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    first = 24 + 8
    chunks = list(range(first, first + len(payload), 32 * 576))
    full, rest = divmod(samples, 32)
    runs = ([(1, 32)] if full else []) + ([(full + 1, rest)] if rest else [])
    keys = list(range(1, samples + 1, 16))
    entry = sized(b"raw ", bytes(6) + b"\0\1" + bytes(8) + b"\0\1\0\x08" + bytes(4) + (8000 << 16).to_bytes(4, "big"))
    tables = (
        sized(b"stsd", word(0, 1) + entry) + sized(b"stts", word(0, 1, samples, 576)) + sized(b"stss", word(0, len(keys), *keys))
        + sized(b"stsc", word(0, len(runs)) + b"".join(word(a, n, 1) for a, n in runs)) + sized(b"stsz", word(0, 576, samples)) + sized(b"stco", word(0, len(chunks), *chunks))
    )
    where = sized(b"dinf", sized(b"dref", word(0, 1) + sized(b"url ", word(1))))
    media = sized(b"mdhd", word(0) + clock + b"\x55\xc4\0\0") + sized(b"hdlr", word(0, 0) + b"soun" + bytes(13)) + sized(b"minf", sized(b"smhd", word(0, 0)) + where + sized(b"stbl", tables))
    track = sized(b"tkhd", word(7, 0, 0, 1, 0, len(payload)) + bytes(8) + b"\0\0\0\0\1\0\0\0" + unit + bytes(8)) + sized(b"mdia", media)
    movie = sized(b"mvhd", word(0) + clock + word(0x10000) + b"\1\0" + bytes(10) + unit + bytes(24) + word(2)) + sized(b"trak", track)
    blob = sized(b"ftyp", b"isom" + word(512) + b"isomiso2") + sized(b"mdat", payload) + sized(b"moov", movie)
    last = first + (keys[-1] - 1) * 576
    return blob, f"raw,8000,{len(payload)},{samples};keys={len(keys)};first={first};last={last + 576};error="


def test_query_equals_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = M.op7_media_columns(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        payload = M.pad(raw)
        blob, feature = plain_file(payload)
        assert r["feature"] == feature
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-32:]), len(blob), hashlib.sha256(blob).hexdigest())


def test_columns_of_files(spark, make_docs):
    stored = M.store_texts(make_docs([(1, None, None, None), (2, "a", "en", "s"), (2, "a", "en", "s")]))
    rows = M.describe_media(stored, "row_id", "media").collect()
    assert len(rows) == 3 and all(r["error"] is None and r["tracks"][0]["samples"] == 1 for r in rows)
    none = M.describe_media(spark.createDataFrame([(1, None)], "i long, m binary"), "i", "m").first()
    assert (none["tracks"], none["error"]) == ([], None)
    assert M.store_texts(make_docs([])).count() == 0


def test_long_texts_are_stored_in_parts_by_bytes(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(M, "PART_BYTES", 1000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["a" * 400, None, "b" * 700, "c" * 5000, "", "d" * 10, "e" * 990, "f", None])], ["row_id", "text"])
    parts = list(M._by_bytes(batch, 1))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist() and [p.num_rows for p in parts] == [2, 1, 1, 3, 2]
    rows = spark.createDataFrame([(1, "é" * 2_000_000), (2, "x")], "doc_id long, text string")
    tracks = {r["row_id"]: r["tracks"][0] for r in M.describe_media(M.store_texts(rows), "row_id", "media").collect()}
    assert tracks[1]["samples"] == -(-4_000_000 // 576) and tracks[2]["samples"] == 1
