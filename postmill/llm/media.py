"""Signature sniffing of binary columns.

One Aho-Corasick pass over a payload locates the magic bytes of all known formats; a validator per format then
confirms structure and length. What stands at offset 0 is the payload's true type and corrects the declared one;
what stands further in is an embedded file, which carve() cuts out. Signatures are looked up in the one payload; its
bytes are copied for none of them.

Contract. A null payload has no type, length or embedded files. An empty payload, or one that no validator confirms,
has type application/octet-stream and its own length. Of signatures that overlap inside another confirmed file, all
are reported, in order of offset and then type. Rows are independent: repeated rows give repeated results, an empty
table gives none, and other columns stay as they are (an existing column named like an output is replaced).
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.common import in_small_batches, whole_text

BLOCK = 64
RATE = 8000
UNKNOWN = "application/octet-stream"
SNIFFED = "type string, declared string, corrected boolean, length bigint, embedded array<struct<type:string,offset:bigint,length:bigint>>"

#: Magic bytes, where in the format they stand, and the format's media type.
SIGNATURES = (
    (b"RIFF", 0, "audio/wav"),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"BM", 0, "image/bmp"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"OggS", 0, "audio/ogg"),
    (b"fLaC", 0, "audio/flac"),
    (b"ftyp", 4, "video/mp4"),
)


def _wav(data: memoryview, at: int) -> int:
    """Length of a RIFF/WAVE file whose chunks add up, else 0."""
    if len(data) - at < 44 or bytes(data[at + 8 : at + 12]) != b"WAVE":
        return 0
    total = struct.unpack_from("<I", data, at + 4)[0] + 8
    if total > len(data) - at:
        return 0
    place, seen = at + 12, set()
    while place + 8 <= at + total:
        name, size = bytes(data[place : place + 4]), struct.unpack_from("<I", data, place + 4)[0]
        seen.add(name)
        place += 8 + size + size % 2
    return total if place == at + total and {b"fmt ", b"data"} <= seen else 0


def _png(data: memoryview, at: int) -> int:
    place, first = at + 8, True
    while place + 12 <= len(data):
        size = struct.unpack_from(">I", data, place)[0]
        name = bytes(data[place + 4 : place + 8])
        if size > len(data) - place - 12 or (first and (name != b"IHDR" or size != 13)):
            return 0
        if zlib.crc32(data[place + 4 : place + 8 + size]) != struct.unpack_from(">I", data, place + 8 + size)[0]:
            return 0
        place, first = place + 12 + size, False
        if name == b"IEND":
            return place - at
    return 0


def _jpeg(data: memoryview, at: int) -> int:
    """Segments up to the scan must add up; the file ends at the end marker."""
    place = at + 2
    while place + 4 <= len(data) and data[place] == 0xFF:
        kind, size = data[place + 1], struct.unpack_from(">H", data, place + 2)[0]
        if size < 2 or kind < 0xC0:
            return 0
        place += 2 + size
        if kind == 0xDA:
            end = data.obj.find(b"\xff\xd9", place)
            return end + 2 - at if end >= 0 else 0
    return 0


def _gif(data: memoryview, at: int) -> int:
    if len(data) - at < 14:
        return 0
    flags = data[at + 10]
    place = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while place < len(data):
        kind = data[place]
        if kind == 0x3B:
            return place + 1 - at
        if kind == 0x21:
            place += 2
        elif kind == 0x2C and place + 10 < len(data):
            local = data[place + 9]
            place += 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0)
        else:
            return 0
        while place < len(data) and data[place]:
            place += data[place] + 1
        place += 1
    return 0


def _bmp(data: memoryview, at: int) -> int:
    if len(data) - at < 30:
        return 0
    size, _, pixels, header = struct.unpack_from("<IIII", data, at + 2)
    planes = struct.unpack_from("<H", data, at + 26)[0]
    return size if header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= pixels <= size <= len(data) - at and planes == 1 else 0


def _pdf(data: memoryview, at: int) -> int:
    """A version after the mark, and up to the next file of that kind the last end mark, with a place of the cross-reference before it."""
    raw = data.obj
    if not raw[at + 5 : at + 6].isdigit():
        return 0
    after = raw.find(b"%PDF-", at + 5)
    end = raw.rfind(b"%%EOF", at, after if after >= 0 else len(raw))
    start = raw.rfind(b"startxref", max(at, end - 64), max(end, 0))
    if end < 0 or start < 0 or not raw[start + 9 : end].strip().isdigit():
        return 0
    return end + 5 - at


def _zip(data: memoryview, at: int) -> int:
    """The first end record after it whose central directory lies right before it and begins where it says."""
    raw = data.obj
    end = raw.find(b"PK\x05\x06", at)
    while 0 <= end and end + 22 <= len(raw):
        size, first = struct.unpack_from("<II", raw, end + 12)
        comment = struct.unpack_from("<H", raw, end + 20)[0]
        if at + first + size == end and (not size or raw.startswith(b"PK\x01\x02", at + first)):
            return min(end + 22 + comment, len(raw)) - at
        if raw.find(b"PK\x03\x04", at + 4, end) >= 0:
            return 0  # the record is that of a later file
        end = raw.find(b"PK\x05\x06", end + 4)
    return 0


def _gzip(data: memoryview, at: int) -> int:
    own = zlib.decompressobj(31)
    try:
        place = at
        while place < len(data) and not own.eof:
            own.decompress(data[place : place + 65536], 1 << 20)
            while own.unconsumed_tail and not own.eof:
                own.decompress(own.unconsumed_tail, 1 << 20)
            place += 65536
    except zlib.error:
        return 0
    return min(place, len(data)) - at - len(own.unused_data) if own.eof else 0


def _ogg(data: memoryview, at: int) -> int:
    place = at
    while place + 27 <= len(data) and bytes(data[place : place + 4]) == b"OggS" and data[place + 4] == 0:
        n = data[place + 26]
        if place + 27 + n > len(data):
            break
        size = 27 + n + sum(data[place + 27 : place + 27 + n])
        if place + size > len(data):
            break
        place += size
    return place - at


def _flac(data: memoryview, at: int) -> int:
    """The first metadata block must be the 34-byte stream header; frames have no total length, so it runs to the end."""
    return len(data) - at if len(data) - at >= 42 and data[at + 4] & 0x7F == 0 and bytes(data[at + 5 : at + 8]) == b"\0\0\x22" else 0


def _mp4(data: memoryview, at: int) -> int:
    place = at
    while place + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, place)
        if size < 8 or size > len(data) - place or not name.isalnum():
            break
        if place == at and (size < 16 or size % 4 or not bytes(data[at + 8 : at + 12]).isascii()):
            return 0  # a brand, its version, and further brands of four letters
        place += size
    return place - at


VALIDATORS = {
    "audio/wav": _wav, "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "application/pdf": _pdf,
    "application/zip": _zip, "application/gzip": _gzip, "audio/ogg": _ogg, "audio/flac": _flac, "video/mp4": _mp4,
}

_automaton: list = []


def automaton():
    if not _automaton:
        import ahocorasick

        own = ahocorasick.Automaton()
        for n, (magic, _, _) in enumerate(SIGNATURES):
            own.add_word(magic.decode("latin-1"), n)
        own.make_automaton()
        _automaton.append(own)
    return _automaton[0]


def files_in(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of each confirmed file in data, in order of offset."""
    view, found = memoryview(data), set()
    for end, n in automaton().iter(data.decode("latin-1")):
        magic, inside, kind = SIGNATURES[n]
        at = end + 1 - len(magic) - inside
        if at >= 0 and (length := VALIDATORS[kind](view, at)):
            found.add((at, kind, length))
    return [(kind, at, length) for at, kind, length in sorted(found)]


def sniff(df: DataFrame, payload: str, declared: str | None = None) -> DataFrame:
    """df with SNIFFED: the payload's true type and length, whether that corrects the declared type, embedded files."""
    names = [x.split()[0] for x in SNIFFED.split(", ")]
    base = df.withColumn("declared", F.col(declared).cast("string") if declared else F.lit(None).cast("string"))
    kept = [c for c in base.columns if c not in names or c == "declared"]
    base = base.select(*kept)
    place, said = kept.index(payload), kept.index("declared")
    schema = f"{base.drop('declared')._jdf.schema().toDDL()}, {SNIFFED}"

    def look(batches):
        import pyarrow as pa

        inner = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            kinds, lengths, fixed, embedded = [], [], [], []
            told = batch.column(said).to_pylist()
            for cell, was in zip(batch.column(place), told, strict=True):
                if not cell.is_valid:
                    for column in (kinds, lengths, fixed, embedded):
                        column.append(None)
                    continue
                data = cell.as_buffer().to_pybytes()
                files = files_in(data)
                own = [x for x in files if x[1] == 0]
                kind, _, length = max(own, key=lambda x: x[2]) if own else (UNKNOWN, 0, len(data))
                kinds.append(kind)
                lengths.append(length)
                fixed.append(was is not None and was != kind)
                embedded.append([{"type": k, "offset": a, "length": n} for k, a, n in files if a])
            rest = [(n, batch.column(i)) for i, n in enumerate(kept) if n != "declared"]
            new = [("type", pa.array(kinds, pa.string())), ("declared", batch.column(said)), ("corrected", pa.array(fixed, pa.bool_())), ("length", pa.array(lengths, pa.int64())), ("embedded", pa.array(embedded, inner))]
            yield pa.RecordBatch.from_arrays([x for _, x in rest + new], [n for n, _ in rest + new])

    return in_small_batches(base).mapInArrow(look, schema)


def carve(sniffed: DataFrame, payload: str) -> DataFrame:
    """One row for each embedded file of sniff()'s rows: their columns, and carved_type, carved_offset and carved, its bytes.
    Rows without embedded files give none."""
    names = ("carved_type", "carved_offset", "carved")
    rest = [F.col(f"`{c}`") for c in sniffed.columns if c not in names]
    each = sniffed.select(*rest, F.explode("embedded").alias("_file"))
    cut = F.substring(F.col(f"`{payload}`"), (F.col("_file.offset") + 1).cast("int"), F.col("_file.length").cast("int"))
    return each.withColumns(dict(zip(names, (F.col("_file.type"), F.col("_file.offset"), cut), strict=True))).drop("_file")


def to_wav(data: bytes) -> bytes:
    """The bytes as the samples of an 8-bit mono WAV file, padded with zero bytes to a positive multiple of BLOCK."""
    padded = data + bytes(-len(data) % BLOCK if data else BLOCK)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(padded), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(padded))
    return head + padded


def store_text(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text as 8-bit samples."""

    def store(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [x.as_buffer().to_pybytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([to_wav(x) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return in_small_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))).mapInArrow(store, "doc_id bigint, n_bytes bigint, media binary")


def samples(media: str = "media", length: str = "length"):
    """The samples of a confirmed WAV file as to_wav writes it: what follows the 44 bytes of its head, up to its length."""
    return F.substring(F.col(media), F.lit(45), F.col(length).cast("int") - 44)
