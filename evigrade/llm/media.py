"""Media columns: signature sniffing.

An Aho-Corasick automaton finds every place of every known magic number in one pass over a blob. A format's validator then
confirms structure and length from there: a magic number alone proves nothing. What is confirmed at the first byte is the
blob's type, which corrects a declared one; what is confirmed further in is carved as embedded media, outermost first.

Defined results: a null or empty blob, or one that no validator confirms, has type ``unknown``; a null declared type is
taken as wrong; confirmed regions never overlap, at equal starts the longer one wins; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrade.sources.staging import cut, table

from .common import bounded_batches, id_and_bytes

#: Magic numbers by format.
MAGIC = {"png": [b"\x89PNG\r\n\x1a\n"], "gif": [b"GIF87a", b"GIF89a"], "jpeg": [b"\xff\xd8\xff"], "riff": [b"RIFF"], "bmp": [b"BM"], "ppm": [b"P6\n", b"P5\n"]}
#: A payload's length is a positive multiple of this: 64 pixels of three 8-bit samples.
ROW = 192
STORED = ("wav", "bmp", "png", "ppm")
#: What stands before and after a medium that is embedded in a file of no known format.
CARRIER = (b"attached:\r\n", b"\r\nend")


def png_end(b: bytes, at: int) -> tuple[str, int, str] | None:
    pos, about = at + 8, None
    while pos + 12 <= len(b):
        n, kind = struct.unpack(">I4s", b[pos : pos + 8])
        body = b[pos + 8 : pos + 8 + n]
        if len(body) < n or struct.unpack(">I", b[pos + 8 + n : pos + 12 + n])[0:1] != (zlib.crc32(kind + body),):
            return None
        if about is None:
            if kind != b"IHDR" or n != 13:
                return None
            about = "{}x{}".format(*struct.unpack(">II", body[:8]))
        pos += 12 + n
        if kind == b"IEND":
            return "png", pos, about
    return None


def gif_end(b: bytes, at: int) -> tuple[str, int, str] | None:
    try:
        w, h, flags = struct.unpack("<HHB", b[at + 6 : at + 11])
        pos = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
        while b[pos] != 0x3B:
            if b[pos] == 0x21:
                pos += 2
            elif b[pos] == 0x2C:
                local = b[pos + 9]
                pos += 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0)
            else:
                return None
            while b[pos]:
                pos += b[pos] + 1
            pos += 1
        return "gif", pos + 1, f"{w}x{h}"
    except (IndexError, struct.error):
        return None


def jpeg_end(b: bytes, at: int) -> tuple[str, int, str] | None:
    pos, about = at + 2, None
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        mark, n = b[pos + 1], int.from_bytes(b[pos + 2 : pos + 4], "big")
        if mark == 0xDA:
            if about is None:
                return None
            pos += 2 + n
            while (pos := b.find(b"\xff", pos)) >= 0 and pos + 1 < len(b):
                if b[pos + 1] == 0xD9:
                    return "jpeg", pos + 2, about
                if b[pos + 1] and not 0xD0 <= b[pos + 1] <= 0xD7 and b[pos + 1] != 0xFF:
                    break
                pos += 1 if b[pos + 1] == 0xFF else 2
            else:
                return None
            continue
        if mark < 0xC0 or mark in (0xD8, 0xD9) or n < 2:
            return None
        if mark in (0xC0, 0xC1, 0xC2):
            about = "{1}x{0}".format(*struct.unpack(">HH", b[pos + 5 : pos + 9]))
        pos += 2 + n
    return None


def riff_end(b: bytes, at: int) -> tuple[str, int, str] | None:
    if at + 20 > len(b):
        return None
    n, form = struct.unpack("<I4s", b[at + 4 : at + 12])
    kind, end = {b"WAVE": "wav", b"WEBP": "webp", b"AVI ": "avi"}.get(form), at + 8 + n
    if kind is None or end > len(b):
        return None
    pos, about = at + 12, ""
    while pos + 8 <= end:
        name, size = struct.unpack("<4sI", b[pos : pos + 8])
        if name == b"fmt " and size >= 16:
            channels, rate, bits = struct.unpack("<HI6xH", b[pos + 10 : pos + 24])
            about = f"{channels}ch{rate}hz{bits}bit"
        pos += 8 + size + size % 2
    return (kind, end, about) if pos in (end, end + 1) and (kind != "wav" or about) else None


def bmp_end(b: bytes, at: int) -> tuple[str, int, str] | None:
    if at + 54 > len(b):
        return None
    size, _, start, header, w, h, planes, bits, packed = struct.unpack("<IIIIiiHHI", b[at + 2 : at + 34])
    row = (w * bits + 31) // 32 * 4
    if header != 40 or planes != 1 or packed or bits not in (1, 4, 8, 16, 24, 32) or w <= 0 or not h or size != start + row * abs(h) or at + size > len(b):
        return None
    return "bmp", at + size, f"{w}x{abs(h)}"


def ppm_end(b: bytes, at: int) -> tuple[str, int, str] | None:
    head = b[at + 3 : at + 43].split(b"\n", 2)
    if len(head) < 3 or head[1] != b"255" or len(size := head[0].split(b" ")) != 2 or not all(x.isdigit() for x in size):
        return None
    w, h = map(int, size)
    end = at + 3 + len(head[0]) + 1 + 4 + w * h * (3 if b[at + 1] == 54 else 1)
    return ("ppm", end, f"{w}x{h}") if w and h and end <= len(b) else None


VALIDATORS = {"png": png_end, "gif": gif_end, "jpeg": jpeg_end, "riff": riff_end, "bmp": bmp_end, "ppm": ppm_end}


@lru_cache(1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, magics in MAGIC.items():
        for m in magics:
            a.add_word(m.decode("latin-1"), (kind, len(m)))
    a.make_automaton()
    return a


def sniff(blob: bytes | None) -> list[tuple[str, int, int, str]]:
    """(type, start, end, about) of the media confirmed in blob; regions inside another one are left to it."""
    found, past = [], 0
    if blob:
        for last, (kind, n) in _automaton().iter(blob.decode("latin-1")):
            at = last - n + 1
            if at >= past and (ok := VALIDATORS[kind](blob, at)):
                found.append((ok[0], at, ok[1], ok[2]))
                past = ok[1]
    return found


def told(blob: bytes | None, declared: str | None) -> dict:
    """What sniffing says of a blob: its type and what it is like, whether the declared type was another, and what is embedded further in."""
    hits = sniff(blob)
    own = hits[0] if hits and hits[0][1] == 0 else ("unknown", 0, 0, "")
    inner = [{"media_type": k, "about": about, "start": s, "end": e, "data": blob[s:e]} for k, s, e, about in hits if s]
    return {"media_type": own[0], "about": own[3], "end": own[2], "corrected": declared != own[0], "embedded": inner}


def sniff_media(df: DataFrame, id_col: str, blob_col: str, declared_col: str) -> DataFrame:
    """doc_id, media_type, about, corrected (the declared type was another) and embedded, the carved media with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"doc_id": i.as_py()} | told(blob.as_py(), declared.as_py()) for i, blob, declared in zip(b.column(0), b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    inner = pa.struct([("media_type", pa.string()), ("about", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("data", pa.binary())])
    out = pa.schema([("doc_id", pa.int64()), ("media_type", pa.string()), ("about", pa.string()), ("corrected", pa.bool_()), ("embedded", pa.list_(inner))])
    cols = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{blob_col}`").alias("blob"), F.col(f"`{declared_col}`").cast("string").alias("declared"))
    return bounded_batches(cols).mapInArrow(run, "doc_id long, media_type string, about string, corrected boolean, embedded array<struct<media_type string, about string, start long, end long, data binary>>")


def store(payload: bytes, kind: str) -> bytes:
    """payload, of a length divisible by ROW, as the 8-bit samples of a medium."""
    n, rows = len(payload), len(payload) // ROW
    if kind == "wav":
        body = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", n) + payload
        return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body
    if kind == "bmp":  # a negative height: rows from the top
        return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + n, 0, 54, 40, 64, -rows, 1, 24, 0, n, 2835, 2835, 0, 0) + payload
    if kind == "png":
        lines = b"".join(b"\0" + payload[i : i + ROW] for i in range(0, n, ROW))
        block = lambda k, x: struct.pack(">I", len(x)) + k + x + struct.pack(">I", zlib.crc32(k + x))
        return MAGIC["png"][0] + block(b"IHDR", struct.pack(">IIBBBBB", 64, rows, 8, 2, 0, 0, 0)) + block(b"IDAT", zlib.compress(lines, 1)) + block(b"IEND", b"")
    return b"P6\n64 %d\n255\n" % rows + payload


def read_back(blob: bytes) -> bytes:
    """The samples of a medium that store() wrote, by the type that sniffing finds, whatever was declared."""
    kind = (sniff(blob) or [("unknown", 0, 0, "")])[0][0]
    if kind == "wav":
        return blob[44:]
    if kind == "bmp":
        return blob[54:]
    if kind == "png":
        n = struct.unpack(">I", blob[33:37])[0]
        lines = zlib.decompress(blob[41 : 41 + n])
        return b"".join(lines[i + 1 : i + 1 + ROW] for i in range(0, len(lines), ROW + 1))
    if kind == "ppm":
        return blob.split(b"\n", 3)[3]
    raise ValueError("the stored medium can't be confirmed")


def padded(text: bytes) -> bytes:
    return text + b" " * (max(1, -(-len(text) // ROW)) * ROW - len(text))


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, declared and media: each text as a medium of a kind that follows from its bytes.

    A third are declared wrongly, and a fifth are embedded in a carrier, from which only carving gets them back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, said, media = [], [], []
            for t in b.column(1):
                raw = t.as_py()
                mark = zlib.crc32(raw)
                kind = STORED[mark % len(STORED)]
                sizes.append(len(raw))
                said.append(kind if mark // 4 % 3 else "jpeg")
                medium = store(padded(raw), kind)
                media.append(medium.join(CARRIER) if mark % 5 == 0 else medium)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(said), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "declared", "media"])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary")


#: media_bytes and media_sha256 are those of the stored form, carrier and all; carved_bytes and carved_sha256 are those of the medium in it.
OP9 = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, carved_bytes long, carved_sha256 string"


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cut(stored_texts(table(spark, sf_dir, "documents")), "media", compression="zstd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in OP9.split(", ")]
        for b in batches:
            rows = []
            for i, n, declared, blob in zip(*map(b.column, range(4)), strict=True):
                blob, declared = blob.as_py(), declared.as_py()
                said = told(blob, declared)
                inner = said["embedded"][0] if said["media_type"] == "unknown" else None
                medium = inner["data"] if inner else blob[: said["end"]]
                kind, about = (inner or said)["media_type"], (inner or said)["about"]
                payload = read_back(medium)
                how = "carved" if inner else "corrected" if said["corrected"] else "kept"
                feature = f"{kind}:{about}:{declared}:{how}:{len(sniff(payload))}"
                rows.append((i.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), feature, len(medium), hashlib.sha256(medium).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c[0], str) else pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return kept.mapInArrow(run, OP9)
