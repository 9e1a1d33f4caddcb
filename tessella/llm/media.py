"""Media columns: signature sniffing with an Aho-Corasick automaton, format validators, corrected types, carved media."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch, parked, utf8

#: Payloads are padded to a positive multiple of so many bytes.
UNIT = 64
WAV_TYPE, RATE = "audio/wav", 8000


def wav(payload: bytes) -> bytes:
    """A RIFF file of one channel of unsigned 8-bit samples, a sample a byte of ``payload``."""
    body = payload + b"\0" * (len(payload) % 2)
    fmt = struct.pack("<HHIIHH", 1, 1, RATE, RATE, 1, 8)
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(fmt) + 8 + len(body)) + b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + body


def padded(text: bytes) -> bytes:
    return text + b"\0" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


class Bytes(bytes):
    """Media with searches that remember: the next place of a needle is looked up once, however many candidates ask."""

    def next(self, needle: bytes, at: int) -> int:
        known = self.__dict__.setdefault("known", {})
        asked, place = known.get(needle, (0, -2))
        if place == -2 or at < asked or 0 <= place < at:
            asked, place = at, self.find(needle, at)
            known[needle] = asked, place
        return place


def _riff(b: Bytes, at: int) -> tuple[str, int] | None:
    if at + 12 > len(b):
        return None
    size = struct.unpack_from("<I", b, at + 4)[0] + 8
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}.get(bytes(b[at + 8 : at + 12]))
    if kind is None or at + size > len(b):
        return None
    p = at + 12
    while p + 8 <= at + size:  # the chunks must fill the file
        p += 8 + (n := struct.unpack_from("<I", b, p + 4)[0]) + n % 2
    return (kind, size) if p == at + size else None


def _png(b: Bytes, at: int) -> tuple[str, int] | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        n = struct.unpack_from(">I", b, p)[0]
        kind = bytes(b[p + 4 : p + 8])
        if p + 12 + n > len(b) or first and (kind != b"IHDR" or n != 13) or zlib.crc32(memoryview(b)[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return "image/png", p - at
    return None


def _gif(b: Bytes, at: int) -> tuple[str, int] | None:
    if at + 13 > len(b):
        return None
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return "image/gif", p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            flags = b[p + 9]
            p = blocks(p + 10 + (3 << (flags & 7) + 1 if flags & 0x80 else 0) + 1)
        else:
            return None
    return None


def _jpeg(b: Bytes, at: int) -> tuple[str, int] | None:
    p, scanned = at + 2, False
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return None
        mark = b[p + 1]
        if mark == 0xD9:
            return ("image/jpeg", p + 2 - at) if scanned else None
        if mark == 0xFF:
            p += 1
            continue
        n = struct.unpack_from(">H", b, p + 2)[0]
        if mark < 0xC0 or n < 2 or p + 2 + n > len(b):
            return None
        p += 2 + n
        if mark == 0xDA:
            scanned = True
            q = b.find(b"\xff", p)
            while q >= 0 and q + 1 < len(b) and (b[q + 1] == 0 or 0xD0 <= b[q + 1] <= 0xD7):
                q = b.find(b"\xff", q + 2)
            if q < 0 or q + 1 >= len(b):
                return None
            p = q
    return ("image/jpeg", p + 2 - at) if p + 2 <= len(b) and scanned and b[p] == 0xFF and b[p + 1] == 0xD9 else None


def _bmp(b: Bytes, at: int) -> tuple[str, int] | None:
    if at + 30 > len(b):
        return None
    size, zero, offset, head = struct.unpack_from("<IIII", b, at + 2)
    planes, bits = struct.unpack_from("<HH", b, at + 26)
    good = zero == 0 and head in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + head <= offset <= size and at + size <= len(b)
    return ("image/bmp", size) if good else None


def _gzip(b: Bytes, at: int) -> tuple[str, int] | None:
    d = zlib.decompressobj(31)
    try:
        rest = memoryview(b)[at:]
        while not d.eof:
            if not len(rest):
                return None
            d.decompress(rest, 1 << 20)
            rest = d.unconsumed_tail if not d.eof else b""
        return "application/gzip", len(b) - at - len(d.unused_data)
    except zlib.error:
        return None


def _zip(b: Bytes, at: int) -> tuple[str, int] | None:
    """To the first end record whose directory lies right before it and starts where it says, counted from the file's start."""
    end = b.next(b"PK\x05\x06", at)
    while end >= 0 and end + 22 <= len(b):
        size, offset, note = struct.unpack_from("<IIH", b, end + 12)
        start = end - size - offset  # where a file with this end record starts
        if start == at and end + 22 + note <= len(b) and (not size or b[at + offset : at + offset + 4] == b"PK\x01\x02"):
            return "application/zip", end + 22 + note - at
        if start >= at:
            return None  # the record ends another file, which starts later
        end = b.find(b"PK\x05\x06", end + 4)
    return None


def _pdf(b: Bytes, at: int) -> tuple[str, int] | None:
    if not (b[at + 5 : at + 6].isdigit() and b[at + 6 : at + 7] == b"." and b[at + 7 : at + 8].isdigit()):
        return None
    end, table = b.next(b"%%EOF", at), b.next(b"startxref", at)
    return ("application/pdf", end + 5 - at) if 0 <= table < end else None


def _crc(data: bytes, poly: int, bits: int) -> int:
    """CRC of ``bits`` bits with an initial value of 0, most significant bit first."""
    if (poly, bits) not in _CRC:
        top, mask, table = 1 << bits - 1, (1 << bits) - 1, []
        for n in range(256):
            c = n << bits - 8
            for _ in range(8):
                c = (c << 1 ^ poly if c & top else c << 1) & mask
            table.append(c)
        _CRC[poly, bits] = table
    table, c, mask = _CRC[poly, bits], 0, (1 << bits) - 1
    for x in data:
        c = (c << 8 & mask) ^ table[(c >> bits - 8) ^ x]
    return c


_CRC: dict[tuple[int, int], list[int]] = {}


def _flac_header(b: Bytes, p: int) -> int:
    """The length of the frame header at ``p``, its check value included; 0 if there is none."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] & 0xFE != 0xF8 or b[p + 2] >> 4 == 0 or b[p + 2] & 15 == 15 or b[p + 3] >> 4 > 10 or b[p + 3] & 1:
        return 0
    lead, n = b[p + 4], 1  # the frame's number, in as many bytes as its leading ones say
    while n < 8 and lead & 0x80 and lead << n & 0x80:
        n += 1
    n += 4 + {6: 1, 7: 2}.get(b[p + 2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(b[p + 2] & 15, 0)
    return n + 1 if p + n < len(b) and _crc(b[p : p + n], 0x07, 8) == b[p + n] else 0


def _flac(b: Bytes, at: int) -> tuple[str, int] | None:
    """Metadata blocks, then frames: each starts with a checked header and ends with the check value of all its bytes."""
    p, first, last = at + 4, True, False
    while not last:
        if p + 4 > len(b):
            return None
        kind, n = b[p], int.from_bytes(b[p + 1 : p + 4], "big")
        if first and (kind & 0x7F or n != 34) or p + 4 + n > len(b):
            return None
        p, first, last = p + 4 + n, False, bool(kind & 0x80)
    smallest = max(10, int.from_bytes(b[at + 12 : at + 15], "big"))
    largest = int.from_bytes(b[at + 15 : at + 18], "big") or 1 << 16  # of a frame, as the stream says or the usual bound
    while _flac_header(b, p):
        # the frame ends before another header, or somewhere up to its largest size: where its check value fits
        c, table, end = 0, None, 0
        _crc(b"", 0x8005, 16)
        table = _CRC[0x8005, 16]
        for q in range(p, min(len(b), p + largest)):
            c = (c << 8 & 0xFFFF) ^ table[(c >> 8) ^ b[q]]
            if c == 0 and q + 1 - p >= smallest and (q + 1 == len(b) or _flac_header(b, q + 1) or not end):
                end = q + 1  # a check value over itself leaves 0
                if end == len(b) or _flac_header(b, end):
                    break
        if not end:
            return None
        p = end
    return "audio/flac", p - at


#: Each byte with its bits in reverse: Ogg's check value is CRC-32 with another order of bits.
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def ogg_check(page: bytes) -> int:
    """The check value of an Ogg page, over the page with zeros in its place."""
    page = page[:22] + b"\0\0\0\0" + page[26:]
    return int(f"{zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def _ogg(b: Bytes, at: int) -> tuple[str, int] | None:
    """Pages whose check values hold, from one that begins a stream to the last one that ends one.

    A walk passes each page once: no stream that begins within the pages of an earlier walk ends where that one doesn't.
    """
    if at < b.__dict__.get("walked", 0):
        return None
    p, end = at, None
    while p + 27 <= len(b) and bytes(b[p : p + 5]) == b"OggS\0":
        table = b[p + 27 : p + 27 + b[p + 26]]
        after = p + 27 + len(table) + sum(table)
        if len(table) < b[p + 26] or after > len(b) or (p == at or end == p) and not b[p + 5] & 2:
            break
        if ogg_check(bytes(b[p:after])) != struct.unpack_from("<I", b, p + 22)[0]:
            break
        end = after if b[p + 5] & 4 else end
        p = after
    b.walked = p
    return ("audio/ogg", end - at) if end else None


def _mp4(b: Bytes, at: int) -> tuple[str, int] | None:
    at, p, kinds = at - 4, at - 4, []  # the size stands before the signature
    while 0 <= p and p + 8 <= len(b):
        n, kind = struct.unpack_from(">I", b, p)[0], bytes(b[p + 4 : p + 8])
        if n < 8 or p + n > len(b) or not kind.isalnum():
            break
        kinds.append(kind)
        p += n
    return ("video/mp4", p - at) if kinds[:1] == [b"ftyp"] and {b"moov", b"moof", b"mdat"} & set(kinds) else None


#: Bytes of a value of each field type of a TIFF directory.
_TIFF_SIZE = (0, 1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8)
#: Fields that hold offsets of data, and those with the lengths: strips, tiles, an embedded thumbnail.
_TIFF_DATA = {273: 279, 324: 325, 513: 514}


def _tiff(b: Bytes, at: int) -> tuple[str, int] | None:
    """The directories one after the other; the file ends where the last directory, value or strip of data does."""
    order, end, seen = "<" if b[at] == 0x49 else ">", at + 8, set()
    if end > len(b):
        return None
    p = struct.unpack_from(order + "I", b, at + 4)[0]
    while p:
        if p < 8 or p in seen or at + p + 2 > len(b):
            return None
        seen.add(p)
        n = struct.unpack_from(order + "H", b, at + p)[0]
        last = at + p + 2 + 12 * n
        if not 0 < n < 4096 or last + 4 > len(b):
            return None
        end, data = max(end, last + 4), {}
        for e in range(at + p + 2, last, 12):
            tag, kind, count = struct.unpack_from(order + "HHI", b, e)
            if not 0 < kind < len(_TIFF_SIZE):
                return None
            size = _TIFF_SIZE[kind] * count
            where = e + 8 if size <= 4 else at + struct.unpack_from(order + "I", b, e + 8)[0]
            if where + size > len(b):
                return None
            end = max(end, where + size) if size > 4 else end
            if kind in (3, 4) and (tag in _TIFF_DATA or tag in _TIFF_DATA.values()):
                data[tag] = struct.unpack_from(f"{order}{count}{'H' if kind == 3 else 'I'}", b, where)
        for offsets, lengths in _TIFF_DATA.items():
            for start, length in zip(data.get(offsets, ()), data.get(lengths, ()), strict=False):
                if at + start + length > len(b):
                    return None
                end = max(end, at + start + length)
        p = struct.unpack_from(order + "I", b, last)[0]
    return ("image/tiff", end - at) if seen else None


# Magic bytes of the formats.
SIGNATURES: dict[bytes, Callable[[Bytes, int], tuple[str, int] | None]] = {
    b"RIFF": _riff,
    b"\x89PNG\r\n\x1a\n": _png,
    b"GIF87a": _gif,
    b"GIF89a": _gif,
    b"\xff\xd8\xff": _jpeg,
    b"BM": _bmp,
    b"\x1f\x8b\x08": _gzip,
    b"PK\x03\x04": _zip,
    b"%PDF-": _pdf,
    b"fLaC": _flac,
    b"OggS": _ogg,
    b"ftyp": _mp4,
    b"II*\x00": _tiff,
    b"MM\x00*": _tiff,
}

_AUTOMATON: list = []


def automaton():
    """Finds every signature in one pass; bytes stand as Latin-1 characters."""
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        for magic in SIGNATURES:
            a.add_word(magic.decode("latin-1"), magic)
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def sniff(media: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of all valid media in ``media``, those that lie inside another one too, by offset.

    Magic bytes alone prove nothing: a candidate counts if its format's validator follows its structure to the end.
    """
    if not media:
        return []
    view, out = Bytes(media), []
    for last, magic in automaton().iter(media.decode("latin-1")):
        at = last - len(magic) + 1
        if got := SIGNATURES[magic](view, at):
            out.append((at - 4 * (magic == b"ftyp"), got[1], got[0]))
    return sorted(out)


def described(media: bytes, declared: str | None) -> dict:
    """The type that the structure proves, whether the declared one was wrong, and what is embedded."""
    found = sniff(media)
    whole = next((t for o, _, t in found if o == 0), None)
    carved = [(o, n, t) for o, n, t in found if o]
    return {"type": whole or declared or "application/octet-stream", "corrected": whole is not None and whole != declared, "carved": carved}


def samples(media: bytes) -> bytes:
    """The data chunk of a stored RIFF file."""
    p = 12
    while p + 8 <= len(media):
        kind, n = media[p : p + 4], struct.unpack_from("<I", media, p + 4)[0]
        if kind == b"data":
            return media[p + 8 : p + 8 + n]
        p += 8 + n + n % 2
    raise ValueError("no data chunk")


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared, media: each text's bytes (null: none) as 8-bit samples, written to the shared folder and read from there.

    Repeated rows are stored each, an empty table gives an empty one, other columns are left out.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column(1))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(["application/octet-stream"] * len(texts)), pa.array([wav(padded(t)) for t in texts], pa.binary())],
            ["doc_id", "n_bytes", "declared", "media"],
        )

    return parked(by_batch(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, declared string, media binary"), "media")


def sniffed(media: DataFrame, keep_carved: bool = False) -> DataFrame:
    """Per row of (doc_id, n_bytes, declared, media): digests of the samples read back, type, corrected, feature, carved spans.

    feature is the proven type and the number of samples, then "+type@offset:length" for each embedded one. Media that no
    validator accepts keep their declared type and have no payload. With ``keep_carved`` the embedded bytes come along.
    """
    id_type = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "corrected"]
    schema = f"doc_id {id_type}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, media_type string, corrected boolean"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for m, declared in zip(batch.column("media").to_pylist(), batch.column("declared").to_pylist(), strict=True):
            m = m or b""
            d = described(m, declared)
            data = samples(m) if d["type"] == WAV_TYPE else b""
            feature = f"{d['type']}:{len(data)}" + "".join(f"+{t}@{o}:{n}" for o, n, t in d["carved"])
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature, d["type"], d["corrected"], [m[o : o + n] for o, n, _ in d["carved"]]))
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.binary())][: 9 if keep_carved else 8]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names + ["carved"] * keep_carved)

    return by_batch(media.select("doc_id", "n_bytes", "declared", "media"), run, schema + ", carved array<binary>" * keep_carved)
