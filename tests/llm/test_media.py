import gzip
import hashlib
import io
import struct
import zipfile
import zlib

from tessella.llm import media


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def crc(data, poly, bits):
    """A check value bit by bit."""
    c = 0
    for x in data:
        for k in range(7, -1, -1):
            top = c >> bits - 1 & 1
            c = (c << 1 | x >> k & 1) & (1 << bits) - 1
            c ^= poly if top else 0
    for _ in range(bits):
        c = (c << 1 & (1 << bits) - 1) ^ (poly if c >> bits - 1 & 1 else 0)
    return c


def flac_file(frames=3):
    out = b"fLaC" + b"\x80\0\0\x22" + struct.pack(">HH", 16, 16) + b"\0" * 30
    for n in range(frames):
        head = b"\xff\xf8\x69\x08" + bytes([n]) + b"\x0f"  # 16 samples, 8 bits
        head += bytes([crc(head, 0x07, 8)])
        frame = head + b"\x00" + bytes(range(n, n + 9))
        out += frame + crc(frame, 0x8005, 16).to_bytes(2, "big")
    return out


def ogg_page(flags, data=b"abc"):
    sizes = bytes([255] * (len(data) // 255) + [len(data) % 255])
    page = b"OggS\0" + bytes([flags]) + b"\0" * 20 + bytes([len(sizes)]) + sizes + data
    return page[:22] + struct.pack("<I", crc_by_bits(page)) + page[26:]


def crc_by_bits(data):
    """Ogg's check value from its definition: polynomial 0x04C11DB7, highest bit first, nothing inverted."""
    c = 0
    for byte in data:
        c ^= byte << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if c & 0x80000000 else c << 1
    return c


def samples():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00;"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xda\x00\x04cd" + b"scan\xff\x00data" + b"\xff\xd9"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
    flac = flac_file()
    ogg = ogg_page(2) + ogg_page(0, b"more" * 200) + ogg_page(4)
    mp4 = struct.pack(">I", 16) + b"ftypisom\0\0\0\0" + struct.pack(">I", 12) + b"mdatabcd"
    tiff = b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHII", 273, 4, 1, 38) + struct.pack("<HHII", 279, 4, 1, 5) + b"\0" * 4 + b"strip"
    pdf = b"%PDF-1.4\nobj\nstartxref\n9\n%%EOF"
    return {"image/png": png(), "application/zip": z.getvalue(), "application/gzip": gzip.compress(b"x" * 500), "image/gif": gif, "image/jpeg": jpeg, "image/bmp": bmp, "audio/flac": flac, "audio/ogg": ogg, "video/mp4": mp4, "image/tiff": tiff, "application/pdf": pdf, "audio/wav": media.wav(b"abc")}


def test_structure_decides_the_type_and_corrects_the_declared_one():
    for kind, data in samples().items():
        got = media.described(data, "text/plain")
        assert (got["type"], got["corrected"]) == (kind, True), kind
        assert media.described(data, kind)["corrected"] is False


def test_magic_bytes_without_structure_are_nothing():
    for magic in media.SIGNATURES:
        for tail in (b"", b"\0" * 3, b"junk that is no media at all" * 3, b"\xff" * 60):
            assert media.sniff(b"ab" + magic + tail) == [], magic


def test_embedded_media_are_carved():
    for kind, data in samples().items():
        found = media.sniff(b"some text before " + data + b" and after")
        assert (17, len(data), kind) in found, kind


def test_cut_media_are_not_accepted():
    for kind, data in samples().items():
        assert not [x for x in media.sniff(data[:-3]) if x[0] == 0], kind


def test_query(docs, rows, empty):
    got = {r.doc_id: r for r in media.sniffed(media.stored(docs), keep_carved=True).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.wav(payload)).hexdigest() and r.feature == f"audio/wav:{len(payload)}" and r.corrected
    assert media.sniffed(media.stored(empty)).count() == 0
    odd = docs.sparkSession.createDataFrame([(1, 3, None, None), (2, 3, "image/png", b"abc")], "doc_id bigint, n_bytes bigint, declared string, media binary")
    assert [r.media_type for r in media.sniffed(odd).orderBy("doc_id").collect()] == ["application/octet-stream", "image/png"]


def test_many_candidates_take_linear_time():
    import time

    for piece in (b"%PDF-1.4 ", b"PK\x03\x04 ", b"BM", b"GIF89a", b"fLaC", b"II*\0", b"RIFF"):
        began = time.time()
        assert media.sniff(piece * 150_000) == []
        assert time.time() - began < 20, piece


def test_ogg_pages_take_linear_time_and_are_checked():
    import time

    for flags, found in ((0, 0), (2, 0), (6, 1)):
        began = time.time()
        stream = ogg_page(flags) * 20_000
        assert len(media.sniff(stream)) == found, flags
        assert time.time() - began < 3, flags
    two = ogg_page(2) + ogg_page(4) + b"between" + ogg_page(6)
    assert [(o, n) for o, n, _ in media.sniff(two)] == [(0, 62), (69, 31)]
    broken = bytearray(ogg_page(2) + ogg_page(4))
    broken[-1] ^= 1
    assert media.sniff(bytes(broken)) == []
    assert media.sniff(ogg_page(2) + ogg_page(0)) == []  # it doesn't end
