"""JPEG columns and ZIP-packaged archives."""

import base64
import hashlib
import io
import os
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest

from strandex.llm import jpeg, warc_zip


def test_payloads_come_back():
    rnd = random.Random(1)
    payloads = [rnd.randbytes(192 * n) for n in (1, 2, 3, 63, 64, 65, 130, 200)] + [b" " * 192, b"\xff" * 576, b"\x00" * 192, b"\x80" * 384, b"\x7f\x80" * 96]
    for p, row in zip(payloads, jpeg.decode(jpeg.encode_payload(payloads)), strict=True):
        assert "problem" not in row and jpeg.read_payload(row) == p
        assert row["width"] % 8 == 0 and row["thumb"].shape == (row["height"] // 8, row["width"] // 8)


def test_runs_give_the_same_files(monkeypatch):
    rnd = random.Random(2)
    payloads = [rnd.randbytes(192 * n) for n in (1, 5, 200, 9, 64, 131)]
    whole = jpeg.encode_payload(payloads)
    for run in (2, 6, 64, 100):
        monkeypatch.setattr(jpeg, "_RUN", run)
        assert jpeg.encode_payload(payloads) == whole


# the luminance table of the standard's annex K, and a plain encoder with it for any sampling
DC = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12)))
AC_COUNTS = bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 0x7D])
AC_SYMBOLS = bytes.fromhex(
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
    "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
    "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
)


def codes(counts, symbols):
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def plain_encode(blocks, parts, width, height, every, quant):
    """blocks: [(component, 64 coefficients in zigzag order)] in scan order; parts: (h, v) of each component."""
    dc, ac = codes(*DC), codes(AC_COUNTS, AC_SYMBOLS)
    per = sum(h * v for h, v in parts)
    scans, bits, pred = [], [], {}

    def put(code, length):
        bits.extend((code >> (length - 1 - i)) & 1 for i in range(length))

    def value(v):
        s = abs(v).bit_length()
        return s, v if v > 0 else v + (1 << s) - 1

    for n, (c, co) in enumerate(blocks):
        if every and n % (per * every) == 0 and n:
            scans.append(bits[:])
            bits.clear()
            pred.clear()
        s, m = value(co[0] - pred.get(c, 0))
        pred[c] = co[0]
        put(*dc[s])
        put(m, s)
        run = 0
        last = max((k for k in range(64) if co[k]), default=0)
        for k in range(1, last + 1):
            if co[k] == 0:
                run += 1
                continue
            while run > 15:
                put(*ac[0xF0])
                run -= 16
            s, m = value(co[k])
            put(*ac[run << 4 | s])
            put(m, s)
            run = 0
        if last < 63:
            put(*ac[0])
    scans.append(bits)
    seg = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0xx") + seg(0xDB, b"\0" + bytes([quant] * 64))
    out += seg(0xC0, struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(parts)))
    out += seg(0xC4, b"\x00" + DC[0] + DC[1]) + seg(0xC4, b"\x10" + AC_COUNTS + AC_SYMBOLS)
    if every:
        out += seg(0xDD, struct.pack(">H", every))
    out += seg(0xDA, bytes([len(parts)]) + b"".join(bytes([i + 1, 0]) for i in range(len(parts))) + b"\0\x3f\0")
    for n, b in enumerate(scans):
        b = b + [1] * (-len(b) % 8)
        out += np.packbits(np.array(b, np.uint8)).tobytes().replace(b"\xff", b"\xff\0") + (bytes([0xFF, 0xD0 + n % 8]) if n < len(scans) - 1 else b"")
    return out + b"\xff\xd9"


@pytest.mark.parametrize(("parts", "every"), [([(1, 1)], 0), ([(1, 1)] * 3, 2), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 3)])
def test_general_baseline_files(parts, every):
    rnd = random.Random(str((parts, every)))
    h, v = max(p[0] for p in parts), max(p[1] for p in parts)
    width, height = 8 * h * 3 - 5, 8 * v * 2 - 3
    units = 6
    blocks = []
    for _ in range(units):
        for c, (a, b) in enumerate(parts):
            for _ in range(a * b):
                co = [0] * 64
                co[0] = rnd.randint(-300, 300)
                for k in rnd.sample(range(1, 64), rnd.choice([0, 1, 3, 20, 63])):
                    co[k] = rnd.choice([-1, 1, rnd.randint(-900, 900)])
                blocks.append((c, co))
    data = plain_encode(blocks, parts, width, height, every, 4)
    row, other = jpeg.decode([data, data[:60]])
    assert "problem" in other and (row["width"], row["height"]) == (width, height)
    assert row["coefficients"].reshape(-1, 64).tolist() == [co for _, co in blocks]
    per, (a, b) = sum(x * y for x, y in parts), parts[0]
    want = np.zeros((2 * b, 3 * a), int)
    for u in range(units):
        for k in range(a * b):
            dc = blocks[u * per + k][1][0]
            want[u // 3 * b + k // a, u % 3 * a + k % a] = min(255, max(0, (dc * 4 + 4) // 8 + 128))
    rows, cols = row["thumb"].shape
    assert (row["thumb"] == want[:rows, :cols]).all() and rows == -(-height * b // (8 * v)) and cols == -(-width * a // (8 * h))


def test_broken_files_have_a_problem(spark):
    good = jpeg.encode_payload([b"abc".ljust(192)])[0]
    files = [b"", b"GIF89a", good[:40], good[:-30], good.replace(b"\xff\xc0", b"\xff\xc2"), good]
    assert ["problem" in r for r in jpeg.decode(files)] == [True] * 5 + [False]
    df = spark.createDataFrame([(n, 1, f) for n, f in enumerate(files)] + [(9, None, None)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in jpeg.media_features(df).collect()}
    assert got[5].problem is None and got[5].payload_sha256 == hashlib.sha256(b"abc".ljust(192)).hexdigest() and got[9].problem and got[9].media_bytes == 0


def test_text_media(spark):
    rows = [(1, ""), (2, None), (3, "ü" * 500), (4, "same"), (5, "same"), (None, "x" * 200000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in jpeg.media_features(jpeg.text_media(df)).collect()}
    for d, t in rows:
        p = (t or "").encode()
        p = p.ljust(max(192, -(-len(p) // 192) * 192))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert got[4].media_sha256 == got[5].media_sha256 and jpeg.text_media(df.limit(0)).collect() == []


# --- archives


def package(pages):
    out = io.BytesIO()
    z = warc_zip.ZipWriter(out)
    z.begin(warc_zip.WARC)
    index = []
    for page, payload in pages:
        data = warc_zip.record(page, "http://x/", payload, warc_zip.digest(payload), None)
        index.append(f"{page}\t{z.write(data)}\t{len(data)}\n")
    z.end()
    z.begin(warc_zip.INDEX)
    z.write("".join(index).encode())
    z.end()
    z.close()
    return out.getvalue()


def test_packages_are_zip_files_and_are_read_by_ranges():
    pages = [(n, os.urandom(n * 997)) for n in range(40)]
    raw = package(pages)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and z.namelist() == [warc_zip.WARC, warc_zip.INDEX]
    got = list(warc_zip.read_package(io.BytesIO(raw), len(raw)))
    assert [(int(r["WARC-Page-ID"]), r["payload"]) for r in got] == pages


def test_foreign_zip_files():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"a comment PK\5\6 with a signature"
        z.writestr("packed.txt", b"z" * 99, zipfile.ZIP_DEFLATED)
        z.writestr("stored.bin", b"inner bytes")
    raw = out.getvalue()
    reader = warc_zip.ZipReader(io.BytesIO(raw), len(raw))
    at, n = reader.locate("stored.bin")
    assert raw[at : at + n] == b"inner bytes" and "packed.txt" not in reader.members
    for broken in (b"", b"PK", raw[:-70], b"x" * 100):
        with pytest.raises((ValueError, struct.error)):
            warc_zip.ZipReader(io.BytesIO(broken), len(broken))


def test_round_trip_with_revisits(spark):
    rows = [(3, "u", "x"), (1, "v", "x"), (2, None, None), (5, "w", ""), (None, "n", "x"), (7, "é\r\n", "ü" * 99999), (7, "é", "other")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, sha int").repartition(2)
    got = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_zip.round_trip(df).collect())
    d = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {3: 1, 5: 2}
    want = sorted(((p or 0), len((h or "").encode()), d(h), "revisit" if p in first else "response", first.get(p)) for p, _, h in rows)
    assert got == want
    # a repeated page id with payloads of its own and one that page 1 has too
    more = spark.createDataFrame([(1, "u", "same"), (8, "u", "same"), (8, "v", "alone"), (8, "w", "same")], "page_id long, url string, html string")
    again = sorted((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc_zip.round_trip(more).collect())
    assert again == sorted([(1, d("same"), "response", None), (8, d("same"), "revisit", 1), (8, d("same"), "revisit", 1), (8, d("alone"), "response", None)])
    assert {r.record_type for r in warc_zip.round_trip(df, least_bytes=5).collect()} == {"response"}
    assert warc_zip.round_trip(df.limit(0)).collect() == []
